"""The rare-disease catalogue, from tables or XML of alignments and prevalences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.functions.sql import lit

# Cases per million by prevalence class, limits of the tiers.
PER_MILLION = {
    "<1 / 1 000 000": 0.5, "1-9 / 1 000 000": 5.0, "1-9 / 100 000": 50.0, "1-5 / 10 000": 300.0, ">1 / 1000": 2000.0,
}
FLAG_LIMIT, AUTO_LIMIT = 100.0, 10.0


_ALIGNED = "OrphaCode STRING, ExternalReferenceList STRUCT<ExternalReference: ARRAY<STRUCT<Source: STRING, Reference: STRING>>>"
_PREVALENT = "OrphaCode STRING, PrevalenceList STRUCT<Prevalence: ARRAY<STRUCT<PrevalenceClass: STRUCT<Name: STRING>>>>"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The disorders of XML files: read as text that ends at each element's end, which Spark
    splits as it does lines, and parsed one by one."""
    parts = spark.read.option("lineSep", "</Disorder>").text(path).select(F.regexp_extract("value", r"(?s)<Disorder[\s>].*$", 0).alias("element")).where("element <> ''")
    return parts.select(F.from_xml(F.concat("element", F.lit("</Disorder>")), schema, {"rowTag": "Disorder"}).alias("d")).select("d.*").where("OrphaCode IS NOT NULL")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(orpha, icd10) pairs of the published alignment files, read in ranges, an element at a time."""
    refs = _read(spark, path, _ALIGNED).select(F.col("OrphaCode").alias("orpha"), F.explode("ExternalReferenceList.ExternalReference").alias("r"))
    return refs.where("trim(r.Source) = 'ICD-10'").select("orpha", F.trim("r.Reference").alias("icd10")).where("icd10 <> ''")


def read_prevalences(spark: SparkSession, path: str) -> DataFrame:
    """(orpha, class) pairs of the published prevalence files, read as the alignments are."""
    refs = _read(spark, path, _PREVALENT).select(F.col("OrphaCode").alias("orpha"), F.explode("PrevalenceList.Prevalence").alias("p"))
    return refs.select("orpha", F.trim("p.PrevalenceClass.Name").alias("class")).where("class <> ''")


def disorders(xml: DataFrame, column: str = "value") -> DataFrame:
    """(disorder): the text of each disorder element of XML documents."""
    return xml.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?s)<Disorder[^>]*>.*?</Disorder>"), F.lit(0))).alias("disorder"))


def alignments(xml: DataFrame, column: str = "value") -> DataFrame:
    """(orpha, icd10) pairs of the alignment file."""
    d = disorders(xml, column).select(F.regexp_extract("disorder", r"<OrphaCode>(\d+)</OrphaCode>", 1).alias("orpha"), "disorder")
    refs = F.regexp_extract_all("disorder", F.lit(r"(?s)<ExternalReference[^>]*>.*?</ExternalReference>"), F.lit(0))
    d = d.select("orpha", F.explode(refs).alias("r")).where(F.col("r").rlike(r"<Source>ICD-10</Source>"))
    return d.select("orpha", F.regexp_extract("r", r"<Reference>([^<]+)</Reference>", 1).alias("icd10")).where("icd10 <> '' AND orpha <> ''")


def prevalences(xml: DataFrame, column: str = "value") -> DataFrame:
    """(orpha, class) pairs of the prevalence file."""
    d = disorders(xml, column).select(F.regexp_extract("disorder", r"<OrphaCode>(\d+)</OrphaCode>", 1).alias("orpha"), "disorder")
    refs = F.regexp_extract_all("disorder", F.lit(r"(?s)<PrevalenceClass[^>]*>.*?</PrevalenceClass>"), F.lit(0))
    return d.select("orpha", F.explode(refs).alias("r")).select("orpha", F.trim(F.regexp_extract("r", r"<Name[^>]*>([^<]+)</Name>", 1)).alias("class"))


def normal_code(code: str) -> str:
    """SQL: without blanks, upper case, up to the first mark that lists or joins codes."""
    return f"regexp_extract(upper(regexp_replace({code}, '\\\\s+', '')), '^[^+*/,;-]*', 0)"


def build_catalogue(aligned: DataFrame, prevalent: DataFrame) -> DataFrame:
    """(code, tier): the rarest prevalence of a disorder decides, the rarest tier of a code wins."""
    per = "CASE class " + " ".join(f"WHEN {lit(k)} THEN {v}D" for k, v in PER_MILLION.items()) + " END"
    rare = prevalent.select("orpha", F.expr(per).alias("n")).where("n IS NOT NULL").groupBy("orpha").agg(F.min("n").alias("n")).where(f"n <= {FLAG_LIMIT}D")
    rows = aligned.join(rare, "orpha").select(F.expr(normal_code("icd10")).alias("code"), F.expr(f"IF(n <= {AUTO_LIMIT}D, 'auto', 'flag')").alias("tier"))
    return rows.where("code RLIKE '^[A-Z][0-9][0-9]'").groupBy("code").agg(F.min("tier").alias("tier"))


def tier_join(codes: DataFrame, catalogue: DataFrame, code: str = "code") -> DataFrame:
    """``codes`` with ``tier``, by joins instead of literals: for catalogues of any size.

    The exact code counts, and its head of three characters if it is ``auto`` or the
    exact code is unknown; Spark broadcasts the catalogue if its size allows.
    """
    c = f"upper(regexp_replace(`{code}`, '\\\\s+', ''))"
    df = codes.withColumns({"exact_": F.expr(c), "head_": F.expr(f"substring({c}, 1, 3)")})
    df = df.join(catalogue.select(F.col("code").alias("exact_"), F.col("tier").alias("t1_")), "exact_", "left")
    df = df.join(catalogue.select(F.col("code").alias("head_"), F.col("tier").alias("t2_")), "head_", "left")
    return df.withColumn("tier", F.expr("CASE WHEN t1_ IS NULL OR t2_ = 'auto' THEN t2_ ELSE t1_ END")).drop("exact_", "head_", "t1_", "t2_")


def as_mapping(catalogue: DataFrame, most: int = 20_000) -> dict[str, str]:
    """A catalogue for use in literals; it has a code for each ICD-10 entry at most, and is refused beyond ``most``."""
    rows = catalogue.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("use tier_join for a catalogue of this size")
    return {r["code"]: r["tier"] for r in rows}
