"""Queries over the given tables, and SQL with the same results.

Where a table lacks identifiers, notes are derived from its rows by the same
concatenation in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.functions.rare_icd10 import RARE_CODES
from redactum.functions import crypto, dates
from redactum.functions.rules import RULES, Rule
from redactum.functions.sql import lit
from redactum.operators import review
from redactum.operators.compliance import findings_table
from redactum.operators.detect import detect, label_counts, merge_sql, run_rules, valid_nhs_sql
from redactum.operators.replace import anonymised_sql
from redactum.operators.risk import assess_risk, empirical_k
from redactum.operators.validate import own_token_sql
from redactum.plans.catalogue import build_catalogue, tier_join
from redactum.plans.pipeline import deidentify_leaves, deidentify_texts, screen, survivors
from redactum.session import ship_package, spread
from redactum.sources.csv import csv_leaves
from redactum.sources.fhir import fhir_leaves
from redactum.sources.formats import detect_format
from redactum.sources.hl7 import hl7_leaves
from redactum.sources.html import html_to_text
from redactum.sources.pages import dominant_font, is_scanned

SECRET = bytes(range(32))
Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "conversations") else df


# Derived notes. ``{k}`` is a BIGINT key; both engines read this SQL.
_NAMES = "['Alice', 'Bruno', 'Carla', 'Dmitri', 'Elena', 'Farid', 'Greta']", "['Moreau', 'Novak', 'Okafor', 'Petrov', 'Quirke', 'Rossi', 'Santos', 'Tanaka', 'Umarov']"
_CODES = "['E75.2', 'I10', 'Q91.0', 'J45.9', 'G71', 'E11.9', 'C81.1', 'Z00.0']"


def _pick(items: str, k: str, spark: bool) -> str:
    n = items.count("'") // 2
    return f"element_at(array({items[1:-1]}), CAST({k} % {n} AS INT) + 1)" if spark else f"({items})[CAST({k} % {n} AS INT) + 1]"


def _pad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS VARCHAR(20)), {n}, '0')"


def note_sql(k: str, spark: bool) -> str:
    """A clinical note of a key."""
    parts = [
        "'Patient name: '", _pick(_NAMES[0], k, spark), "' '", _pick(_NAMES[1], k, spark), "'. MRN: MRN-'", _pad(k, 7), "'. Member id '", _pad(f"{k} % 99991", 6), "'. Seen '",
        f"'20' || {_pad(f'{k} % 24', 2)} || '-' || {_pad(f'{k} % 12 + 1', 2)} || '-' || {_pad(f'{k} % 28 + 1', 2)}", "'. SSN '", _pad(f"{k} % 1000", 3), "'-'", _pad(f"{k} % 100", 2), "'-'", _pad(f"{k} % 10000", 4),
        "'. NINO AB '", _pad(f"{k} % 100", 2), "' 34 56 C. CPR '", _pad(f"{k} % 1000000", 6), "'-'", _pad(f"{k} % 10000", 4), "'. NHS '", _pad(f"{k} % 900 + 100", 3), "' '", _pad(f"{k} % 1000", 3), "' '", _pad(f"{k} * 7 % 10000", 4),
        "'. Passport no '", "'P'", _pad(k, 8), "'. IBAN GB82WEST'", _pad(k, 14), "'. Device serial '", "'SN-'", _pad(k, 5), "'. GMC: '", _pad(k, 7), "'. Ref NWGH-'", _pad(k, 6), "'. ISO 27001 and ZIP area '",
        _pad(f"{k} % 90000 + 10000", 5), "'. Home SW1A '", f"CAST({k} % 10 AS VARCHAR(20))", "'AA. Postcode: '", _pad(f"{k} % 90000 + 10000", 5), "'. ICD '", _pick(_CODES, k, spark), "'. Age '", f"CAST({k} % 40 + 70 AS VARCHAR(20))",
        "'. Occupation: teacher; ethnicity Asian. Seen by Dr '", _pick(_NAMES[0], f"({k} + 3)", spark), "' '", _pick(_NAMES[1], f"({k} + 4)", spark), "' at '", _pick(_NAMES[1], f"({k} + 5)", spark),
        "' Hospital, fingerprint on file. Fax 0161 '", _pad(f"{k} % 1000", 3), "' '", _pad(f"{k} % 10000", 4), "'. Mail u'", f"CAST({k} AS VARCHAR(20))", "'@mail.example.com or http://h'", f"CAST({k} % 50 AS VARCHAR(20))", "'.example.org/x from 10.0.'", f"CAST({k} % 256 AS VARCHAR(20))", "'.7.'",
    ]
    return " || ".join(parts)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of all orders, dealt over the cores: a small file would be one task."""
    keys = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).repartition(spark.sparkContext.defaultParallelism)
    return keys.select("id", F.expr(note_sql("id", True)).alias("text"))


NOTES = f"notes AS (SELECT o_orderkey AS id, {note_sql('o_orderkey', False)} AS text FROM orders)"


def _re2(rule: Rule) -> str:
    """A rule without look-around, for RE2."""
    p = rule.pattern
    for ahead in (r"(?!000|666|9\d{2})", "(?!00)", "(?!0000)", "(?!BG|GB|NK|KN|TN|NT|ZZ)", r"(?<!(?:ISO|IEC|RFC|DIN|ANSI|IEEE|NIST|EN|BS|SP)[\s\/\-])"):
        p = p.replace(ahead, "")
    return ("(?i)" if "i" in rule.flags else "") + p.replace(r"\/", "/")


def _duck(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_AFTER = {
    "SSN": "NOT regexp_matches(value, '^(000|666|9)') AND NOT regexp_matches(value, '^\\d{3}-00') AND NOT value LIKE '%-0000'",
    "UK_NINO": "NOT regexp_matches(upper(value), '^(BG|GB|NK|KN|TN|NT|ZZ)')",
    "POSTCODE_US": "true",
}


def _values(rows: str, text: str, rule: Rule) -> str:
    source = f"regexp_replace({text}, '(ISO|IEC|RFC|DIN|ANSI|IEEE|NIST|EN|BS|SP)[\\s/\\-]\\d{{5}}', '', 'g')" if rule.label == "POSTCODE_US" else text
    return f"SELECT {_duck(rule.label)} AS label, value FROM (SELECT unnest(regexp_extract_all({source}, {_duck(_re2(rule))})) AS value FROM {rows}) WHERE {_AFTER.get(rule.label, 'true')}"


def _rule_counts(df: DataFrame, text: str, labels: list[str]) -> DataFrame:
    spans = run_rules(df, text, "s", labels=labels).select(F.explode("s").alias("s"))
    return spans.groupBy(F.col("s.label").alias("label"), F.col("s.text").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _counts_oracle(rows: str, text: str, labels: list[str], prefix: str = "") -> str:
    parts = [_values(rows, text, r) for r in RULES if r.label in labels]
    return f"{prefix}SELECT label, value, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


_GROUPS = {
    "rules_contact": ["EMAIL", "URL", "IP", "FAX"],
    "rules_national": ["SSN", "UK_NINO", "NATIONAL_ID_DK_CPR", "NATIONAL_ID_ES", "NATIONAL_ID_IT_CF", "NATIONAL_ID_CH_AHV", "NATIONAL_ID_NL_BSN", "IBAN", "PASSPORT"],
    "rules_labelled": ["MRN", "INSURANCE_ID", "ACCOUNT_NUMBER", "LICENSE", "DEVICE_ID", "VEHICLE_VIN", "REFERENCE_ID"],
    "rules_places": ["POSTCODE_UK", "POSTCODE_EU", "POSTCODE_US", "ADDRESS_LINE"],
    "rules_dates": ["DATE", "BIOMETRIC"],
    "rules_quasi": ["INSTITUTION", "ETHNICITY", "OCCUPATION"],
}
_IN_DOCUMENTS = ["EMAIL", "URL", "IP", "SSN", "IBAN", "DATE", "MRN", "POSTCODE_US"]


def _rules_query(labels: list[str]) -> Query:
    return lambda spark, sf: _rule_counts(notes(spark, sf), "text", labels)


def rules_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_counts(_table(spark, sf_dir, "documents").select("text"), "text", _IN_DOCUMENTS)


def rules_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_counts(_table(spark, sf_dir, "pages").select("html"), "html", ["EMAIL", "URL", "IP"])


def rules_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names after an honorific or in a labelled field, as captured."""
    spans = run_rules(notes(spark, sf_dir), "text", "s", labels=["NAME"]).select("text", F.explode("s").alias("s"))
    value = F.expr("substring(text, s.cap_start + 1, s.cap_end - s.cap_start)")
    return spans.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def email_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = run_rules(_table(spark, sf_dir, "documents").select("lang", "text"), "text", "s", labels=["EMAIL"])
    return spans.groupBy("lang").agg(F.sum(F.size("s")).cast("bigint").alias("n"))


def email_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = run_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "s", labels=["EMAIL"])
    return spans.select("doc_id", F.explode("s").alias("s")).select("doc_id", F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("stop"), F.col("s.text").alias("value"))


def _offsets(rows: str, key: str, text: str, rule: Rule) -> str:
    p = _duck(_re2(rule))
    return (
        f"SELECT {key}, start, start + length(value) AS stop, value FROM (SELECT {key}, unnest(list_transform(range(1, len(m) + 1), lambda i: "
        f"{{'value': m[i], 'start': CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT)}}), recursive := true) "
        f"FROM (SELECT {key}, regexp_extract_all({text}, {p}) AS m, regexp_split_to_array({text}, {p}) AS g FROM {rows}) WHERE len(m) > 0)"
    )


_EXTENT_LABELS = ["EMAIL", "URL", "IP"]


def merged_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of merged spans of three rules in pages."""
    df = run_rules(_table(spark, sf_dir, "pages").select("page_id", "html"), "html", "s", labels=_EXTENT_LABELS)
    df = df.select("page_id", F.explode(F.expr(merge_sql("s"))).alias("m"))
    return df.select("page_id", F.col("m.start").cast("bigint").alias("start"), F.col("m.end").cast("bigint").alias("stop"))


def nhs_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr("lpad(CAST((o_orderkey * 104729) % 10000000000 AS STRING), 10, '0')").alias("d"))
    return df.select("o_orderkey", F.expr(valid_nhs_sql("d")).alias("valid"))


_DATE_SHAPES = {
    True: "element_at(array(date_format(o_orderdate, 'yyyy-MM-dd'), date_format(o_orderdate, 'dd/MM/yyyy'), date_format(o_orderdate, 'dd MMM yyyy'), date_format(o_orderdate, 'MMM dd, yyyy')), CAST(o_orderkey % 4 AS INT) + 1)",
    False: "[strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%d %b %Y'), strftime(o_orderdate, '%b %d, %Y')][CAST(o_orderkey % 4 AS INT) + 1]",
}


def shifted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_DATE_SHAPES[True]).alias("token"))
    return df.select("o_orderkey", "token", F.expr(dates.shifted("token", "'DMY'", crypto.date_shift(SECRET))).alias("shifted"), F.expr(dates.year_of("token", "'DMY'")).alias("year"))


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("MRN-"), F.col("c_custkey")).alias("token"))
    return df.select("c_custkey", F.expr(crypto.pseudonym_sql("'MRN'", "token", SECRET)).alias("pseudonym"))


def _pads() -> tuple[str, str]:
    key = SECRET.ljust(64, b"\0")
    return tuple("".join(f"\\x{b ^ p:02X}" for b in key) for p in (0x36, 0x5C))  # type: ignore[return-value]


_TOKENS = {
    True: "explode(array(named_struct('label', 'POSTCODE_US', 'token', lpad(CAST(c_custkey % 100000 AS STRING), 5, '0')), named_struct('label', 'POSTCODE_UK', 'token', concat('SW', c_custkey % 10, 'A ', c_custkey % 10, 'AA')), named_struct('label', 'RARE_DISEASE_ICD', 'token', concat('q', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), '.1')), named_struct('label', 'AGE_OVER_89', 'token', '94'), named_struct('label', 'NAME', 'token', c_name), named_struct('label', 'IBAN', 'token', c_name), named_struct('label', 'OTHER', 'token', c_name))) AS x",
}


def anonymised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "customer").selectExpr("c_custkey", _TOKENS[True]).select("c_custkey", "x.label", "x.token")
    return df.select("c_custkey", "label", F.expr(anonymised_sql("label", "token", "'DMY'")).alias("value"))


_RETAINED = "filter(array(IF(c_custkey % 2 = 0, 'RARE_DISEASE_ICD', NULL), IF(c_custkey % 3 = 0, 'INSTITUTION', NULL), IF(c_custkey % 5 = 0, 'OCCUPATION', NULL), IF(c_custkey % 7 = 0, 'ETHNICITY', NULL)), x -> x IS NOT NULL)"


def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"transform({_RETAINED}, x -> named_struct('label', x))").alias("retained"), F.expr("CAST(array() AS array<struct<label:string>>)").alias("none"))
    return assess_risk(df, "none").select("c_custkey", "risk.level", F.col("risk.k").cast("bigint").alias("k"), F.col("risk.l").cast("bigint").alias("l"))


_SCREENED = {
    "note": "CASE s_suppkey % 4 WHEN 0 THEN 'The weather was fine.' WHEN 1 THEN 'Write to u' || s_suppkey || '@mail.example.com today.' WHEN 2 THEN 'A new treatment began.' ELSE 'The patient wrote from u' || s_suppkey || '@mail.example.com today.' END",
}


def compliance_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_SCREENED["note"]).alias("text"))
    return screen(df, "EU").select("s_suppkey", "compliance.verdict", F.col("compliance.health_data").alias("health"), F.size("compliance.findings").cast("bigint").alias("findings"), F.col("compliance.ai_upload.safe").alias("ai_safe"))


def compliance_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_SCREENED["note"]).alias("text"))
    return findings_table(screen(df, "US"), "s_suppkey").withColumn("count", F.col("count").cast("bigint"))


_CODE = {True: "concat(element_at(array('E', 'G', 'Q', '9'), CAST(p_partkey % 4 AS INT) + 1), lpad(CAST(p_size AS STRING), 2, '0'), '.', p_partkey % 3, '+')", False: "['E', 'G', 'Q', '9'][CAST(p_partkey % 4 AS INT) + 1] || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.' || CAST(p_partkey % 3 AS VARCHAR) || '+'"}
_CLASSES = "['<1 / 1 000 000', '1-9 / 1 000 000', '1-9 / 100 000', '1-5 / 10 000', 'Unknown']"


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    aligned = part.selectExpr("CAST(p_partkey % 500 AS STRING) AS orpha", f"{_CODE[True]} AS icd10")
    prevalent = part.selectExpr("CAST(p_partkey % 450 AS STRING) AS orpha", f"{_pick(_CLASSES, '(p_partkey + p_size)', True)} AS class")
    return build_catalogue(aligned, prevalent)


_CATALOGUE = (
    f"aligned AS (SELECT CAST(p_partkey % 500 AS VARCHAR) AS orpha, {_CODE[False]} AS icd10 FROM part), "
    f"rare AS (SELECT orpha, min(n) AS n FROM (SELECT CAST(p_partkey % 450 AS VARCHAR) AS orpha, CASE {_pick(_CLASSES, '(p_partkey + p_size)', False)} WHEN '<1 / 1 000 000' THEN 0.5 WHEN '1-9 / 1 000 000' THEN 5 WHEN '1-9 / 100 000' THEN 50 WHEN '1-5 / 10 000' THEN 300 END AS n FROM part) WHERE n IS NOT NULL GROUP BY orpha HAVING min(n) <= 100), "
    "catalogue AS (SELECT code, min(tier) AS tier FROM (SELECT split_part(upper(icd10), '+', 1) AS code, CASE WHEN n <= 10 THEN 'auto' ELSE 'flag' END AS tier FROM aligned JOIN rare USING (orpha)) WHERE regexp_matches(code, '^[A-Z][0-9][0-9]') GROUP BY code)"
)


def rare_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogue(spark, sf_dir)


def rare_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(element_at(array('e', 'G', 'Q', 'Z'), CAST(p_partkey % 4 AS INT) + 1), lpad(CAST(p_size AS STRING), 2, '0'), '.', p_partkey % 2) AS code")
    return tier_join(codes, _catalogue(spark, sf_dir)).select("p_partkey", "tier")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(html_to_text("html").cast("binary")).alias("text_md5"))


def _page_text_oracle() -> str:
    from redactum.sources.html import TEXT_STEPS

    x = "html"
    for p, by in TEXT_STEPS:
        by_sql = _duck(by) if "\n" not in by else f"repeat(chr(10), {by.count(chr(10))})"
        x = f"regexp_replace({x}, {_duck(p)}, {by_sql}, 'g')"
    return f"SELECT page_id, md5(regexp_replace({x}, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')) AS text_md5 FROM pages"


_BODY = "CASE CAST({k} % 4 AS INT) WHEN 0 THEN 'MSH|^~' WHEN 1 THEN '  {{\"resourceType\": \"Patient\"' WHEN 2 THEN '{{\"a\": 1}}' ELSE 'text' END"


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "concat('f', c_custkey, element_at(array('.hl7', '.dcm', '.json', '.pdf', '.docx', '.tsv', '.md', '.xyz', ''), CAST(c_custkey % 9 AS INT) + 1))"
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(name).alias("filename"), F.expr(_BODY.format(k="c_custkey")).alias("content"))
    return df.select("c_custkey", detect_format().alias("format"))


def reviewed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans left after every second document's e-mail addresses are dismissed."""
    df = run_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "s", labels=["EMAIL", "IP"])
    spans = review.span_rows(df, "doc_id", "s")
    dismissed = spans.where("label = 'EMAIL' AND doc_id % 2 = 0")
    return review.dismiss(spans, dismissed, "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def empirical_k_anonymity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return empirical_k(_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"]).select("c_custkey", "k_records")


def own_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "element_at(array('[NAME]', '[MRN-0A1B2C3D]', '90+', '1999', '[name]', '19999', 'x [NAME]', '[MRN-0A1B2]'), CAST(c_custkey % 8 AS INT) + 1) AS token")
    return df.select("c_custkey", F.expr(own_token_sql("token")).alias("own"))


_FHIR = {
    "spark": "concat('{\"resourceType\": \"Patient\", \"id\": \"p', c_custkey, '\", \"gender\": \"x\", \"name\": [{\"family\": \"', c_name, '\", \"given\": [\"A', c_custkey, '\"]}], \"address\": [{\"city\": \"', c_mktsegment, '\"}], \"link\": {\"reference\": \"Patient/', c_nationkey, '\"}}')",
}


def fhir_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_FHIR["spark"]).alias("content"))
    return fhir_leaves(df, "c_custkey").select("c_custkey", "locator", "value", "prefix", F.coalesce("forced_label", F.lit("-")).alias("forced"))


_HL7 = "concat('MSH|^~\\\\&|A|B\\rPID|1||', c_custkey, '||', c_name, '^Ann^^|||||', '|', c_mktsegment, '&x^Town\\rEVN|skip')"


def hl7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_HL7).alias("content"))
    return hl7_leaves(df, "c_custkey").select("c_custkey", "locator", "value", F.coalesce("forced_label", F.lit("-")).alias("forced"))


_CSV = "'family,address.city,note' || chr(10) || c_name || ',' || c_mktsegment || ',' || chr(10) || '\"x, y\",,n' || c_custkey"


def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_CSV).alias("content"))
    return csv_leaves(df, "c_custkey").select("c_custkey", "locator", "value", F.coalesce("forced_label", F.lit("-")).alias("forced"))


def fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "element_at(array('Times', 'Courier', 'Arial'), CAST(l_linenumber % 3 AS INT) + 1) AS font", "repeat('x', CAST(l_quantity AS INT)) AS text", "CAST(NULL AS STRING) AS error")
    return dominant_font(df, "l_orderkey")


def scanned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "repeat('x', CAST(l_quantity * 2 AS INT)) AS text")
    return is_scanned(df, "l_orderkey")


def label_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by language and label over all documents, all rules merged."""
    return label_counts(detect(_table(spark, sf_dir, "documents").select("lang", "text"), catalogue=RARE_CODES), ["lang"])


def deidentified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = deidentify_texts(docs, "GDPR_ANON", audit=False)
    return out.select("doc_id", F.size("detection.spans").alias("n_spans"), F.size("replacement.replacements").alias("n_replaced"), "replacement.sweeps", "risk.level", "validation.passed", F.col("replacement.text").alias("text"))


def pseudonymised_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deidentify_texts(notes(spark, sf_dir), "GDPR_PSEUDO", SECRET, audit=False)
    return out.select("id", "replacement.date_shift", "replacement.date_hint", "validation.passed", F.col("replacement.text").alias("text"))


def leak_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known values that are still in the anonymised notes: how many, of how many. One of
    three is no identifier and has to survive."""
    base = notes(spark, sf_dir)
    out = deidentify_texts(base, "GDPR_ANON", audit=False).select("id", F.col("replacement.text").alias("text"))
    truths = base.selectExpr("id", "explode(array(concat('u', id, '@mail.example.com'), concat('MRN-', lpad(CAST(id AS STRING), 7, '0')), 'ISO 27001')) AS truth")
    left = survivors(out, truths, "id").agg(F.count(F.lit(1)).alias("survivors"))
    return left.crossJoin(F.broadcast(truths.agg(F.count(F.lit(1)).alias("checked"))))


def conversations_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records of many leaves, turn by turn."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("leaf"), F.col("text").alias("value"), F.lit("").alias("prefix"), F.lit(None).cast("string").alias("forced_label"))
    out = deidentify_leaves(turns, "conv_id", "GDPR_ANON")
    return out.select("conv_id", "leaf", F.size("replacement.replacements").cast("bigint").alias("replaced"), F.col("new_value").alias("text"))


def queries() -> dict[str, Query]:
    named = [
        rules_documents, rules_pages, rules_names, email_by_language, email_offsets, merged_extents, nhs_checksums, shifted_dates, pseudonyms, anonymised_values, risk_levels,
        compliance_verdicts, compliance_findings, rare_catalogue, rare_tiers, page_texts, formats, reviewed_spans, empirical_k_anonymity, own_tokens, fhir_records, hl7_records, csv_records, fonts,
        scanned_records, label_totals, deidentified_documents, pseudonymised_notes, leak_survivors, conversations_leaves,
    ]
    return {name: _rules_query(labels) for name, labels in _GROUPS.items()} | {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    email = next(r for r in RULES if r.label == "EMAIL")
    inner, outer = _pads()
    shift = crypto.date_shift(SECRET)
    some = [r for r in RULES if r.label in _EXTENT_LABELS]
    names = f"SELECT {_pick(_NAMES[0], 'o_orderkey', False)} || ' ' || {_pick(_NAMES[1], 'o_orderkey', False)} AS value FROM orders UNION ALL SELECT {_pick(_NAMES[0], '(o_orderkey + 3)', False)} || ' ' || {_pick(_NAMES[1], '(o_orderkey + 4)', False)} FROM orders"
    digits = "lpad(CAST((o_orderkey * 104729) % 10000000000 AS VARCHAR), 10, '0')"
    total = "+".join(f"CAST(substr(d, {i}, 1) AS INT) * {11 - i}" for i in range(1, 10))
    return {name: _counts_oracle("notes", "text", labels, f"WITH {NOTES} ") for name, labels in _GROUPS.items()} | {
        "rules_documents": _counts_oracle("documents", "text", _IN_DOCUMENTS),
        "rules_pages": _counts_oracle("pages", "html", ["EMAIL", "URL", "IP"]),
        "rules_names": f"SELECT value, count(*) AS n FROM ({names}) GROUP BY value",
        "email_by_language": f"SELECT lang, CAST(sum(len(regexp_extract_all(text, {_duck(_re2(email))}))) AS BIGINT) AS n FROM documents GROUP BY lang",
        "email_offsets": _offsets("documents", "doc_id", "text", email),
        "merged_extents": "WITH s AS (" + " UNION ALL ".join(_offsets("pages", "page_id", "html", r) for r in some) + "), o AS (SELECT *, max(stop) OVER (PARTITION BY page_id ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s), g AS (SELECT *, sum(CASE WHEN before IS NULL OR start >= before THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY start, stop DESC ROWS UNBOUNDED PRECEDING) AS island FROM o) SELECT page_id, min(start) AS start, max(stop) AS stop FROM g GROUP BY page_id, island",
        "nhs_checksums": f"SELECT o_orderkey, (11 - ({total}) % 11) % 11 <> 10 AND (11 - ({total}) % 11) % 11 = CAST(substr(d, 10, 1) AS INT) AS valid FROM (SELECT o_orderkey, {digits} AS d FROM orders)",
        "shifted_dates": f"SELECT o_orderkey, {_DATE_SHAPES[False]} AS token, {_DATE_SHAPES[False].replace('o_orderdate,', f'o_orderdate + INTERVAL ({shift}) DAY,')} AS shifted, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders",
        "pseudonyms": f"SELECT c_custkey, '[MRN-' || upper(substr(sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || encode('MRN:MRN-' || c_custkey)))), 1, 8)) || ']' AS pseudonym FROM customer",
        "anonymised_values": " UNION ALL ".join([
            "SELECT c_custkey, 'POSTCODE_US' AS label, substr(lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0'), 1, 3) || '**' AS value FROM customer",
            "SELECT c_custkey, 'POSTCODE_UK', 'SW' || c_custkey % 10 || 'A ***' FROM customer", "SELECT c_custkey, 'RARE_DISEASE_ICD', 'Q' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') FROM customer",
            "SELECT c_custkey, 'AGE_OVER_89', '90+' FROM customer", "SELECT c_custkey, 'NAME', '[NAME]' FROM customer", "SELECT c_custkey, 'IBAN', '[NATIONAL-ID]' FROM customer", "SELECT c_custkey, 'OTHER', '[OTHER]' FROM customer",
        ]),
        "risk_levels": "WITH r AS (SELECT c_custkey, c_custkey % 2 = 0 AS rare, c_custkey % 3 = 0 AS inst, c_custkey % 5 = 0 AS occ, c_custkey % 7 = 0 AS eth FROM customer), c AS (SELECT *, rare::INT + inst::INT + occ::INT + eth::INT AS n, rare::INT + eth::INT AS s FROM r), k AS (SELECT c_custkey, CAST(CASE WHEN n = 0 THEN 99 ELSE s END AS BIGINT) AS l, CAST(least(CASE n WHEN 0 THEN 10 WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 1 END, CASE WHEN rare OR (inst AND occ) OR (n > 0 AND s < 2) THEN 2 ELSE 99 END) AS BIGINT) AS k FROM c) SELECT c_custkey, CASE WHEN k >= 5 THEN 'LOW' WHEN k >= 3 THEN 'MEDIUM' ELSE 'HIGH' END AS level, k, l FROM k",
        "compliance_verdicts": "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'SAFE' WHEN 3 THEN 'DO_NOT_UPLOAD' ELSE 'NEEDS_DEIDENTIFICATION' END AS verdict, s_suppkey % 4 >= 2 AS health, CAST(s_suppkey % 2 AS BIGINT) AS findings, s_suppkey % 4 = 0 AS ai_safe FROM supplier",
        "compliance_findings": "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 3 THEN 'DO_NOT_UPLOAD' ELSE 'NEEDS_DEIDENTIFICATION' END AS verdict, 'EMAIL' AS label, CAST(1 AS BIGINT) AS count, 'MEDIUM' AS severity FROM supplier WHERE s_suppkey % 2 = 1",
        "rare_catalogue": f"WITH {_CATALOGUE} SELECT code, tier FROM catalogue",
        "rare_tiers": f"WITH {_CATALOGUE}, c AS (SELECT p_partkey, upper(['e', 'G', 'Q', 'Z'][CAST(p_partkey % 4 AS INT) + 1] || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.' || CAST(p_partkey % 2 AS VARCHAR)) AS code FROM part) SELECT p_partkey, CASE WHEN a.tier IS NULL OR b.tier = 'auto' THEN b.tier ELSE a.tier END AS tier FROM c LEFT JOIN catalogue a ON a.code = c.code LEFT JOIN catalogue b ON b.code = substr(c.code, 1, 3)",
        "page_texts": _page_text_oracle(),
        "formats": "SELECT c_custkey, CASE CAST(c_custkey % 9 AS INT) WHEN 0 THEN 'HL7_V2' WHEN 1 THEN 'DICOM' WHEN 2 THEN CASE WHEN c_custkey % 4 = 1 THEN 'FHIR_R4' ELSE 'TEXT' END WHEN 3 THEN 'PDF_TYPED' WHEN 4 THEN 'DOCX' WHEN 5 THEN 'CSV' WHEN 6 THEN 'TEXT' ELSE CASE c_custkey % 4 WHEN 0 THEN 'HL7_V2' WHEN 1 THEN 'FHIR_R4' ELSE 'TEXT' END END AS format FROM customer",
        "reviewed_spans": f"SELECT label, count(*) AS n FROM (SELECT 'EMAIL' AS label, doc_id, unnest(regexp_extract_all(text, {_duck(_re2(email))})) AS v FROM documents UNION ALL " + " UNION ALL ".join(f"SELECT 'IP', doc_id, unnest(regexp_extract_all(text, {_duck(_re2(r))})) FROM documents" for r in RULES if r.label == "IP") + ") WHERE NOT (label = 'EMAIL' AND doc_id % 2 = 0) GROUP BY label",
        "empirical_k_anonymity": "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS k_records FROM customer",
        "own_tokens": "SELECT c_custkey, c_custkey % 8 < 4 AS own FROM customer",
        "fhir_records": "SELECT c_custkey, locator, value, prefix, forced FROM (SELECT c_custkey, unnest([{'locator': 'id', 'value': 'p' || c_custkey, 'prefix': '', 'forced': '-'}, {'locator': 'name[0].family', 'value': c_name, 'prefix': '', 'forced': 'NAME'}, {'locator': 'name[0].given[0]', 'value': 'A' || c_custkey, 'prefix': '', 'forced': 'NAME'}, {'locator': 'address[0].city', 'value': c_mktsegment, 'prefix': '', 'forced': 'ADDRESS_LINE'}, {'locator': 'link.reference', 'value': CAST(c_nationkey AS VARCHAR), 'prefix': 'Patient/', 'forced': '-'}], recursive := true) FROM customer)",
        "hl7_records": "SELECT c_custkey, locator, value, forced FROM (SELECT c_custkey, unnest([{'locator': '1.0.0.0.0', 'value': '1', 'forced': '-'}, {'locator': '1.2.0.0.0', 'value': CAST(c_custkey AS VARCHAR), 'forced': '-'}, {'locator': '1.4.0.0.0', 'value': c_name, 'forced': 'NAME'}, {'locator': '1.4.0.1.0', 'value': 'Ann', 'forced': 'NAME'}, {'locator': '1.10.0.0.0', 'value': c_mktsegment, 'forced': 'ADDRESS_LINE'}, {'locator': '1.10.0.0.1', 'value': 'x', 'forced': 'ADDRESS_LINE'}, {'locator': '1.10.0.1.0', 'value': 'Town', 'forced': 'ADDRESS_LINE'}], recursive := true) FROM customer)",
        "csv_records": "SELECT c_custkey, locator, value, forced FROM (SELECT c_custkey, unnest([{'locator': '0.0', 'value': c_name, 'forced': 'NAME'}, {'locator': '0.1', 'value': c_mktsegment, 'forced': 'ADDRESS_LINE'}, {'locator': '1.0', 'value': 'x, y', 'forced': 'NAME'}, {'locator': '1.2', 'value': 'n' || c_custkey, 'forced': '-'}], recursive := true) FROM customer)",
        "fonts": "WITH f AS (SELECT l_orderkey, ['serif', 'mono', 'sans'][CAST(l_linenumber % 3 AS INT) + 1] AS family, sum(CAST(floor(l_quantity) AS BIGINT)) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, arg_max(family, n * 4 + CASE family WHEN 'serif' THEN 3 WHEN 'mono' THEN 2 ELSE 1 END) AS family FROM f GROUP BY l_orderkey",
        "scanned_records": "SELECT l_orderkey, avg(CAST(floor(l_quantity * 2) AS BIGINT)) < 60 AND max(CAST(floor(l_quantity * 2) AS BIGINT)) < 120 AS scanned FROM lineitem GROUP BY l_orderkey",
        "leak_survivors": f"WITH {NOTES} SELECT count(*) FILTER (contains(text, 'ISO 27001')) AS survivors, 3 * count(*) AS checked FROM notes",
    }
