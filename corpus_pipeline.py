"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All
but the last return the columns of ``documents``; the last adds ``copy``. ``run``
writes each stage's rows to the shared folder, reads them again for the next and drops
them once that has written its own.

Any column of a row may be null, texts may be empty or very long, rows may be repeated
and tables empty; what happens to such rows is said with each stage. An empty table
gives an empty one, extra columns do not pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.llm import decontaminate, line_dedup, minhash, mixing, quality
from redactum.llm.common import Workspace
from redactum.session import ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier accepts; all labelled rows may teach it.

    Null and empty texts are scored as empty ones, rows of a null id as any other, and
    repeated rows alike. Without a label or a document to learn from all scores are 0.5
    and every row stays. Texts are read whole.
    """
    good = quality.trusted(_table(spark, sf_dir, "labels"))
    scored = quality.score(docs, quality.train(docs, good))
    return scored.where(F.col("score") >= quality.ACCEPT).select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; a document all of whose lines are repeats goes.

    Of equal lines the one of the smallest id stays (null last; then by a hash of the
    text, then by place). Null texts and texts without lines that have words stay as they
    are. Rows equal in id and text are treated alike: the next stage makes them one.
    n_chars is counted anew where lines went.
    """
    ship_package(spark)
    out = line_dedup.dedup_lines(docs).where("n_lines = 0 OR n_removed < n_lines")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*COLUMNS)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group: five-word shingles, similarity 0.8 or more.

    Null ids come last; of rows of one id or of none that of the smallest text hash
    stays, of equal rows one. Null texts and texts without words are in no group and stay.
    """
    ship_package(spark)
    return minhash.keep_first(docs, words=5, num=4, den=5).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves contaminated documents out.

    Null texts and texts without words are clean; each row is judged on its own, whatever
    its id; without benchmark items all rows stay.
    """
    out = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return out.where("NOT contaminated").select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the sources' target weights.

    A source of null is one source, the last. A source without words takes nothing, so
    its documents go; null and empty texts of other sources are repeated at their
    source's rate. Rows equal in id and text share a draw.
    """
    ship_package(spark)
    return mixing.mix(docs).select(*COLUMNS, "copy")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: The first three stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*COLUMNS)
    space = Workspace(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, space.write(stage(spark, docs, sf_dir), name.split()[0].lower())
        if i:
            space.drop(before)
    return docs
