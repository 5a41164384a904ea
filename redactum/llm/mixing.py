"""Mixing sources to target weights.

Sizes are aggregated per source, targets are levelled under each source's cap and
divided by the size to a repetition rate; a document then appears ``floor(rate)``
times and once more with the fraction's probability, decided by a hash of the seed,
its id and its text, so that reruns agree. Only sizes and names are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactum.llm.common import Workspace, checked_broadcast, numbered, unit_hash

#: Sources take these weights in the order of their names, again and again.
WEIGHTS = (3, 1, 2)
#: The mix's size in hundredths of the whole, and the most of a source it may take.
TOTAL_PERCENT = 150
MOST_TIMES = 2
SEED = "mix-1"
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than blank and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = TOTAL_PERCENT, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target) from (source, size), written.

    One row per source is left after the aggregate. Sources are numbered over ranges of
    their names. Then what the sources above their cap leave is shared by weight among
    the others until none is above: each round is one aggregate to two numbers, and a
    source that is capped stays so, as the level only rises. A source of null stands
    last; sizes of 0 give targets of 0.
    """
    space = Workspace(sizes.sparkSession, "mix")
    totals = space.write(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    ranked = numbered(totals, [F.col("source").asc_nulls_last()], space)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = space.write(ranked.select("source", "source_size", weight.cast("bigint").alias("w")), "weighed")
    cap = F.col("source_size") * most
    whole, shares = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("w")).first()
    left, capped = whole * (percent / 100.0), 0
    while shares:
        full = F.lit(left) * F.col("w") / F.lit(shares) >= cap
        n, taken, others = t.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.sum(F.when(~full, F.col("w")))).first()
        if n == capped:
            break
        left, shares, capped = whole * (percent / 100.0) - taken, others, n
    share = F.lit(left) * F.col("w") / F.lit(shares) if shares else cap.cast("double")
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(share, cap.cast("double")))
    return space.write(t.select("source", "source_size", target.alias("target")), "targets")


def plan_mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = SEED, **how) -> DataFrame:
    """(key, source, size, source_size, target, copies): how often each row enters the mix.

    Null texts have size 0. Rows equal in key and text share their draw, other rows of one
    key or of none do not. An empty table gives an empty plan. Extra columns are not
    looked at.
    """
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), _draw(key, text).alias("draw_"))
    return _with_copies(rows, source_targets(rows.select("source", "size"), **how), seed)


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = SEED, **how) -> DataFrame:
    """The mix itself: every row as often as its source's rate says, with ``copy`` from 0.

    All columns of ``docs`` stay; one named ``copy`` is replaced.
    """
    names = [c for c in docs.columns if c != "copy"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(f"`{source}`").alias("source"), _draw(key, text).alias("draw_"))
    sizes = docs.select(F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    out = _with_copies(rows, source_targets(sizes, **how), seed)
    out = out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return out.select(*[F.col("doc").getField(c).alias(c) for c in names], F.col("copy").cast("int").alias("copy"))


def _draw(key: str, text: str) -> Column:
    """What decides a row's draw: its key and its text, so that rows of one key or of none draw apart."""
    return F.concat_ws(":", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))


def _with_copies(rows: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    named = checked_broadcast(targets).withColumnRenamed("source", "source_")
    out = rows.join(named, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (unit_hash(F.col("draw_"), seed) < rate - F.floor(rate)).cast("int")
    return out.withColumn("copies", (F.floor(rate) + extra).cast("int")).drop("draw_")
