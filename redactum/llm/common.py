"""What the operators share: checked broadcasts, batches, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.workspace import Workspace, delete

#: A side of a join is broadcast only when it has been written and found to have no
#: more rows, and no more bytes in its compressed files, than these.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20

def file_bytes(df: DataFrame) -> int:
    """Bytes of the files of a written table."""
    jvm = df.sparkSession.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(df._redactum_path)
    return where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written table has at most ``rows`` rows (footer counts only) in ``size`` bytes of files."""
    return file_bytes(df) <= size and df.count() <= rows


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast for a written table of proven size; else leaves it to shuffle."""
    return F.broadcast(df) if small_enough(df, rows, size) else df


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def ascii_lower(c: Column) -> Column:
    """A-Z only, as ``lower`` would also fold other letters."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_hash(c: Column, seed: str) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of a seed and a value."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(c.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def in_small_batches(batches: Iterable, rows: int) -> Iterator:
    """Splits Arrow batches so that what one step holds stays bounded."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def numbered(rows: DataFrame, order: list[Column], space: Workspace, name: str = "rank") -> DataFrame:
    """``rows``, written in ``order``, with their place in it from 0 in the column ``name``.

    Ranges of the order are sorted each on its own; a row's place is that in its range, as
    Spark counts rows on in sorted partitions, after the sizes of the ranges before. One
    number a range comes to the driver. No task takes all rows.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    out = space.write(out, "sorted")
    starts, before = [], 0
    for k, n in sorted(out.groupBy(F.shiftright("at_", 33).alias("range")).count().collect()):
        starts.append((k, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(starts, "range_ bigint, start_ bigint"))
    out = out.join(starts, F.shiftright("at_", 33) == F.col("range_"))
    return out.withColumn(name, F.expr(f"start_ + (at_ & {(1 << 33) - 1}L)")).drop("at_", "range_", "start_")


def connected_components(spark: SparkSession, edges: DataFrame, space: Workspace) -> DataFrame:
    """(id, component): the smallest id that the links (a, b) reach, for each linked id.

    Every round hooks each node onto its smallest neighbour, follows one more
    pointer and contracts the edges; edges shrink until none is left. Minima come
    from partial aggregates and joins that adaptive execution may split, so that a
    hub costs no more in one task than its share. Each round is a written table.
    """
    e = space.write(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    labels = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        hook = space.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "hook")
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        parent = space.write(hook.join(up, "p").select("u", F.col("pp").alias("p")), "parent")
        pa = parent.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        pb = parent.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        small = small_enough(parent)
        pa, pb = (F.broadcast(pa), F.broadcast(pb)) if small else (pa, pb)
        following = space.write(
            e.join(pa, "a").join(pb, "b").where("pa <> pb")
            .select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(),
            "edges",
        )
        if labels is None:
            new = parent.select(F.col("u").alias("id"), F.col("p").alias("component"))
        else:
            up = parent.select(F.col("u").alias("component"), "p")
            new = labels.join(F.broadcast(up) if small else up, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        new = space.write(new, "labels")
        space.drop(e, hook, parent, *([labels] if labels is not None else []))
        e, labels = following, new
    if labels is None:
        return spark.createDataFrame([], "id bigint, component bigint")
    return labels
