"""Embedding near-duplicates by sorted projection passes.

Equal vectors are one class. Each pass orders the classes of a label by the bits of
random hyperplanes, most significant first, and compares every vector with the few
that stand next to it. Verified pairs of all passes are united to components. The
number of passes follows from the data: enough that a pair at the threshold is missed
by all of them with a chosen small probability.

Windows are bounded, so a crowd is linked along its order only; the count of direct
links is then taken exactly within each component, block against block, and only
counts leave the tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactum.llm.common import Workspace, checked_broadcast, connected_components, in_small_batches

THRESHOLD = 0.93
#: Neighbours after each vector that a pass compares it with.
WINDOW = 64
BITS = 63
#: Chance that all passes miss a pair at the threshold.
MISS = 1e-3
#: Passes whose copies of the vectors are on disk at a time.
AT_ONCE = 3
#: Vectors of a block; two blocks meet in one task, so that each vector travels once per block of its group.
BLOCK = 4096


def prefix_bits(rows: int, window: int = WINDOW) -> int:
    """Leading bits that vectors share in a run; no more than ``passes_for`` reckons with."""
    return int(max(1.0, math.log2(max(2.0, rows / window)) + 1))


def passes_for(rows: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold is missed with probability ``miss``.

    Two vectors surely meet if they share the leading bits that leave no more evenly
    spread vectors than a window: log2(rows / window) + 1 bits, each equal with
    probability 1 - angle / pi. Where more share them, blocks compare them all.
    """
    bits = max(1.0, math.log2(max(2.0, rows / window)) + 1)
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return max(4, math.ceil(math.log(miss) / math.log(1 - p)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(column: pa.Array, dim: int, n: int) -> np.ndarray:
    """(rows x passes) order keys."""
    x = _matrix(column, dim)
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    out = np.empty((len(x), n), np.int64)
    for p in range(n):
        planes = np.random.Generator(np.random.PCG64([p, dim])).standard_normal((dim, BITS))
        out[:, p] = ((x @ planes) > 0) @ weights
    return out


def _segments(b: pa.RecordBatch, names: list[str]):
    """(key, slice) for runs of equal values."""
    cols = [b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
    if not b.num_rows:
        return
    change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if b.num_rows > 1 else []
    ends = [*change, b.num_rows]
    start = 0
    for end in ends:
        yield tuple(int(c[start]) for c in cols), b.slice(start, end - start)
        start = end


def _windows(batches, window: int, threshold: float):
    """Edges of spanning forests of the verified pairs within windows of the sorted rows."""
    key, tail, tail_ids = None, None, None
    for batch in in_small_batches(batches, 1024):
        a, b_ = [], []
        for k, s in _segments(batch, ["label", "dim", "pass"]):
            x = _matrix(s.column(s.schema.get_field_index("v")), k[1])
            ids = s.column(s.schema.get_field_index("rep")).to_numpy()
            if k != key:
                key, tail, tail_ids = k, np.zeros((0, k[1])), np.zeros(0, np.int64)
            both, every = np.concatenate([tail, x]), np.concatenate([tail_ids, ids])
            old = len(tail)
            close = (x @ both.T) >= threshold
            own = np.arange(len(every))
            comp = own.copy()
            for i in np.flatnonzero(close.sum(axis=1) > 1):
                at = old + i
                lo = max(0, at - window)
                js = lo + np.flatnonzero(close[i, lo:at])
                while len(js := js[comp[js] != comp[at]]):
                    j = js[0]
                    a.append(int(every[at]))
                    b_.append(int(every[j]))
                    comp[comp == comp[j]] = comp[at]
            tail, tail_ids = both[-window:], every[-window:]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b_, pa.int64())], names=["a", "b"])


def _forests(batches, threshold: float):
    """Edges of spanning forests of the verified pairs of two blocks of a run (sides 0 and 1), or of one (side 2)."""
    held: list = []
    key = None

    def edges():
        x = np.concatenate([_matrix(s.column(s.schema.get_field_index("v")), key[2]) for s in held])
        side, rep = (np.concatenate([s.column(s.schema.get_field_index(c)).to_numpy() for s in held]) for c in ("side", "rep"))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        comp = np.arange(len(rep))
        a, b = [], []
        for i in range(0, len(left), 512):
            close = (x[left[i : i + 512]] @ x[right].T) >= threshold
            for at, row in zip(left[i : i + 512], close, strict=True):
                js = right[row]
                while len(js := js[comp[js] != comp[at]]):
                    a.append(int(rep[at]))
                    b.append(int(rep[js[0]]))
                    comp[comp == comp[js[0]]] = comp[at]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for k, s in _segments(batch, ["pass", "label", "dim", "run", "i", "j"]):
            if k != key:
                if held:
                    yield edges()
                held, key = [], k
            held.append(s)
    if held:
        yield edges()


def _counts(batches, threshold: float):
    """Per row the weight of the linked rows of its group; groups span batches."""
    held: list = []
    key = None

    def counted():
        dim = key[3]
        x = np.concatenate([_matrix(s.column(s.schema.get_field_index("v")), dim) for s in held])
        side, rep, n = (np.concatenate([s.column(s.schema.get_field_index(c)).to_numpy() for s in held]) for c in ("side", "rep", "n"))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        total = np.zeros(len(rep), np.int64)
        for i in range(0, len(left), 512):
            rows = left[i : i + 512]
            close = (x[rows] @ x[right].T) >= threshold
            close &= rep[rows][:, None] != rep[right][None, :]
            total[rows] += close @ n[right]
            if (side[rows] == 0).any():
                np.add.at(total, right, n[rows] @ close)
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(total)], names=["rep", "linked"])

    for batch in batches:
        for k, s in _segments(batch, ["component", "i", "j", "dim"]):
            if k != key:
                if held:
                    yield counted()
                held, key = [], k
            held.append(s)
    if held:
        yield counted()


def _in_blocks(rows: DataFrame, group: list[str], *more: str) -> DataFrame:
    """Rows of a group with ``blocks`` as pairs of blocks (i, j), each with each: side 0 is of i, 1 of j, 2 of both."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)
    return rows.select(*group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "rep", *more, "v")


def embedding_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) for each row.

    Rows link if their labels are equal, they have the same length and their cosine in
    double precision is at least ``threshold``. Rows with a null key or label, and
    vectors that are null, empty, zero or hold null or non-finite components, link with
    nothing: n_links 0 and their own key as component_id. n_links counts other rows,
    repeated rows included. Rows that share a key are one node of the graph. Keys and
    labels are whole numbers: one that is none fails the cast, and the run.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "embeddings")
    # Vectors travel in their own precision and are compared in double.
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"), F.col(f"`{vector}`").cast(kind).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite, F.lit(False)))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    classes = rows.where("ok").groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = space.write(classes.withColumn("dim", F.size("v")), "classes")
    most = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    n_passes = passes_for(most, threshold, window, miss)

    def keyed(batches):
        for b in in_small_batches(batches, 2048):
            dims = b.column(3).to_numpy()
            keys = np.empty((b.num_rows, n_passes), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                keys[at] = _keys(b.column(2).take(pa.array(at)), int(d), n_passes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(keys), pa.list_(pa.int64()))], names=["label", "rep", "v", "dim", "keys"])

    keys = space.write(classes.select("label", "rep", "v", "dim").mapInArrow(keyed, f"label bigint, rep bigint, v {kind}, dim int, keys array<bigint>"), "keys")
    shift = BITS - prefix_bits(most, window)
    run = ["pass", "label", "dim", "run"]
    edges = None
    for first in range(0, n_passes, AT_ONCE):
        some = F.array(*[F.struct(F.lit(p).alias("pass"), F.get("keys", F.lit(p)).alias("k")) for p in range(first, min(first + AT_ONCE, n_passes))])
        laid = keys.select("label", "dim", "rep", "v", F.inline(some)).select("pass", "label", "dim", "k", "rep", "v").withColumn("run", F.shiftright("k", shift))
        long = laid.groupBy(*run).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > window)
        long = space.write(long.select(*run, F.ceil(F.col("rows") / block).cast("int").alias("blocks")), "runs")
        small = checked_broadcast(long)
        # A run stays in one partition, since its rows are equal in what the ranges are made of.
        short = laid.join(small.select(*run), run, "left_anti").repartitionByRange(*run).sortWithinPartitions(*run, "k", "rep")
        pairs = short.select("pass", "label", "dim", "k", "rep", "v").mapInArrow(lambda b: _windows(b, window, threshold), "a bigint, b bigint")
        crowds = _in_blocks(laid.join(small, run), run).repartition(*run, "i", "j").sortWithinPartitions(*run, "i", "j")
        met = crowds.mapInArrow(lambda b: _forests(b, threshold), "a bigint, b bigint")
        found = space.write(pairs.union(met).distinct(), "pairs")
        space.drop(long)
        edges = found if edges is None else edges.union(found)
    space.drop(keys)
    components = space.write(connected_components(spark, edges, space).withColumnRenamed("id", "rep"), "components")

    # Exact counts of direct links: within a component every block meets every other.
    inside = classes.select("rep", "n", "dim", "v").join(checked_broadcast(components), "rep")
    sizes = space.write(components.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "sizes")
    groups = ["component", "i", "j", "dim"]
    inside = _in_blocks(inside.join(checked_broadcast(sizes), "component"), ["component", "dim"], "n")
    counted = inside.repartition("component", "i", "j").sortWithinPartitions(*groups).mapInArrow(lambda b: _counts(b, threshold), "rep bigint, linked bigint")
    linked = space.write(counted.groupBy("rep").agg(F.sum("linked").alias("linked")), "linked")
    space.drop(sizes)

    owners = classes.select("label", "h1", "h2", "rep", "n").join(components, "rep", "left").join(linked, "rep", "left")
    owners = owners.select("label", "h1", "h2", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("ok"))
    out = rows.select("id", "label", "h1", "h2", "ok").join(owners, ["label", "h1", "h2", "ok"], "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(f"`{key}`") == F.col("component_id"), F.lit(True)))
