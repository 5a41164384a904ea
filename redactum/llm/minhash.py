"""MinHash near-duplicates with sequential Bayesian verification.

Texts become sets of word shingles; equal sets are one class. Signatures of the
classes are cut into bands; classes that agree in a band are candidates. A pair's
signatures are compared a batch at a time: it is dropped once the posterior
probability that its similarity reaches the threshold falls below a chosen miss
probability; what survives is confirmed on the full sets.

A bucket is never expanded into all its pairs. Its members first meet its smallest
member; what that links is contracted to components. Only in buckets that still hold
several components do blocks of members meet each other, in tasks that return the
links of a spanning forest and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactum.llm.common import Workspace, checked_broadcast, connected_components, in_small_batches

#: Values of a signature, and those compared at a time.
HASHES = 128
BATCH = 32
#: Chances that a pair at the threshold shares no band, and that a batch drops it.
MISS_BANDS = 1e-4
MISS_BATCH = 1e-5
#: Members that meet in one task on either side, and bytes of their sets: a set travels once per block of its bucket.
BLOCK = 2048
BLOCK_BYTES = 16 << 20
#: Words whose hashes a Python worker keeps; the store is emptied when full.
CACHE_WORDS = 300_000

_M = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float, hashes: int = HASHES, miss: float = MISS_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose chance to miss a pair at the threshold is at most ``miss``."""
    for rows in range(hashes, 1, -1):
        bands = hashes // rows
        if (1 - threshold**rows) ** bands <= miss:
            return bands, rows
    return hashes, 1


def least_matches(threshold: float, n: int, miss: float = MISS_BATCH) -> int:
    """The fewest equal values among n for which P(similarity >= threshold) is at least ``miss``.

    With a uniform prior the posterior after m of n is Beta(m + 1, n - m + 1), whose
    tail is a sum of binomial terms.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Sketcher:
    """Shingle sets, fingerprints, signatures and band keys of texts."""

    def __init__(self, words: int, bands: int, rows: int, hashes: int = HASHES):
        draw = np.random.Generator(np.random.PCG64(7))
        self.words, self.bands, self.rows = words, bands, rows
        self.a = draw.integers(0, 1 << 63, hashes, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, hashes, np.uint64)[:, None]
        self.seen = WordHashes()

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles; of all words if there are fewer; none without words."""
        words = (text or "").encode().lower().split()
        n, k = len(words), self.words
        if not n:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.seen.__getitem__, words), np.uint64, n)
        if n < k:
            h = np.full(1, n, np.uint64)
            for x in w:
                h = _mixed(h * _M + x)
            return h
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h = _mixed(h * _M + w[i : n - k + 1 + i])
        return np.unique(h)

    def signature(self, items: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint64)
        for i in range(0, len(items), 1024):
            x = items[i : i + 1024] * self.a
            x += self.b
            x >>= np.uint64(32)
            np.minimum(out, x.min(axis=1), out=out)
        return out

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        s = signature[: self.bands * self.rows].reshape(self.bands, self.rows)
        h = np.arange(1, self.bands + 1, dtype=np.uint64)
        for i in range(self.rows):
            h = _mixed(h * _M + s[:, i])
        return h.view(np.int64)


def fingerprint(items: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(items.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Verifier:
    """Links within groups of rows (side, node, component, signature, items)."""

    def __init__(self, num: int, den: int, hashes: int = HASHES, batch: int = BATCH, miss: float = MISS_BATCH):
        self.num, self.den = num, den
        self.steps = [(n, least_matches(num / den, n, miss)) for n in range(batch, hashes + 1, batch)]
        self.batch = batch

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = np.sort(np.concatenate((a, b)), kind="stable")
        inter = int((both[1:] == both[:-1]).sum())
        return self.den * inter >= self.num * (len(a) + len(b) - inter)

    def links(self, rows: list[tuple]) -> Iterator[tuple[int, int]]:
        """A spanning forest of the links between different components across the sides.

        Side 0 meets side 1; side 2 meets itself.
        """
        sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(len(rows), -1)
        items = [np.frombuffer(r[4], np.uint64) for r in rows]
        size = np.array([len(x) for x in items])
        comp = np.array([r[2] for r in rows])
        side = np.array([r[0] for r in rows])
        for i in np.flatnonzero(side != 1):
            fits = (side == 1) if side[i] == 0 else (np.arange(len(rows)) > i)
            fits &= (comp != comp[i]) & (self.den * np.minimum(size, size[i]) >= self.num * np.maximum(size, size[i]))
            at = np.flatnonzero(fits)
            equal = np.zeros(len(at), np.int64)
            for n, least in self.steps:
                if not len(at):
                    break
                cols = slice(n - self.batch, n)
                equal += (sig[at, cols] == sig[i, cols]).sum(axis=1)
                ok = equal >= least
                at, equal = at[ok], equal[ok]
            for j in at[np.argsort(-equal, kind="stable")]:
                if comp[j] != comp[i] and self.similar(items[i], items[j]):
                    yield rows[i][1], rows[j][1]
                    comp[comp == comp[j]] = comp[i]


def _grouped(batches, keys: int) -> Iterator[list[tuple]]:
    """The rows of each group, without the keys, of batches that are sorted by their first columns."""
    held: list[tuple] = []
    key = None
    for b in in_small_batches(batches, 500):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != key:
                if held:
                    yield held
                held, key = [], row[:keys]
            held.append(row[keys:])
    if held:
        yield held


_EDGES = "a bigint, b bigint"


def _edges_of(rows: DataFrame, keys: int, verifier: Verifier) -> DataFrame:
    def run(batches):
        a, b = [], []
        for group in _grouped(batches, keys):
            for x, y in verifier.links(group):
                a.append(x)
                b.append(y)
            if len(a) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    names = rows.columns[:keys]
    return rows.repartition(*names).sortWithinPartitions(*names, "side").mapInArrow(run, _EDGES)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 4, den: int = 5, hashes: int = HASHES, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``.

    Rows link if den * |intersection| >= num * |union| of their sets of ``words``-word
    shingles (words are runs without ASCII white space, A-Z lower-cased; a shorter text
    is one shingle). component_id is the smallest key that links reach. Null and empty
    texts have no shingles and link with nothing. Rows that share a key are one node of
    the graph. A null key never is a representative: its row gets the component of its
    class if another row of equal set has a key, else null; it is kept if null. Keys are
    whole numbers: one that is none fails the cast, and the run.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "minhash")
    bands, rows = banding(num / den, hashes)
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))

    def sketch(batches):
        s = Sketcher(words, bands, rows, hashes)
        for b in in_small_batches(batches, 500):
            h1, h2, n, keys = [], [], [], []
            for t in b.column(1):
                items = s.shingles(t.as_py())
                one, two = fingerprint(items)
                h1.append(one)
                h2.append(two)
                n.append(len(items))
                keys.append(s.band_keys(s.signature(items)) if len(items) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "h1", "h2", "n", "bands"])

    base = space.write(texts.mapInArrow(sketch, "id bigint, h1 bigint, h2 bigint, n bigint, bands array<bigint>"), "sketches")
    classes = space.write(base.where("n > 0 AND id IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("n").alias("n")), "classes")
    buckets = classes.select(F.explode("bands").alias("k"), "rep", "n")
    shared = space.write(buckets.groupBy("k").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last").drop("last"), "shared")
    members = space.write(buckets.join(checked_broadcast(shared), "k"), "members")
    stars = space.write(members.where("rep <> head").select("rep", "head").distinct(), "stars")
    nodes = space.write(stars.select(F.col("rep").alias("node")).union(stars.select("head")).distinct(), "nodes")

    def rebuild(batches):
        s = Sketcher(words, bands, rows, hashes)
        for b in in_small_batches(batches, 200):
            sig, sets = [], []
            for t in b.column(1):
                items = s.shingles(t.as_py())
                sig.append(s.signature(items).astype(np.uint16).tobytes())
                sets.append(items.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sig, pa.binary()), pa.array(sets, pa.binary())], names=["node", "sig", "items"])

    wanted = texts.join(checked_broadcast(nodes), F.col("id") == F.col("node"), "left_semi").where("text IS NOT NULL")
    full = space.write(wanted.mapInArrow(rebuild, "node bigint, sig binary, items binary"), "sets")
    verifier = Verifier(num, den, hashes)

    # Each star in parts of about ``block`` members; its head goes to every part.
    parts = space.write(stars.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")), "parts")
    points = stars.join(checked_broadcast(parts), "head").select("head", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), F.col("rep").alias("node"))
    heads = parts.select("head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("head").alias("node"))
    met = points.union(heads).join(full, "node").select("head", "part", "side", "node", F.col("node").alias("comp"), "sig", "items")
    first = space.write(_edges_of(met, 2, verifier), "links")
    found = connected_components(spark, first, space)
    found = space.write(found, "found")

    # What is left: buckets whose members are still in several components.
    labelled = members.join(checked_broadcast(found), F.col("rep") == F.col("id"), "left").select("k", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    labelled = space.write(labelled, "labelled")
    open_ = space.write(labelled.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("items")).where("lo < hi AND rows > 2").select("k", F.ceil(F.greatest(F.col("rows") / block, F.col("items") * 8 / block_bytes)).cast("int").alias("blocks")), "open")
    left = labelled.drop("n").join(checked_broadcast(open_), "k").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)
    left = left.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), F.col("rep").alias("node"), "comp")
    blocks = left.join(full, "node").select("k", "i", "j", "side", "node", "comp", "sig", "items")
    second = space.write(_edges_of(blocks, 3, verifier), "links")
    space.drop(shared, members, stars, nodes, full, parts, found, labelled, open_)
    labels = connected_components(spark, first.union(second), space)
    space.drop(first, second)

    owners = classes.select("h1", "h2", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    out = base.select("id", "h1", "h2", "n").join(owners, ["h1", "h2"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(f"`{key}`") == F.col("component_id"), F.col("component_id").isNull()))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest key.

    Null keys come last; of rows that share a key, or have none, that of the smallest
    hash of its text stays, of equal rows any one. So rows that are repeated stay once.
    Rows whose text is null or has no words are in no group and all stay.
    """
    space = Workspace(docs.sparkSession, "near")
    number = "row_" + "_" * max(map(len, docs.columns))  # a name that no column has
    rows = space.write(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(number).alias("row"))
    groups = near_duplicates(rows, number, text, **how).select(F.col(number).alias("row"), "component_id")
    groups = space.write(groups.join(rows.select(F.col(number).alias("row"), order.alias("at")), "row"), "groups")
    first = space.write(groups.groupBy("component_id").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id", F.col("at.row").alias("first")), "first")
    gone = space.write(groups.join(checked_broadcast(first), "component_id").where("row <> first").select(F.col("row").alias(number)), "gone")
    return rows.join(checked_broadcast(gone), number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
