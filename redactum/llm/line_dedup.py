"""Line dedup by a deletion-neighbourhood join.

Equal lines are one class. A line of ten words or more also goes if an earlier line
is one word edit away: each such line gives the hashes of itself with one word left
out, equal hashes meet, the edit distance is verified and the earliest stays.

Only lines that can have a partner give variants. One edit leaves the first five
words or the last five as they are, so a line whose first five and whose last five
no other line has is left out before. Variants meet through minima per hash, which
are aggregated before they are shuffled, so that no group is expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactum.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, Workspace, checked_broadcast, file_bytes, in_small_batches
from redactum.llm.minhash import WordHashes, _mixed

#: Words from which one edit counts as the same line; 2 * ENDS at least.
NEAR_WORDS = 10
ENDS = 5
_LAST = (1 << 63) - 1
_B = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_B, -1, 1 << 64)


def _one(data: bytes, seed: int) -> int:
    h = xxhash.xxh3_64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


class Neighbourhoods:
    """Hashes of a word sequence and of it without each of its words, in linear time."""

    def __init__(self):
        self.seen = WordHashes()
        self.powers = np.ones(1, np.uint64)

    def of(self, words: list[bytes]) -> tuple[int, np.ndarray]:
        n = len(words)
        if len(self.powers) <= n:
            self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _B, np.uint64))])
        w = np.fromiter(map(self.seen.__getitem__, words), np.uint64, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(w * self.powers[:n], out=sums[1:])
        whole = _mixed(sums[n:] + np.uint64(n * _INVERSE & _MASK))
        without = _mixed(sums[:n] + (sums[n] - sums[1:]) * np.uint64(_INVERSE) + np.uint64((n - 1) * _INVERSE & _MASK))
        return int(whole.view(np.int64)[0]), without.view(np.int64)


def within_one_edit(a: list, b: list) -> bool:
    """Whether inserting, leaving out or replacing one item at most turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _identified(docs: DataFrame, key: str, text: str) -> list:
    """id and th name a row: its key (null last) and a hash of its text."""
    return [F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(_LAST)).alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text")]


def _lines(batches, near_words: int):
    """(id, th, no, h1, h2, head, tail) of every line that has words."""
    for b in in_small_batches(batches, 500):
        counts, places, wholes, heads, tails = [], [], [], [], []
        for t in b.column(2):
            before = len(places)
            for no, line in enumerate((t.as_py() or "").encode().split(b"\n")):
                words = line.split()
                if not words:
                    continue
                places.append(no)
                wholes.append(xxhash.xxh3_128_digest(b" ".join(words)))
                near = len(words) >= near_words
                heads.append(_one(b" ".join(words[:ENDS]), 1) if near else None)
                tails.append(_one(b" ".join(words[-ENDS:]), 2) if near else None)
            counts.append(len(places) - before)
        owner = pa.array(np.repeat(np.arange(len(counts)), counts))
        two = np.frombuffer(b"".join(wholes), np.int64).reshape(-1, 2)
        columns = [b.column(0).take(owner), b.column(1).take(owner), pa.array(places, pa.int32()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(heads, pa.int64()), pa.array(tails, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "no", "h1", "h2", "head", "tail"])


def _variants(batches):
    """(k, i, lid): hashes with word i left out."""
    near = Neighbourhoods()
    for b in in_small_batches(batches, 500):
        keys, places, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for lid, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            _, without = near.of(line.encode().split())
            keys.append(without)
            places.append(np.arange(len(without), dtype=np.int32))
            ids.append(np.full(len(without), lid))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, places, ids)], names=["k", "i", "lid"])


def _wholes(batches):
    near = Neighbourhoods()
    for b in batches:
        keys = [near.of(x.encode().split())[0] for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column(0)], names=["k", "m"])


def _verified(batches):
    for b in in_small_batches(batches, 2000):
        ok = [within_one_edit(x.encode().split(), y.encode().split()) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["h1", "h2"]).filter(pa.array(ok, pa.bool_()))


def _near_lines(space: Workspace, texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2) of lines that have an earlier line within one edit."""
    near = distinct.where("head IS NOT NULL")
    keys = near.select(F.explode(F.array("head", "tail")).alias("k"), "h1")
    shared = space.write(keys.groupBy("k").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("k"), "ends")
    small = checked_broadcast(shared)
    by = near.join(small.withColumnRenamed("k", "head"), "head", "left_semi").select("f", "h1", "h2")
    by = by.unionByName(near.join(small.withColumnRenamed("k", "tail"), "tail", "left_semi").select("f", "h1", "h2")).distinct()
    asked = space.write(by.groupBy(F.col("f.id").alias("aid"), F.col("f.th").alias("ath")).agg(F.collect_list(F.struct(F.col("f.no").alias("no"), "h1", "h2")).alias("nos")), "asked")
    lines = asked.agg(F.sum(F.size("nos"))).first()[0] or 0
    found = texts.join(F.broadcast(asked) if lines <= BROADCAST_ROWS and file_bytes(asked) <= BROADCAST_BYTES else asked, (F.col("id") == F.col("aid")) & (F.col("th") == F.col("ath"))).select("id", "th", "text", "nos").where("text IS NOT NULL")

    def cut(batches):
        for b in in_small_batches(batches, 200):
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for who, th, t, nos in zip(*(c.to_pylist() for c in b.columns), strict=True):
                split = t.encode().split(b"\n")
                for x in nos:
                    line = b" ".join(split[x["no"]].split()).decode()
                    for c, v in zip(cols, (who, th, x["no"], x["h1"], x["h2"], line), strict=True):
                        c.append(v)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "th", "no", "h1", "h2", "line"])

    cut_lines = found.mapInArrow(cut, "id bigint, th bigint, no int, h1 bigint, h2 bigint, line string")
    # Numbers in the order of the lines' first places stand for those places from here on.
    # Rows equal in key and text give a line once, or it would meet itself as its own near line.
    flagged = space.write(cut_lines.dropDuplicates(["id", "th", "no"]).orderBy("id", "th", "no").select(F.monotonically_increasing_id().alias("lid"), "h1", "h2", "line"), "flagged")
    variants = flagged.select("lid", "line").mapInArrow(_variants, "k bigint, i int, lid bigint")
    groups = variants.groupBy("k", "i").agg(F.min("lid").alias("m"), F.max("lid").alias("x")).where("m < x").select("k", F.col("i").alias("at"), "m")
    wholes = flagged.select("lid", "line").mapInArrow(_wholes, "k bigint, m bigint").select("k", F.lit(-1).alias("at"), "m")
    targets = space.write(groups.unionByName(wholes), "targets")
    met = variants.join(checked_broadcast(targets), "k").where("(at = -1 OR at = i) AND m <> lid")
    links = met.select(F.greatest("lid", "m").alias("later"), F.least("lid", "m").alias("earlier")).groupBy("later").agg(F.min("earlier").alias("earlier"))
    links = space.write(links, "links")
    space.drop(shared, asked, targets)
    small = checked_broadcast(links)
    later = flagged.join(small, flagged["lid"] == F.col("later")).select("h1", "h2", "earlier", F.col("line").alias("a"))
    first = flagged.select("lid", F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("b"))
    pairs = later.join(first, F.col("earlier") == F.col("lid")).where("h1 <> e1 OR h2 <> e2").select("h1", "h2", "a", "b")
    near = space.write(pairs.mapInArrow(_verified, "h1 bigint, h2 bigint").distinct(), "near")
    space.drop(flagged, links)
    return near


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", near_words: int = NEAR_WORDS) -> DataFrame:
    """``docs`` with the text of the lines that stay, and n_lines, n_removed, n_near.

    Lines are what ``\\n`` separates, words what ASCII white space separates; lines
    without words stay and do not count in n_lines. A line goes if an equal line, or,
    from ``near_words`` words on, a line within one word edit stands earlier, by key
    (null last), then by a hash of the text, then by place; also if that earlier line
    goes itself. n_near counts lines that go for a line that is not equal. Null texts
    stay null. Rows equal in key and text are treated alike. Keys are whole numbers: one
    that is none fails the cast, and the run. Columns of ``docs`` with the added names
    are replaced.
    """
    if near_words < 2 * ENDS:
        raise ValueError(f"near_words must be {2 * ENDS} at least")
    space = Workspace(docs.sparkSession, "lines")
    texts = docs.select(*_identified(docs, key, text))
    lines = space.write(texts.mapInArrow(lambda b: _lines(b, near_words), "id bigint, th bigint, no int, h1 bigint, h2 bigint, head bigint, tail bigint"), "lines")
    distinct = space.write(lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "no")).alias("f"), F.count(F.lit(1)).alias("n"), F.first("head").alias("head"), F.first("tail").alias("tail")), "distinct")
    near = _near_lines(space, texts, distinct)
    again = distinct.select("h1", "h2", "f", "n").join(checked_broadcast(near).withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("n > 1 OR near").select("h1", "h2", "f", F.coalesce("near", F.lit(False)).alias("near"))
    again = space.write(again, "again")
    space.drop(distinct, near)
    gone = lines.select("id", "th", "no", "h1", "h2").join(checked_broadcast(again), ["h1", "h2"]).where((F.col("near")) | (F.struct("id", "th", "no") != F.col("f")))
    gone = gone.distinct().groupBy("id", "th").agg(F.collect_list("no").alias("nos"), F.count_if("near").alias("n_near"))
    gone = space.write(gone.select(F.col("id").alias("gid"), F.col("th").alias("gth"), "nos", "n_near"), "gone")
    space.drop(lines, again)
    held = gone.agg(F.sum(F.size("nos"))).first()[0] or 0
    return _without(docs, F.broadcast(gone) if held <= BROADCAST_ROWS and file_bytes(gone) <= BROADCAST_BYTES else gone, key, text)


def _without(docs: DataFrame, gone: DataFrame, key: str, text: str) -> DataFrame:
    added = ("n_lines", "n_removed", "n_near")
    names = [c for c in docs.columns if c not in added]
    ident = _identified(docs, key, text)
    rows = docs.select(*[F.col(f"`{c}`") for c in names], ident[0].alias("id_"), ident[1].alias("th_"))
    rows = rows.join(gone, (F.col("id_") == F.col("gid")) & (F.col("th_") == F.col("gth")), "left").select(*[F.col(f"`{c}`") for c in names], "nos", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"))
    at, width = names.index(text), len(names)
    fields = rows.schema.fields[:width]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{n} bigint" for n in added)])

    def run(batches):
        for b in in_small_batches(batches, 500):
            out, counts, removed = [], [], []
            for t, nos in zip(b.column(at), b.column(width).to_pylist(), strict=True):
                t = t.as_py()
                split = (t or "").encode().split(b"\n")
                counts.append(sum(1 for x in split if x.strip()))
                removed.append(len(nos or ()))
                if nos:
                    drop = set(nos)
                    t = b"\n".join(x for i, x in enumerate(split) if i not in drop).decode()
                out.append(t)
            cols = list(b.columns[:width])
            cols[at] = pa.array(out, cols[at].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), b.column(width + 1)], names=[*b.schema.names[:width], *added])

    return rows.mapInArrow(run, schema)
