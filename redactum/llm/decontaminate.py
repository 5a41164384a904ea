"""Benchmark decontamination by Wu-Manber search with words as symbols.

Patterns are windows of benchmark words. Patterns of one length share a shift
table, keyed by blocks of two words, that says how far a position may jump, and
buckets, keyed by the last block, that select the few patterns to compare word by
word. Most of a clean text is never looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactum.llm.common import Workspace, in_small_batches

#: Fixed by the contract: words after A-Z are lower-cased; words in a window; hits
#: in hundredths of the words from which a document counts as contaminated.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13
PERCENT = 5
#: Benchmark words in one block of patterns. Measured: 100 bytes a word are broadcast, and
#: 663 are held by a Python worker, so a block takes 20 MB of the driver and 133 MB of each
#: worker. A larger benchmark is searched in several passes, one per block.
BLOCK_WORDS = 200_000

_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER) if not (text or "").isascii() else (text or "").lower())


class WuManber:
    """Finds every occurrence of every pattern; patterns are tuples of words."""

    def __init__(self, patterns: Iterable[tuple[tuple[str, ...], object]]):
        by_length: dict[int, dict[tuple[str, ...], dict]] = {}
        for pattern, owner in patterns:  # owners as the keys of a dict: each once, in their order
            by_length.setdefault(len(pattern), {}).setdefault(pattern, {})[owner] = None
        self.tables = []
        for m, found in sorted(by_length.items()):
            block = min(2, m)
            shift: dict = {}
            buckets: dict = {}
            for p, owners in found.items():
                for end in range(block, m + 1):
                    key = p[end - 1] if block == 1 else (p[end - 2], p[end - 1])
                    jump = m - end
                    if jump < shift.get(key, m):
                        shift[key] = jump
                buckets.setdefault(p[-block:] if block == 2 else p[-1], []).append((p, owners))
            self.tables.append((m, block, m - block + 1, shift, buckets))

    def find(self, words: list[str]) -> Iterator[tuple[int, int, Iterable]]:
        """(start, end, owners) for each occurrence, by pattern length and position."""
        n = len(words)
        for m, block, far, shift, buckets in self.tables:
            at = m - 1
            jump_of = shift.get
            while at < n:
                key = words[at] if block == 1 else (words[at - 1], words[at])
                jump = jump_of(key, far)
                if jump:
                    at += jump
                    continue
                start = at - m + 1
                window = tuple(words[start : at + 1])
                for p, owners in buckets[key]:
                    if p == window:
                        yield start, at + 1, owners
                at += 1


def windows_of(words: list[str], size: int) -> Iterator[tuple[str, ...]]:
    if 0 < len(words) < size:
        yield tuple(words)
    for i in range(len(words) - size + 1):
        yield tuple(words[i : i + size])


def _blocks(benchmark: DataFrame, item: str, text: str, size: int, most: int) -> Iterator[WuManber]:
    """Search tables of at most ``most`` words each (or one item); items stream in, a block at a time."""
    patterns, held = [], 0
    for row in benchmark.select(F.col(f"`{item}`"), F.col(f"`{text}`")).toLocalIterator():
        words = words_of(row[1])
        if patterns and held + len(words) > most:
            yield WuManber(patterns)
            patterns, held = [], 0
        patterns += [(w, "" if row[0] is None else str(row[0])) for w in windows_of(words, size)]
        held += len(words)
    yield WuManber(patterns)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_ADDED = {"n_words": "bigint", "hit_starts": "array<int>", "hit_ends": "array<int>", "items": "array<string>"}
_HITS = {n: _ADDED[n] for n in ("hit_starts", "hit_ends", "items")}


def _arrays(found: list[tuple[list[tuple[int, int]], Iterable[str]]]) -> list[pa.Array]:
    """Columns of hits: starts, ends and items."""
    spans = [_merged(x) for x, _ in found]
    return [pa.array([[s for s, _ in x] for x in spans], pa.list_(pa.int32())), pa.array([[e for _, e in x] for x in spans], pa.list_(pa.int32())), pa.array([sorted(set(x)) for _, x in found], pa.list_(pa.string()))]


def _search(table: WuManber, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
    spans, owners = [], set()
    for s, e, who in table.find(words):
        spans.append((s, e))
        owners.update(who)
    return spans, owners


def _hits(texts: DataFrame, table: WuManber, space: Workspace) -> DataFrame:
    """A written table (h1_, h2_, hits) of the different texts in which one block's windows occur."""
    search = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for b in in_small_batches(batches, 500):
            found = [_search(search.value, words_of(t.as_py())) for t in b.column(2)]
            hit = pa.array([bool(x) for x, _ in found])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_arrays(found)], names=["h1_", "h2_", *_HITS]).filter(hit)

    schema = "h1_ bigint, h2_ bigint, " + ", ".join(f"{n} {t}" for n, t in _HITS.items())
    out = space.write(texts.mapInArrow(run, schema).dropDuplicates(["h1_", "h2_"]), "hits")
    search.destroy()
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, percent: int = PERCENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_starts, hit_ends (word offsets, merged), items
    (ids sorted as strings) and contaminated.

    Null and empty texts have no words and are clean; a null item text has no
    window; a null item id is the empty string. Texts are read whole, repeated rows
    are judged each on its own, an empty benchmark finds nothing. Columns of ``docs``
    with the names of the added ones are replaced. A benchmark of one block is searched
    in one narrow pass; of more, in one pass a block that writes what it found by two
    hashes of the text and nothing else, joined to the documents at the end.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in (*_ADDED, "n_hit", "contaminated")]
    cur = docs.select(*[F.col(f"`{c}`") for c in names])
    at, width = names.index(text), len(names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cur.schema) + ", " + ", ".join(f"{n} {t}" for n, t in _ADDED.items())
    blocks = _blocks(benchmark, item, item_text, size, block_words)
    table, following = next(blocks), next(blocks, None)
    if following is None:
        search = spark.sparkContext.broadcast(table)

        def run(batches):
            for b in in_small_batches(batches, 500):
                words = [words_of(t.as_py()) for t in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(w) for w in words], pa.int64()), *_arrays([_search(search.value, w) for w in words])], names=[*b.schema.names, *_ADDED])

        cur = cur.mapInArrow(run, schema)
    else:
        space = Workspace(spark, "decontaminate")
        hashes = [F.xxhash64(F.col(f"`{text}`")).alias("h1_"), F.xxhash64(F.lit(1), F.col(f"`{text}`")).alias("h2_")]
        texts = docs.select(*hashes, F.col(f"`{text}`").alias("text_")).where("text_ IS NOT NULL")
        found = None
        while table is not None:
            hits = _hits(texts, table, space)
            found = hits if found is None else found.unionByName(hits)
            table, following = following, next(blocks, None)
        # A row for each different text that was hit, of as many entries as there are blocks at most.
        hits = space.write(found.groupBy("h1_", "h2_").agg(F.collect_list(F.struct(*_HITS)).alias("all_")).select("h1_", "h2_", *[F.flatten(F.col("all_")[n]).alias(n) for n in _HITS]), "found")
        cur = docs.select(*[F.col(f"`{c}`") for c in names], *hashes).join(hits, ["h1_", "h2_"], "left").select(*[F.col(f"`{c}`") for c in names], *_HITS)

        def run(batches):
            for b in in_small_batches(batches, 500):
                counts = pa.array([len(words_of(t.as_py())) for t in b.column(at)], pa.int64())
                starts, ends, items = (b.column(width + i).to_pylist() for i in range(3))
                together = [(list(zip(s or (), e or (), strict=True)), i or ()) for s, e, i in zip(starts, ends, items, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:width], counts, *_arrays(together)], names=[*b.schema.names[:width], *_ADDED])

        cur = cur.mapInArrow(run, schema)
    n_hit = F.aggregate(F.zip_with("hit_starts", "hit_ends", lambda s, e: (e - s).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    cur = cur.withColumn("n_hit", n_hit)
    return cur.withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words"), percent))


def is_contaminated(n_hit: Column, n_words: Column, percent: int = PERCENT) -> Column:
    return (n_hit > 0) & (n_hit * 100 >= n_words * percent)


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def item_digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
