"""Token counts by byte-pair merging with a heap and a linked list.

A piece of n symbols becomes a doubly linked list; a heap holds its adjacent pairs
by rank and position. The lowest pair is merged, its neighbours' pairs are pushed,
stale entries are skipped: O(n log n) however long a piece is. The count is n less
the merges; no identifiers are made.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactum.llm.common import in_small_batches

#: The pattern that a byte-level pre-tokenizer splits by (a fixed value of the vocabulary's format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose counts are kept per Python worker; the store is emptied when full.
CACHE = 300_000
#: Longer pieces are counted anew each time.
CACHED_LENGTH = 64


def byte_symbols() -> list[str]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Vocabulary:
    """Merge ranks over integer symbols, and special strings, of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, pre = data["model"], data.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or data.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are supported")
        ids = model["vocab"]
        self.start = [ids[s] for s in byte_symbols()]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.special = [t["content"] for t in data.get("added_tokens", []) if t.get("content")]

    def merged_count(self, piece: bytes) -> int:
        """Symbols left of ``piece`` after all merges."""
        n = len(piece)
        if n < 2:
            return n
        rank_of = self.merges.get
        sym = [self.start[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = rank_of((sym[i], sym[i + 1]))
            if found:
                heap.append((found[0], i, sym[i], sym[i + 1], found[1]))
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged since
            sym[i], sym[j] = new, -1
            k = after[j]
            after[i] = k
            left -= 1
            if k < n:
                before[k] = i
                found = rank_of((new, sym[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, new, sym[k], found[1]))
            h = before[i]
            if h >= 0:
                found = rank_of((sym[h], new))
                if found:
                    heapq.heappush(heap, (found[0], h, sym[h], new, found[1]))
        return left


class Counter:
    """Counts tokens of texts; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None
        self.cache: dict[str, int] = {}

    def piece(self, p: str) -> int:
        n = self.vocabulary.merged_count(p.encode())
        if len(p) <= CACHED_LENGTH:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[p] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, parts = 0, [text]
        if self.special and any(s in text for s in self.vocabulary.special):
            parts = self.special.split(text)
            total = len(parts) - 1  # each special string is one token
        known = self.cache.get
        for part in parts:
            for p in self.pieces(part):
                total += known(p) or self.piece(p)
        return total


_WORKER: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _WORKER:
        _WORKER[path] = Counter(Vocabulary(path))
    return _WORKER[path]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 512, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    ``vocabulary`` is the path of a byte-level BPE file that every executor can
    open, as part of an installed package. Null and empty texts have 0 tokens;
    special strings inside a text count as one token each; texts are read whole.
    Columns of ``docs`` with the added names are replaced.
    """
    added = ("n_bytes", "n_tokens", "over_limit")
    names = [c for c in docs.columns if c not in added and (keep_text or c != text)]
    cur = docs.select(*[F.col(f"`{c}`") for c in names if c != text], F.col(f"`{text}`"))
    rest = [f for f in cur.schema.fields if keep_text or f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "n_bytes bigint", "n_tokens bigint", "over_limit boolean"])
    width = len(rest)

    def run(batches):
        counter = _counter(vocabulary)
        for b in in_small_batches(batches, 500):
            sizes, tokens = [], []
            for t in b.column(b.num_columns - 1):
                s = t.as_py()
                sizes.append(len((s or "").encode()))
                tokens.append(counter.count(s))
            arrays = [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *arrays], names=[f.name for f in rest] + list(added))

    return cur.mapInArrow(run, schema)
