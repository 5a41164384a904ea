"""Importance resampling of documents towards a target distribution of hashed n-grams.

Features are runs of one and two words; a feature's bucket is the CRC of its bytes. No
run of words is ever put together: each word's CRC is reckoned once, and the CRC of a
run follows from those of its words, as appending n bytes to a text shifts its CRC by a
matrix over GF(2) that depends on n alone, and adds the CRC of what is appended. The
logarithm of target to raw frequency of a document's buckets, averaged, plus a draw
from a Gumbel distribution by a hash of its id gives its score; the highest scores are
drawn, which is sampling without replacement in proportion to the weights.

Rows: null texts and texts without words have no features and weigh 0. A null id draws
as the empty text does and comes last among equal scores; rows of one id share their
draw, and rows equal in id and score are ranked in the order of the table as it was
written. Of an empty table nothing is drawn. Without target texts all buckets count as
met once. Extra columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactum.llm.common import Workspace, in_small_batches, numbered

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BUCKETS = 10_000
#: Documents of fewer words are never drawn; of the others so many hundredths are.
LEAST_WORDS, DRAWN_PERCENT = 20, 25
SEED = "7"
SCALE = 1000
#: Distinct words that a task remembers, and texts that it takes at once.
WORDS_KEPT, TEXTS = 200_000, 200
#: Words of at most so many bytes have their shift in a table; longer ones get theirs by squaring.
TABLED = 32
POLYNOMIAL = 0xEDB88320


def _times(matrix: np.ndarray, vector: int) -> int:
    """A matrix over GF(2), columns as numbers, times a vector."""
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= int(matrix[i])
        vector >>= 1
        i += 1
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([_times(a, int(c)) for c in b], np.uint64)


def _one_byte() -> np.ndarray:
    """What eight zero bits make of each single bit of a CRC."""
    bit = np.array([POLYNOMIAL] + [1 << i for i in range(31)], np.uint64)
    for _ in range(3):
        bit = _product(bit, bit)
    return bit


class Shifts:
    """The matrices that shift a CRC by so many bytes: powers of that of one byte."""

    def __init__(self):
        self.squares = [_one_byte()]
        self.known: dict[int, np.ndarray] = {0: np.array([1 << i for i in range(32)], np.uint64)}
        self.tables = np.stack([self._table(n) for n in range(TABLED + 1)])

    def matrix(self, n: int) -> np.ndarray:
        if n not in self.known:
            out, k, rest = self.known[0], 0, n
            while rest:
                if k == len(self.squares):
                    self.squares.append(_product(self.squares[-1], self.squares[-1]))
                if rest & 1:
                    out = _product(self.squares[k], out)
                rest, k = rest >> 1, k + 1
            if n > TABLED:
                return out
            self.known[n] = out
        return self.known[n]

    def _table(self, n: int) -> np.ndarray:
        """For each byte of a CRC and each of its values the byte's share of the shifted CRC."""
        columns = self.matrix(n).reshape(4, 8)
        out = np.zeros((4, 256), np.uint32)
        for b in range(8):
            out ^= np.where(np.arange(256) >> b & 1, columns[:, b : b + 1], 0).astype(np.uint32)
        return out

    def shift(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each CRC as it is after n more bytes of zeros."""
        m = np.minimum(n, TABLED)
        t = self.tables
        out = t[m, 0, crc & 255] ^ t[m, 1, crc >> 8 & 255] ^ t[m, 2, crc >> 16 & 255] ^ t[m, 3, crc >> 24]
        for i in np.flatnonzero(n > TABLED):
            out[i] = _times(self.matrix(int(n[i])), int(crc[i]))
        return out


class Words(dict):
    """Numbers of words; of each number its CRC, that with a blank behind it, and its length in bytes."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int, int]] = []

    def __missing__(self, word: str) -> int:
        data = word.encode()
        crc = zlib.crc32(data)
        self[word] = n = len(self.rows)
        self.rows.append((crc, zlib.crc32(b" ", crc), len(data)))
        return n


class Buckets:
    """Buckets of the runs of one and two words of texts, all texts of a batch at once."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.shifts = buckets, Shifts()
        self._forget()

    def _forget(self) -> None:
        self.words, self.table = Words(), np.zeros((0, 3), np.int64)

    def of(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; the bucket of each feature; the number of the text that it is of."""
        if len(self.words) > WORDS_KEPT:
            self._forget()
        ids: list[int] = []
        n = []
        for t in texts:
            before = len(ids)
            ids.extend(map(self.words.__getitem__, WORD.findall((t or "").translate(_LOWER))))
            n.append(len(ids) - before)
        if len(self.table) < len(self.words.rows):
            self.table = np.concatenate([self.table, np.array(self.words.rows[len(self.table) :], np.int64)])
        counts = np.array(n, np.int64)
        of = np.repeat(np.arange(len(n)), counts)
        rows = self.table[np.array(ids, np.int64)]
        # The CRC of "a b" is that of "a ", shifted by the bytes of b, plus that of b.
        pairs = np.flatnonzero(of[1:] == of[:-1]) if len(of) else np.zeros(0, np.int64)
        both = self.shifts.shift(rows[pairs, 1], rows[pairs + 1, 2]).astype(np.int64) ^ rows[pairs + 1, 0]
        return counts, np.concatenate([rows[:, 0], both]) % self.buckets, np.concatenate([of, of[pairs]])


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts; a task gives at most one row a bucket."""

    def run(batches):
        reader, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for small in in_small_batches([b], TEXTS):
                total += np.bincount(reader.of(t.as_py() for t in small.column(0))[1], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the logarithm of smoothed target to raw frequency, floored, of each bucket.

    As many numbers as there are buckets come to the driver, however many texts there are.
    """

    def counts(df: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, text, buckets).collect():
            out[r["bucket"]] = r["n"]
        return out

    s, t = counts(raw), counts(target)
    whole, sought = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(SCALE * math.log(float((int(b) + 1) * whole) / float((int(a) + 1) * sought))) for a, b in zip(s, t, strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight): the floored mean gain of each text's features."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        reader = Buckets(len(shared.value))
        for b in in_small_batches(batches, TEXTS):
            words, found, of = reader.of(t.as_py() for t in b.column(1))
            n = np.bincount(of, minlength=b.num_rows)
            total = np.zeros(b.num_rows, np.int64)
            np.add.at(total, of, shared.value[found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(n, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64())], names=["key", "w", "n", "x"])

    return rows.mapInArrow(run, f"key {kind}, n_words bigint, n_features bigint, weight bigint").withColumnRenamed("key", key)


def gumbel_sql(key: str, seed: str = SEED) -> str:
    """Thousandths of a draw from the standard Gumbel distribution by a hash of the key, floored."""
    h = f"CAST(conv(substring(sha2(concat('{seed}:', coalesce(CAST(`{key}` AS STRING), '')), 256), 1, 8), 16, 10) AS BIGINT)"
    return f"CAST(floor(-{SCALE}.0D * ln(-ln(({h} + 0.5D) / 4294967296.0D))) AS BIGINT)"


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row; rank is null where it is not drawn.

    Ranks come from ranges of the order, each sorted on its own. Rows of equal scores and
    ids may lie in several ranges, so that none grows with a group of them.
    """
    space = Workspace(docs.sparkSession, "resample")
    rows = weigh(docs, gains(docs, target, text), key, text)
    rows = space.write(rows.withColumn("score", F.col("weight") + F.expr(gumbel_sql(key, seed))).withColumn("place", F.monotonically_increasing_id()), "scored")
    can = rows.where(F.col("n_words") >= least_words)
    drawn = percent * can.count() // 100
    order = [F.col("score").desc(), F.col(f"`{key}`").asc_nulls_last(), F.col("place").asc()]
    can = numbered(can, order, space)
    names = [F.col(f"`{key}`"), "n_words", "n_features", "weight", "score"]
    ranked = can.select(*names, F.when(F.col("rank") < drawn, F.col("rank") + 1).alias("rank"))
    return ranked.union(rows.where(F.col("n_words") < least_words).select(*names, F.lit(None).cast("bigint").alias("rank")))
