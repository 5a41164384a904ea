"""Toxicity by multiple-instance learning: labels of documents teach what sentences are.

A document is toxic if one of its sentences is: its probability is the noisy-or of those
of its sentences. A sentence's is logistic in the runs of letters that it holds, in
words and at their ends. Only documents have labels; the likelihood of these, through
the noisy-or, moves the weights, so that sentences that clean documents hold as well
come out innocent. Sentences above the threshold are the offending ones.

Rows: a null text is an empty one, and a text without sentences scores 0. Labels of null
ids, of ids without a text and of ids labelled both ways teach nothing. Rows of one id
are scored each for itself. Without toxic or without clean labels every score is the
share of toxic labels (0 without any). Extra columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactum.llm.common import Workspace, checked_broadcast, in_small_batches

#: Bounds of the labelled sample: rows of each label, code points of each label, code
#: points of a text that teaches.
TOXIC_ROWS, CLEAN_ROWS, LABEL_CHARS, TEXT_CHARS = 2_500, 5_000, 20_000_000, 1_000_000
#: Lengths of runs of letters, a blank for either end of the word; whole words count besides.
RUNS = (3, 4, 5, 6)
#: Runs are counted by hashes of so many bits; most runs that are kept, and what a run
#: has to show: documents that are toxic, and twice the log of its likelihood ratio.
BITS, KEPT, LEAST_TOXIC, LEAST_EVIDENCE = 22, 1_500, 3, 12.0
#: A longer sentence is cut after so many words.
SENTENCE_WORDS = 40
STEPS, RATE, DECAY = 600, 0.05, 2e-5
#: Scores from which a document, and a sentence, counts as toxic.
ACCEPT = 0.3
TEXTS = 200
_END = re.compile("[.!?\n\r…。！？]+")
_WORD = re.compile(r"\w+")
_REST = re.compile(r"[^\w\n]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences that have a word, in code points; long ones in parts."""
    out, at = [], 0
    for m in [*_END.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at:
            if end - at <= 2 * SENTENCE_WORDS:
                if _WORD.search(text, at, end):
                    out.append((at, end))
            else:
                words = [w.start() for w in _WORD.finditer(text, at, end)]
                cuts = [at, *words[SENTENCE_WORDS::SENTENCE_WORDS], end]
                out += zip(cuts, cuts[1:], strict=False) if words else []
        at = m.end() if m else end
    return out


def spread_out(text: str, parts: Sequence[tuple[int, int]]) -> str:
    """The sentences in lower case, words between blanks, a line break after each."""
    return " " + _REST.sub(" ", " \n ".join([text[a:b] for a, b in parts]).lower()) + " "


def runs(word: str) -> set[str]:
    w = f" {word} "
    return {w, *(w[i : i + n] for n in RUNS for i in range(len(w) - n + 1))}


def _hashed(run: str) -> int:
    return crc32(run.encode()) >> (32 - BITS)


class Model:
    def __init__(self, names: list[str], weights: np.ndarray, bias: float, flat: float | None = None):
        self.names, self.weights, self.bias, self.flat = names, weights, bias, flat
        self._tree = None

    def __getstate__(self):
        return self.__dict__ | {"_tree": None}

    def tree(self):
        """All runs in one automaton; the line break stands for the next sentence."""
        if self._tree is None:
            self._tree = ahocorasick.Automaton()
            for i, n in enumerate(self.names):
                self._tree.add_word(n, i)
            self._tree.add_word("\n", -1)
            self._tree.make_automaton()
        return self._tree

    def found(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Runs of a text that is spread out, and the number of the sentence that each is in, once a sentence."""
        hits = np.fromiter((v for _, v in self.tree().iter(text)), np.int64)
        size = len(self.names)
        met = np.unique((np.cumsum(hits < 0) * size + hits)[hits >= 0])
        return met % size, met // size

    def logits(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        """The sentences of a whole text, and their log odds."""
        parts = sentences(text)
        if not parts:
            return parts, np.zeros(0)
        runs_, of = self.found(spread_out(text, parts))
        return parts, self.bias + np.bincount(of, weights=self.weights[runs_], minlength=len(parts))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def noisy_or(z: np.ndarray) -> float:
    """The probability that one sentence or more is toxic, from their log odds."""
    return float(-np.expm1(-_softplus(z).sum())) if len(z) else 0.0


def risk(w: np.ndarray, b: float, run: np.ndarray, of: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, float]:
    """The weighted negative log likelihood of the labels y, and its slopes.

    ``run`` and ``of``: each run that is found and its sentence; ``doc``: each sentence's
    document. With S the sum of log(1 + exp(z)) over a document's sentences its
    probability is 1 - exp(-S), so that a clean one loses S, a toxic one -log(1 - exp(-S)).
    """
    z = b + np.bincount(of, weights=w[run], minlength=len(doc))
    s = np.maximum(np.bincount(doc, weights=_softplus(z), minlength=len(y)), 1e-9)
    loss = np.where(y, -np.log(-np.expm1(-s)), s)
    slope = weight * np.where(y, -1.0 / np.expm1(np.minimum(s, 500.0)), 1.0)
    dz = slope[doc] / (1.0 + np.exp(-np.clip(z, -500, 500)))
    return float((weight * loss).sum()), np.bincount(run, weights=dz[of], minlength=len(w)), float(dz.sum())


def fit(names: list[str], run: np.ndarray, of: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Adam on the risk, with weight decay; starts where every sentence is as likely as any."""
    weight = weight / weight.sum()
    prior = min(max(float(weight[y].sum()), 1e-3), 0.999)
    w, b = np.zeros(len(names) + 1), math.log(prior / max(1.0, len(doc) / max(1, len(y))))
    w[-1] = b
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        _, g, gb = risk(w[:-1], w[-1], run, of, doc, y, weight)
        g = np.append(g + DECAY * w[:-1], gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(names, w[:-1], float(w[-1]))


def evidence_sql(a: str, b: str, toxic: int, clean: int) -> str:
    """Twice the log likelihood ratio of a run met in a of the toxic and b of the clean documents, 0 if it is no rarer in the clean."""
    part = lambda k, n: f"IF({k} > 0, {k} * ln(CAST({k} AS DOUBLE) / {n}), 0.0D)"
    rest = f"({toxic + clean} - {a} - {b})"
    met = " + ".join([part(a, f"({a} + {b})"), part(b, f"({a} + {b})"), part(f"({toxic} - {a})", rest), part(f"({clean} - {b})", rest)])
    whole = sum(n * math.log(n / (toxic + clean)) for n in (toxic, clean))
    return f"IF({a} * {clean}L > {b} * {toxic}L, 2 * ({met} - ({whole!r}D)), 0.0D)"


def sample(docs: DataFrame, labels: DataFrame, space: Workspace, key: str, text: str, label: str) -> tuple[DataFrame, dict[bool, float]] | None:
    """(toxic, text) of the rows that teach, written, and the share of each label that they are.

    Rows are chosen by a hash of key and text, those that are equal in both together.
    """
    one = labels.groupBy(F.col(f"`{key}`").alias("label_id")).agg(F.min(f"`{label}`").alias("lo"), F.max(f"`{label}`").alias("hi"))
    one = space.write(one.where("label_id IS NOT NULL AND lo = hi AND lo IN (0, 1)").select("label_id", (F.col("lo") == 1).alias("toxic")), "labels")
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).where("length(text) BETWEEN 1 AND %d" % TEXT_CHARS)
    rows = rows.join(checked_broadcast(one), F.col("id") == F.col("label_id"))
    sizes = {r["toxic"]: (r["n"], r["chars"]) for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    if len(sizes) < 2:
        return None
    share = {t: min(1.0, (TOXIC_ROWS if t else CLEAN_ROWS) / n, LABEL_CHARS / chars) for t, (n, chars) in sizes.items()}
    few = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < F.when(F.col("toxic"), math.ceil(1e6 * share[True])).otherwise(math.ceil(1e6 * share[False]))
    return space.write(rows.where(few).select("toxic", "text"), "sample"), share


def _telling_runs(rows: DataFrame) -> list[str]:
    """The runs of letters that tell toxic documents of the sample, most telling first."""

    def count(batches: Iterator) -> Iterator:
        total = [Counter(), Counter()]
        seen: dict[str, list[int]] = {}
        for b in in_small_batches(batches, TEXTS):
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                met: set[int] = set()
                for w in set(_WORD.findall(text.lower())):
                    if (h := seen.get(w)) is None:
                        h = seen[w] = list(map(_hashed, runs(w)))
                    met.update(h)
                total[toxic].update(met)
                if len(seen) > 200_000:
                    seen.clear()
        for toxic, c in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()), pa.array([bool(toxic)] * len(c), pa.bool_()), pa.array(list(c.values()), pa.int64())], names=["h", "toxic", "n"])

    by_label = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(by_label) < 2:
        return []
    counts = rows.mapInArrow(count, "h bigint, toxic boolean, n bigint").groupBy("h").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("b"))
    strong = counts.where(F.col("a") >= LEAST_TOXIC).withColumn("e", F.expr(evidence_sql("a", "b", by_label[True], by_label[False])))
    best = strong.where(F.col("e") >= LEAST_EVIDENCE).orderBy(F.col("e").desc(), "h").limit(KEPT).select("h").collect()
    rank = {r["h"]: i for i, r in enumerate(best)}

    def spell(batches: Iterator) -> Iterator:
        for b in in_small_batches(batches, TEXTS):
            words = {w for t in b.column(0).to_pylist() for w in _WORD.findall(t.lower())}
            yield pa.RecordBatch.from_arrays([pa.array(sorted({r for w in words for r in runs(w) if _hashed(r) in rank}), pa.string())], names=["run"])

    spelt = rows.where("toxic").select("text").mapInArrow(spell, "run string").distinct()
    return sorted((r["run"] for r in spelt.collect()), key=lambda r: (rank[_hashed(r)], r))[:KEPT]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from a bounded sample of labelled documents; ``labels`` has key and label (0, 1)."""
    space = Workspace(docs.sparkSession, "toxicity")
    chosen = sample(docs, labels, space, key, text, label)
    names = _telling_runs(chosen[0]) if chosen else []
    if not names:
        share = labels.where(F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).first()[0]
        return Model([], np.zeros(0), 0.0, float(share or 0.0))
    rows, share = chosen
    reader = Model(names, np.zeros(len(names)), 0.0)

    def read(batches: Iterator) -> Iterator:
        for b in in_small_batches(batches, TEXTS):
            out = [(len(p := sentences(t)), *reader.found(spread_out(t, p))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[i] for x in out], pa.list_(pa.int32())) for i in (1, 2))], names=["toxic", "h", "n", "run", "of"])

    # In one order however rows arrive, so that sums come out alike.
    found = rows.select("toxic", "text", F.xxhash64("text").alias("h")).mapInArrow(read, "toxic boolean, h bigint, n int, run array<int>, of array<int>").where("n > 0").orderBy("n", "h").toArrow()
    n, y = found["n"].to_numpy(), found["toxic"].to_numpy().astype(bool)
    run, of = (pc.list_flatten(found[c]).to_numpy() for c in ("run", "of"))
    of = of + np.repeat((np.cumsum(n) - n).astype(np.int32), pc.list_value_length(found["run"]).to_numpy())
    del found
    doc = np.repeat(np.arange(len(n)), n)
    return fit(names, run, of, doc, y, np.where(y, 1 / share[True], 1 / share[False]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(key, score, n_sentences, offending) of every row; ``offending`` has start, end (code points) and score of each sentence at ``accept`` or above."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator) -> Iterator:
        m = shared.value
        least = math.log(accept / (1 - accept))
        for b in in_small_batches(batches, TEXTS):
            scores, counts, found = [], [], []
            for t in b.column(1):
                parts, z = m.logits(t.as_py() or "")
                bad = np.flatnonzero(z >= least) if m.flat is None else ()
                scores.append(noisy_or(z) if m.flat is None else m.flat)
                counts.append(len(parts))
                found.append([{"start": parts[i][0], "end": parts[i][1], "score": float(1 / (1 + math.exp(-min(z[i], 500.0))))} for i in bad])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(found, spans)], names=["key", "score", "n_sentences", "offending"])

    return rows.mapInArrow(run, f"key {kind}, score double, n_sentences bigint, offending array<struct<start:int,end:int,score:double>>").withColumnRenamed("key", key)
