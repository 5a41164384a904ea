"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all that it learns from. A first fit of
positives against unlabelled text gives an estimate of the class prior, the share of
positives among the unlabelled; the classifier then minimises the non-negative
unbiased risk with that prior. It is additive: one weight per interval of each of some
forty statistics of a whole text.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactum.llm.common import Workspace, checked_broadcast, in_small_batches

#: Most rows that a fit reads: positives and unlabelled, chosen by a hash of key and text.
POSITIVE_ROWS, UNLABELLED_ROWS = 10_000, 20_000
BINS = 16
STEPS, RATE, DECAY = 1000, 0.05, 1e-4
#: Folds and weight decay of the fits that the prior is estimated from, and in how many
#: steps a unit of their scores is counted.
FOLDS, PRIOR_DECAY, SCORE_STEPS = 5, 0.03, 200
#: Scores from which a text counts as good.
ACCEPT = 0.3

# Groups of bytes whose shares are features.
_GROUPS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".", b",", b";:", b"!", b"?",
    b"'\"", b"()", b"|", b"*", b"#", b"%", b"$", b"&", b"@", b"<>", b"{}", b"[]", b"=+", b"_~^`", b"-", b"/\\",
)
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
_CLASS[128:] = len(_GROUPS) + 1
WINDOW = 200


def features(text: str | None) -> list[float]:
    """Statistics of a whole text; those of an empty one are zeros."""
    data = (text or "").encode()
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = np.bincount(_CLASS, weights=counts, minlength=len(_GROUPS) + 2) / max(1, n)
    words = data.split()
    m = max(1, len(words))
    seen = Counter(words)
    fresh = [len(set(w)) / len(w) for w in (words[i : i + WINDOW] for i in range(0, len(words), WINDOW))]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    return [
        *shares.tolist(),
        math.log1p(n), math.log1p(len(words)), float(lengths.mean()) if len(words) else 0.0,
        float((lengths <= 1).mean()) if len(words) else 0.0, float((lengths >= 16).mean()) if len(words) else 0.0,
        len(seen) / m, sum(fresh) / max(1, len(fresh)), max(seen.values(), default=0) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m, math.log1p(len(lines)), len(set(lines)) / k,
        math.log1p(len(words) / k), sum(x.rstrip()[-1:] in b".!?" for x in lines) / k,
        sum(len(x) < 40 for x in lines) / k, max(map(len, lines), default=0) / max(1, n),
    ]


class Model:
    def __init__(self, edges: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.edges, self.weights, self.bias, self.prior = edges, weights, bias, prior

    @staticmethod
    def bins(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each value the number of the interval it is in, counted on over the features."""
        at = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
        return at + np.arange(x.shape[1]) * (edges.shape[1] + 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(self.edges, x)].sum(axis=1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -35, 35)))


def risk(w: np.ndarray, bp: np.ndarray, bu: np.ndarray, prior: float | None) -> tuple[float, float, np.ndarray]:
    """(risk of positives, risk of negatives, slope that is followed) of weights, the last one the bias.

    With a prior the risk of negatives is what the unlabelled rows have of it less the
    positives' share in them. Below zero it can only come from overfitting: its slope is
    climbed, and nothing else. Without a prior unlabelled rows stand for negatives.
    """
    size = len(w) - 1
    sp, su = (1.0 / (1.0 + np.exp(-np.clip(w[b].sum(axis=1) + w[size], -35, 35))) for b in (bp, bu))

    def slope(b: np.ndarray, d: np.ndarray) -> np.ndarray:
        g = np.bincount(b.ravel(), weights=np.repeat(d, b.shape[1]), minlength=size + 1)
        g[size] = d.sum()
        return g

    loss = lambda s: float(-np.log(np.maximum(s, 1e-12)).mean())
    if prior is None:
        return loss(sp), loss(1 - su), slope(bp, (sp - 1) / len(sp)) + slope(bu, su / len(su))
    negative = loss(1 - su) - prior * loss(1 - sp)
    part = slope(bu, su / len(su)) - slope(bp, prior * sp / len(sp))
    return prior * loss(sp), negative, slope(bp, prior * (sp - 1) / len(sp)) + part if negative >= 0 else -part


def _descend(bp: np.ndarray, bu: np.ndarray, size: int, prior: float | None, steps: int, decay: float) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk; without a prior on the plain risk of positives against unlabelled."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        g = risk(w, bp, bu, prior)[2] + decay * w
        g[size] -= decay * w[size]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:size], float(w[size])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The share of positives among the unlabelled, from scores of rows not fitted on.

    ``counts`` tells how many unlabelled rows have each of the scores (default: one). At
    the threshold where an upper bound of q_u / q_p is lowest (q: shares above it; the
    bound is one standard error off each), what lies above is nearly all positive, so
    that q_u / q_p is the prior.
    """
    order = np.argsort(unlabelled)
    u, n = unlabelled[order], np.ones(len(unlabelled)) if counts is None else counts[order]
    below = np.concatenate([[0.0], np.cumsum(n)])
    top = np.unique(np.concatenate([positive, unlabelled]))
    p = np.sort(positive)
    qp = 1 - np.searchsorted(p, top, side="left") / len(p)
    qu = 1 - below[np.searchsorted(u, top, side="left")] / below[-1]
    ep, eu = np.sqrt(qp * (1 - qp) / len(p)), np.sqrt(np.maximum(qu * (1 - qu), 0) / below[-1])
    ok = (qp > 0.5) & (qu < 1)
    if not ok.any():
        return 0.5
    best = int(np.argmin((qu[ok] + eu[ok]) / (qp[ok] - ep[ok])))
    return float(np.clip(qu[ok][best] / qp[ok][best], 0.02, 0.98))


def fold_models(positive: np.ndarray, unlabelled: np.ndarray, fold_p: np.ndarray, fold_u: np.ndarray, edges: np.ndarray) -> list[Model]:
    """Of each fold a model of positives against unlabelled rows that has seen none of its rows."""
    size = positive.shape[1] * (edges.shape[1] + 1)
    bp, bu = Model.bins(edges, positive), Model.bins(edges, unlabelled)
    return [Model(edges, *_descend(bp[fold_p != k], bu[fold_u != k], size, None, STEPS // 4, PRIOR_DECAY), 0.5) for k in range(FOLDS)]


def fit(positive: np.ndarray, unlabelled: np.ndarray, edges: np.ndarray | None = None, prior: float | None = None) -> Model:
    """Rows are feature vectors. Edges and prior come from these rows where they are not given."""
    if edges is None:
        edges = np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    if prior is None:
        prior = 0.5
        if min(len(positive), len(unlabelled)) >= 2 * FOLDS:
            op, ou = np.arange(len(positive)) % FOLDS, np.arange(len(unlabelled)) % FOLDS
            models = fold_models(positive, unlabelled, op, ou, edges)
            prior = estimate_prior(*(np.concatenate([m.logits(x[o == k]) for k, m in enumerate(models)]) for x, o in ((positive, op), (unlabelled, ou))))
    w, b = _descend(Model.bins(edges, positive), Model.bins(edges, unlabelled), positive.shape[1] * (edges.shape[1] + 1), prior, STEPS, DECAY)
    return Model(edges, w, b, prior)


def _unlabelled_scores(measured: DataFrame, models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all rows, each by the model of its fold, in steps of 1 / SCORE_STEPS, and how many have each."""
    shared = measured.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for b in in_small_batches(batches, 5_000):
            x = _stacked(b.column(1))
            fold, z = b.column(0).to_numpy(), np.empty(b.num_rows)
            for k, m in enumerate(shared.value):
                z[fold == k] = m.logits(x[fold == k])
            met, n = np.unique(np.round(z * SCORE_STEPS).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n.astype(np.int64))], names=["at", "n"])

    found = measured.select("fold", "x").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    return found["at"].to_numpy() / SCORE_STEPS, found["n"].to_numpy(float)


def _stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def train(docs: DataFrame, positives: DataFrame, key: str = "doc_id", text: str = "text", positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model | None:
    """A model from trusted keys and from ``docs`` as unlabelled text.

    ``positives`` has the column ``key``; keys that are null or not in ``docs`` do not
    count. Statistics of every text are written once: the edges of the intervals and the
    prior come from those of all rows. The fits read about ``positive_rows`` and
    ``unlabelled_rows`` rows at most, however many rows share a key: trusted and
    unlabelled rows of the lowest hashes of key and text, rows equal in both taken once.
    None if there is nothing to learn from.
    """
    space = Workspace(docs.sparkSession, "quality")
    good = checked_broadcast(space.write(positives.select(F.col(f"`{key}`").alias("good_")).where("good_ IS NOT NULL").distinct(), "good"))
    rows = docs.select(F.col(f"`{key}`").alias("k_"), F.col(f"`{text}`").alias("t_")).join(good, F.col("k_") == F.col("good_"), "left")
    rows = rows.select(F.col("good_").isNotNull().alias("p"), F.xxhash64("k_", "t_").alias("h"), F.xxhash64("t_", "k_").alias("g"), "t_")

    def run(batches):
        for b in in_small_batches(batches, 500):
            x = [features(t.as_py()) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(x, pa.list_(pa.float64()))], names=["p", "h", "g", "x"])

    measured = rows.mapInArrow(run, "p boolean, h bigint, g bigint, x array<double>").withColumn("fold", F.pmod("g", F.lit(FOLDS)).cast("int"))
    measured = space.write(measured, "measured")
    n, n_good = measured.agg(F.count(F.lit(1)), F.count_if("p")).first()
    if not n_good:
        return None
    some = measured.withColumns({"u_": _share(["h"], unlabelled_rows, n), "p_": F.col("p") & _share(["g"], positive_rows, n_good)}).where("p_ OR u_")
    some = some.groupBy("h", "g").agg(*[F.first(c).alias(c) for c in ("p_", "u_", "fold", "x")]).orderBy("h", "g").toArrow()
    p, u, fold = (some[c].to_numpy() for c in ("p_", "u_", "fold"))
    x = _stacked(some["x"].combine_chunks()) if len(some) else np.zeros((0, 1))
    p, u = p.astype(bool), u.astype(bool)
    if not p.any() or not u.any():
        return None
    cuts = ", ".join(f"{i / BINS}D" for i in range(1, BINS))
    edges = np.array(measured.agg(*[F.expr(f"percentile_approx(x[{j}], array({cuts}), 1000)") for j in range(x.shape[1])]).first())
    prior = 0.5
    if min(p.sum(), u.sum()) >= 2 * FOLDS and all((p & (fold != k)).any() and (u & (fold != k)).any() for k in range(FOLDS)):
        models = fold_models(x[p], x[u], fold[p], fold[u], edges)
        own = np.concatenate([m.logits(x[p & (fold == k)]) for k, m in enumerate(models)])
        prior = estimate_prior(np.round(own * SCORE_STEPS) / SCORE_STEPS, *_unlabelled_scores(measured, models))
    space.drop(measured)
    return fit(x[p], x[u], edges, prior)


def _share(names: list[str], most: int, of: int) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, most / max(1, of)))


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) with score; 0.5 for every row without a model.

    Null texts score as empty ones. Texts are read whole. A column score is replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    cur = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("text_"))
    fields = cur.schema.fields[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width = len(fields)

    def run(batches):
        for b in in_small_batches(batches, 500):
            x = np.array([features(t.as_py()) for t in b.column(width)]) if shared.value else None
            s = shared.value.score(x) if shared.value and b.num_rows else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(s, pa.float64())], names=[*(f.name for f in fields), "score"])

    return cur.mapInArrow(run, schema)


def trusted(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Keys that are labelled 1 and never otherwise."""
    return labels.groupBy(F.col(f"`{key}`").alias(key)).agg(F.min(f"`{label}`").alias("lo"), F.max(f"`{label}`").alias("hi")).where("lo = 1 AND hi = 1").select(key)
