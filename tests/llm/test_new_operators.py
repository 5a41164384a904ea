"""Resampling, filter audit and toxicity against brute force, and on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redactum.llm import filter_audit, resampling, toxicity
from redactum.session import ship_package


# Resampling.
def words(text):
    return resampling.WORD.findall((text or "").translate(resampling._LOWER))


def features(text):
    w = words(text)
    return [x.encode() for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]


@settings(deadline=None, max_examples=60)
@given(st.binary(max_size=40), st.binary(max_size=300))
def test_crc_of_a_whole_follows_from_its_parts(a, b):
    shifts = resampling.Shifts()
    got = int(shifts.shift(np.array([zlib.crc32(a)], np.int64), np.array([len(b)]))[0]) ^ zlib.crc32(b)
    assert got == zlib.crc32(a + b)


def test_buckets_of_runs_without_their_strings():
    texts = ["Ab cd EF g", "", None, "x x x", "wört é-ü " + "q" * 100 + " a " + "z" * 5000 + " b", "one"]
    n, found, of = resampling.Buckets(997).of(texts)
    assert n.tolist() == [len(words(t)) for t in texts]
    assert sorted(zip(of.tolist(), found.tolist(), strict=True)) == sorted((i, zlib.crc32(f) % 997) for i, t in enumerate(texts) for f in features(t))


def by_definition(docs, items, percent=25, least=20):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(zlib.crc32(f) % 10_000 for f in features(x))
    for x in items:
        t.update(zlib.crc32(f) % 10_000 for f in features(x))
    whole, sought = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = []
    for key, x in docs:
        g = [math.floor(1000 * math.log((t[b] + 1) * whole / ((s[b] + 1) * sought))) for b in (zlib.crc32(f) % 10_000 for f in features(x))]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(words(x)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    can = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, [(r[0], r[4]) for r in can[: percent * len(can) // 100]]


def drawn(rows):
    return [(r["doc_id"], r["score"]) for r in sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])]


@pytest.mark.parametrize("percent,least", [(25, 20), (100, 0), (0, 20)])
def test_resampling_by_definition(spark, awkward, percent, least):
    ship_package(spark)
    items = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None), (3, "")], "item_id long, text string")
    got = resampling.resample(awkward, items, percent=percent, least_words=least).collect()
    rows, first = by_definition([(r["doc_id"], r["text"]) for r in awkward.collect()], ["the cat sat on the mat", None, ""], percent, least)
    assert sorted(map(str, rows)) == sorted(str(tuple(r)[:5]) for r in got)
    assert drawn(got) == first
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, len(first) + 1))


def test_equal_scores_go_to_the_smaller_id_over_several_ranges(spark):
    ship_package(spark)
    docs = spark.createDataFrame([(i % 40, "one two three " * 10) for i in range(400)], "doc_id long, text string").repartition(7)
    got = resampling.resample(docs, docs.limit(0)).collect()
    assert drawn(got) == by_definition([(r["doc_id"], r["text"]) for r in docs.collect()], [])[1]


def test_resampling_of_nothing(spark, awkward):
    ship_package(spark)
    assert resampling.resample(awkward.limit(0), awkward).collect() == []


# Filter audit.
def masks(rows):
    first = {}
    for key, text, _ in rows:
        first.setdefault(text or "", []).append(math.inf if key is None else key)
    out = []
    for key, text, _ in rows:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), (math.inf if key is None else key) > min(first[t]))
        out.append(sum(f << i for i, f in enumerate(fails)))
    return out


def audited(rows, labels):
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, x in labels if x == 1 and k is not None}
    parts = {}
    for (key, _, part), m in zip(rows, masks(rows), strict=True):
        parts.setdefault(part or "", []).append((key, m))
    out = set()
    for part, docs in parts.items():
        steps, total = [], Counter()
        for order in itertools.permutations("ABCDE"):
            before = 0
            for i, f in enumerate(order):
                own = 1 << "ABCDE".index(f)
                gone = [k for k, m in docs if m & own and not m & before]
                total[f] += len(gone)
                rest = (sum(not m & (own | before) for _, m in docs), len(gone), sum(bool(m & own and m & before) for _, m in docs), sum(m == own for _, m in docs), sum(k in good for k in gone), sum(k in toxic for k in gone))
                steps.append((part, "".join(order), i + 1, f, *rest))
                before |= own
        out |= {(*s[:3], *s[4:], total[s[3]]) for s in steps}
    return out


def varied():
    r = random.Random(5)
    base = [" ".join(r.choice(["a", "Bc", "d$e", "fg", "h"]) if k % 3 else f"w{i}" for i in range(r.choice([5, 150, 260, 900]))) for k in range(30)]
    # Texts of equal lengths that differ at the end of a later block, or not at all.
    base += ["x" * 700 + c for c in "ab"] + ["y" * 5000 + c + "z" for c in "ab"] + ["", None]
    return [(None if i % 17 == 16 else i % 90, base[r.randrange(len(base))], r.choice(["p", "q", "", None])) for i in range(150)]


@pytest.mark.parametrize("bits,members", [(64, 1_000), (2, 3)])
def test_audit_by_definition(spark, bits, members):
    """Few bits make different texts collide in every block: the full comparison parts them."""
    rows, labels = varied(), [(i, i % 3 % 2, int(i % 5 == 0)) for i in range(60)] + [(5, None, 1), (None, 1, 1), (6, 1, 0), (6, 0, 0)]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, source string, mask int, class string")
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), bits=bits, members=members).collect()
    assert {tuple(r) for r in got} == audited(rows, labels)
    assert len(got) == 600 * len({p or "" for _, _, p in rows})


def test_audit_of_awkward_rows_and_of_nothing(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in awkward.collect()]
    assert {tuple(r) for r in filter_audit.audit(awkward, labels).collect()} == audited(rows, [(1, 1, 0)])
    assert filter_audit.audit(awkward.limit(0), labels.limit(0)).collect() == []


def test_blocks_cover_a_text(spark):
    for n in (1, 255, 256, 257, 767, 768, 769, 10_000):
        blocks = math.floor(math.log2((n - 1) // filter_audit.BLOCK + 1)) + 1
        assert filter_audit.BLOCK * (2**blocks - 1) >= n > filter_audit.BLOCK * (2 ** (blocks - 1) - 1)
        assert spark.sql(f"SELECT size({filter_audit.block_hashes_sql(f'repeat(chr(233), {n})')})").first()[0] == blocks


# Toxicity.
def test_risk_and_slopes_by_definition():
    rng = np.random.default_rng(3)
    doc, y, weight = np.array([0, 0, 0, 1, 2, 2]), np.array([True, False, True]), np.array([0.5, 0.2, 0.3])
    run, of = np.array([0, 1, 1, 2, 0]), np.array([0, 0, 2, 3, 5])
    w, b = rng.normal(size=3), -0.7

    def loss(w, b):
        z = [b + sum(w[r] for r, o in zip(run, of, strict=True) if o == s) for s in range(6)]
        p = [1 - math.prod(1 - 1 / (1 + math.exp(-z[s])) for s in range(6) if doc[s] == d) for d in range(3)]
        return sum(q * -math.log(x if t else 1 - x) for q, x, t in zip(weight, p, y, strict=True)), p

    got, slope, bias = toxicity.risk(w, b, run, of, doc, y, weight)
    assert got == pytest.approx(loss(w, b)[0])
    for i in range(3):
        e = np.eye(3)[i] * 1e-6
        assert slope[i] == pytest.approx((loss(w + e, b)[0] - loss(w - e, b)[0]) / 2e-6, rel=1e-4)
    assert bias == pytest.approx((loss(w, b + 1e-6)[0] - loss(w, b - 1e-6)[0]) / 2e-6, rel=1e-4)
    z = b + np.bincount(of, weights=w[run], minlength=6)
    assert toxicity.noisy_or(z[doc == 0]) == pytest.approx(loss(w, b)[1][0])


def test_evidence_is_the_likelihood_ratio(spark):
    a, b, n, m = 30, 5, 100, 400
    log = lambda k, n, p: k * math.log(p) + (n - k) * math.log(1 - p)
    ratio = 2 * (log(a, n, a / n) + log(b, m, b / m) - log(a, n, (a + b) / (n + m)) - log(b, m, (a + b) / (n + m)))
    of = lambda a, b: spark.sql(f"SELECT {toxicity.evidence_sql('a', 'b', n, m)} FROM VALUES ({a}L, {b}L) AS t(a, b)").first()[0]
    assert of(a, b) == pytest.approx(ratio) and of(1, 40) == 0 and of(100, 0) == pytest.approx(-2 * (100 * math.log(0.2) + 400 * math.log(0.8)))


@settings(deadline=None, max_examples=100)
@given(st.text("aB é.!?\n_9😀İ", max_size=400))
def test_sentences_cover_all_words(text):
    parts = toxicity.sentences(text)
    assert all(a < b and toxicity._WORD.search(text, a, b) for a, b in parts)
    assert all(x[1] <= y[0] for x, y in itertools.pairwise(parts))
    inside = [w for a, b in parts for w in toxicity._WORD.findall(text[a:b])]
    assert inside == toxicity._WORD.findall(text)
    assert toxicity.spread_out(text, parts).count("\n") == max(0, len(parts) - 1)


def test_runs_are_found_as_by_definition():
    names = [" bad", "ad ", "bad", " bad ", "öse", "x\n"]
    model = toxicity.Model(names, np.ones(6), 0.0)
    text = "A bad, BAD thing. Goodbad? Böse Sachen!\nbadly"
    got = model.found(toxicity.spread_out(text, toxicity.sentences(text)))
    want = {(i, k) for k, (a, b) in enumerate(toxicity.sentences(text)) for w in toxicity._WORD.findall(text[a:b].lower()) for i, n in enumerate(names) if n in f" {w} "}
    assert set(zip(*(x.tolist() for x in got), strict=True)) == want


def test_held_out_documents_and_the_offending_sentence(spark):
    ship_package(spark)
    r = random.Random(1)
    common = ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki"]
    plain = lambda n: " ".join("".join(r.choices(common, k=r.randint(1, 3))) for _ in range(n))
    rows, labels, at = [], [], {}
    for i in range(900):
        lines = [plain(8) + "." for _ in range(r.randint(1, 12))]
        if i % 4 == 0:
            k = r.randrange(len(lines))
            lines[k] = f"{plain(2)} {r.choice(['vermin', 'Vermin!', 'louts'])} {plain(2)}."
            at[i] = sum(map(len, lines[:k])) + k
        rows.append((i, " ".join(lines)))
        labels.append((i, int(i % 4 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, known.where("doc_id < 600"))).where("doc_id >= 600").collect()
    assert sum((r["score"] >= toxicity.ACCEPT) == (r["doc_id"] % 4 == 0) for r in out) >= 0.98 * len(out)
    found = [r for r in out if r["doc_id"] in at and r["score"] >= toxicity.ACCEPT]
    hit = [any(s["start"] <= at[r["doc_id"]] + 12 and at[r["doc_id"]] <= s["end"] for s in r["offending"]) for r in found]
    assert sum(hit) >= 0.98 * len(found) > 0


def test_toxicity_of_awkward_rows(spark, awkward):
    ship_package(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, 1), (4, None), (6, 0), (7, 2), (99, 1), (10, 1), (10, 0)], "doc_id long, toxic int")
    model = toxicity.train(awkward, labels)
    out = toxicity.score(awkward, model).collect()
    assert len(out) == awkward.count() and all(0 <= r["score"] <= 1 for r in out)
    for few in (labels.limit(0), labels.where("toxic = 0")):
        flat = toxicity.score(awkward, toxicity.train(awkward, few)).collect()
        assert {r["score"] for r in flat} == {0.0}
    assert toxicity.score(awkward.limit(0), model).collect() == []
    assert toxicity.train(awkward.limit(0), labels).flat is not None
