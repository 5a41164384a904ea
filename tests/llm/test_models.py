import math
import zlib
from collections import Counter

import numpy as np
import pytest

from redactum.llm import language_id as lid
from redactum.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    got = queries.op5_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean() > 0.95
    assert good.predicted.mean() > 0.98 and (held.predicted == held.quality).mean() > 0.9
    assert set(got.score.between(0, 1)) == {True}


def test_prior_is_estimated():
    r = np.random.default_rng(1)
    p, u = r.normal(3, 1, 2000), np.concatenate([r.normal(3, 1, 2100), r.normal(-3, 1, 900)])
    assert quality.estimate_prior(p, u) == pytest.approx(0.7, abs=0.03)


def test_negative_risk_is_not_followed():
    r = np.random.default_rng(2)
    x = lambda m, n: r.normal(m, 1, (n, 3))
    model = quality.fit(x(2, 300), np.concatenate([x(2, 300), x(-2, 300)]))
    assert model.score(x(2, 200)).mean() > 0.8 and model.score(x(-2, 200)).mean() < 0.2


def test_prior_counts_rows_of_one_score_at_once():
    r = np.random.default_rng(4)
    p, u = r.normal(2, 1, 500).round(1), np.concatenate([r.normal(2, 1, 900), r.normal(-2, 1, 600)]).round(1)
    assert quality.estimate_prior(p, u) == pytest.approx(quality.estimate_prior(p, *(x.astype(float) for x in np.unique(u, return_counts=True))))


@pytest.mark.parametrize("prior,followed", [(0.3, 1), (0.95, -1), (None, 1)])
def test_risk_and_slope_by_definition(prior, followed):
    """The risk from its terms, row by row; its slope from differences. Above a prior that is too large it is climbed."""
    r = np.random.default_rng(7)
    bp, bu = r.integers(0, 3, (6, 2)) + [0, 3], r.integers(0, 3, (9, 2)) + [0, 3]
    bu[:4] = bp[:4]
    w = r.normal(1, 0.5, 7)
    share = lambda row, w: 1 / (1 + math.exp(-(sum(w[i] for i in row) + w[6])))

    def terms(w):
        positive = sum(-math.log(share(b, w)) for b in bp) / len(bp)
        as_negative = sum(-math.log(1 - share(b, w)) for b in bp) / len(bp)
        unlabelled = sum(-math.log(1 - share(b, w)) for b in bu) / len(bu)
        return (positive, unlabelled) if prior is None else (prior * positive, unlabelled - prior * as_negative)

    positive, negative, slope = quality.risk(w, bp, bu, prior)
    assert (positive, negative) == pytest.approx(terms(w)) and (negative >= 0) == (followed > 0)
    of = (lambda w: sum(terms(w))) if followed > 0 else (lambda w: -terms(w)[1])
    for i, e in enumerate(np.eye(7) * 1e-6):
        assert slope[i] == pytest.approx((of(w + e) - of(w - e)) / 2e-6, abs=1e-6)


def test_prior_and_edges_come_from_all_rows(spark, monkeypatch):
    """However few rows the fit reads, what it is told of the corpus does not change."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda p, u, edges, prior: seen.append((len(u), edges, prior)))
    docs = spark.createDataFrame([(i, ("good text number. " if i % 10 < 6 else "JUNK!! ### ") * (1 + i % 7)) for i in range(3000)], "doc_id long, text string")
    for most in (500, 3000):
        quality.train(docs, docs.where("doc_id % 10 < 2").select("doc_id"), unlabelled_rows=most)
    (few, a, x), (many, b, y) = seen
    assert few < 700 < many and (a == b).all() and x == pytest.approx(0.6, abs=0.05) and y == pytest.approx(0.6, abs=0.05)


def test_quality_rows_are_bounded_whatever_their_keys(spark, monkeypatch):
    rows = [(7, f"good text number {i}.") for i in range(4000)] + [(None, f"null {i}") for i in range(4000)] + [(8, "the same row")] * 4000
    seen = []
    monkeypatch.setattr(quality, "fit", lambda p, u, *_: seen.append((len(p), len(u))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    quality.train(docs, spark.createDataFrame([(7,), (8,)], "doc_id long"), positive_rows=200, unlabelled_rows=300)
    ((p, u),) = seen
    assert 50 < p < 300 and 100 < u < 450


def test_quality_awkward(awkward, empty, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (77, 1)], "doc_id long, quality int")
    assert [r.doc_id for r in quality.trusted(labels).where("doc_id IS NOT NULL").orderBy("doc_id").collect()] == [2, 77]
    model = quality.train(awkward, quality.trusted(labels))
    assert quality.score(awkward, model).count() == awkward.count() and quality.score(empty, model).count() == 0
    assert quality.train(empty, quality.trusted(labels)) is None and {r.score for r in quality.score(awkward, None).collect()} == {0.5}


def test_features_see_the_whole_text():
    assert quality.features(None) == quality.features("") and quality.features("a b") != quality.features("a b" + " c" * 50_000)


def test_language_held_out(spark):
    got = queries.op6_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id]).all()
    assert (held.lang_pred == held.lang).mean() > 0.97


def grams_table(spark, texts):
    return spark.createDataFrame([(k, w) for k, words in texts.items() for w in words], "lang string, text string")


def brute_kneser_ney(texts, order=lid.ORDER):
    """P(word) by language from the definition, one place at a time."""
    raw = {k: Counter(g for w in words for g in lid.grams_of(w, order)) for k, words in texts.items()}
    symbols = {g[-1] for c in raw.values() for g in c}
    floor = 1 / (len(symbols) + 1)

    def used(k, n):
        if n == order:
            return {g: c for g, c in raw[k].items() if len(g) == order}
        above = Counter(g[1:] for g in used(k, n + 1))
        return {**above, **{g: c for g, c in raw[k].items() if len(g) == n and g[0] == lid.START}}

    levels = {k: [None, *(used(k, n) for n in range(1, order + 1))] for k in texts}

    def p(k, g):
        if not g:
            return floor
        use = levels[k][len(g)]
        n1, n2 = (sum(c == x for c in use.values()) for x in (1, 2))
        d = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
        same = {h: c for h, c in use.items() if h[:-1] == g[:-1]}
        if not same:
            return p(k, g[1:])
        total = sum(same.values())
        return max(use.get(g, 0) - d, 0) / total + d * len(same) / total * p(k, g[1:])

    return lambda k, word: sum(math.log(p(k, g)) for g in lid.grams_of(word, order))


TEXTS = {"a": ["abc", "abd", "bca", "hello", "help", "yellow", "abc"], "b": ["ccc", "cab", "é", "été"], "c": ["x"]}
WORDS = ["abc", "hello", "zzz", "h", "yelp", "é", "cabbed", "x", "étéx"]


def trained(spark, texts, **how):
    return lid.train(grams_table(spark, texts), **how)


def test_kneser_ney_is_the_brute_force_one(spark):
    want, model = brute_kneser_ney(TEXTS), trained(spark, TEXTS)
    assert model.langs == ["a", "b", "c"]
    assert np.allclose(model.score_words(WORDS), [[want(k, w) for k in model.langs] for w in WORDS], atol=1e-4)


def test_kneser_ney_sums_to_one(spark):
    want = brute_kneser_ney(TEXTS)
    model = trained(spark, TEXTS)
    assert np.allclose(model.score_words(["ab"]), [[want(k, "ab") for k in model.langs]], atol=1e-4)
    symbols = {g[-1] for words in TEXTS.values() for w in words for g in lid.grams_of(w)} - {lid.END}
    # Words of one symbol and longer ones, with one symbol that no language knows: first places sum to one.
    for k in range(len(model.langs)):
        first = [math.exp(_place(model, s)[k]) for s in [*symbols, "\x7f"]] + [math.exp(_place(model, lid.END)[k])]
        assert sum(first) == pytest.approx(1, abs=1e-4)


def _place(model, symbol):
    """Log probability of a symbol after the start mark."""
    g, b = lid.START + symbol, model.block((0, 0))
    total = np.zeros(len(model.langs))
    for n in (2, 1):
        at, hit = b._find(b.grams[n - 1], lid._hash_one([g[-n:]]))
        if hit[0]:
            return total + b.grams[n - 1][1][at[0]]
        if n > 1:
            at, hit = b._find(b.contexts[n - 1], lid._hash_one([g[:-1]]))
            total += b.contexts[n - 1][1][at[0]] if hit[0] else 0
    return total + model.unknown


def _bytes(model):
    tables = [t for place in model.places() for t in (*model.block(place).grams, *model.block(place).contexts)]
    return sum(k.nbytes + v.nbytes for k, v in tables) // len(model.places())


def test_blocks_add_up(spark, awkward):
    one = lid.train(awkward)
    more = lid.train(awkward, block_bytes=_bytes(one) // 2)
    assert len(one.places()) == 1 and 1 < len(more.places()) < 6
    assert np.allclose(one.score_words(WORDS), more.score_words(WORDS), atol=1e-4)
    get = lambda m: sorted((str(r.doc_id), r.lang_pred, round(r.score, 6), r.rejected) for r in lid.identify(awkward, m).collect())
    assert get(one) == get(more)
    many = {f"l{i:02d}": [w + chr(97 + i) for w in WORDS] for i in range(9)}
    want, model = brute_kneser_ney(many), trained(spark, many)
    assert len(model.places()) == 2 and np.allclose(model.score_words(WORDS), [[want(k, w) for k in model.langs] for w in WORDS], atol=1e-4)


def test_a_small_language_stays(spark):
    docs = [("en", f"the {w} and the {w[::-1]} went over the hills") for w in map("w{}ay".format, range(700))]
    few = [("xx", "zqé qzé zzéq"), ("xx", "qéz zéq"), ("xx", "ézzq qqéz")]
    rows = spark.createDataFrame(docs + few, "lang string, text string")
    for block_bytes in (lid.BLOCK_BYTES, 40_000):
        model = lid.train(rows, block_bytes=block_bytes)
        assert model.langs == ["en", "xx"]
        assert {r.lang_pred for r in lid.identify(spark.createDataFrame(few, "lang string, text string"), model).collect()} == {"xx"}
    # English is calibrated on texts that it did not learn from; the small language takes that limit.
    assert np.isfinite(model.limits).all() and model.limits[0] == model.limits[1]


def test_language_awkward(awkward, empty):
    model = lid.train(awkward)
    got = {r.doc_id: r for r in lid.identify(awkward, model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[8].lang_pred == "und" and got[7].lang_pred == "fr"
    signs = awkward.sparkSession.createDataFrame([(1, "½ ² Ⅷ"), (2, "m²"), (3, "٣")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in lid.identify(signs, model).collect()} == {1: True, 2: False, 3: True}
    assert lid.train(empty) is None and {r.lang_pred for r in lid.identify(awkward, None).collect()} == {"und"}
    assert lid.identify(empty, model).count() == 0
    assert lid.identify(awkward, model, reject=True).count() == awkward.count()
