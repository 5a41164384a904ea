import random
from collections import defaultdict

import numpy as np
import pytest

from redactum.llm import embedding_dedup, minhash
from redactum.llm.common import Workspace, connected_components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k, num, den):
    s = {i: shingles(t, k) for i, t in docs}
    ids = sorted(s)
    return roots(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b])])


@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 4, 5)])
def test_minhash_against_brute_force(spark, k, num, den):
    r = random.Random(k)
    v = [f"v{i}" for i in range(300)]
    docs = []
    for g in range(6):
        base = [r.choice(v) for _ in range(r.choice([4, 40, 120]))]
        for _ in range(60 if g == 0 else 12):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(v)
            docs.append((len(docs) * 7 % 1009, " ".join(w)))
    docs += [(5000, None), (5001, ""), (5002, "one"), (5003, "ONE"), (5004, "one two")]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=k, num=num, den=den, block=16).collect()
    assert {x.doc_id: x.component_id for x in got} == brute(docs, k, num, den)
    assert all(x.kept == (x.doc_id == x.component_id) and x.n_shingles == len(shingles(dict(docs)[x.doc_id], k)) for x in got)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(docs, words=3, num=85, den=100).collect()} == brute(rows, 3, 85, 100)


def test_bands_and_pruning_bounds():
    for t in (0.8, 0.85):
        bands, rows = minhash.banding(t)
        assert (1 - t**rows) ** bands <= minhash.MISS_BANDS and bands * rows <= minhash.HASHES
    least = [minhash.least_matches(0.85, n) for n in (32, 64, 96, 128)]
    assert least == sorted(least) and 0 < least[0] < 32 * 0.85


def test_minhash_awkward(awkward, empty):
    got = minhash.near_duplicates(awkward).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == awkward.count() and by[2].component_id == 1 and not by[2].kept and by[3].kept and by[4].component_id == 4 and by[None].kept
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_first(empty).count() == 0
    assert {x.doc_id for x in minhash.keep_first(awkward).collect()} == {x.doc_id for x in got if x.kept}


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 560)] + [(700, i) for i in range(600, 700)]
    got = {x.id: x.component for x in connected_components(spark, spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == roots(nodes, links)


def vectors(seed):
    g = np.random.default_rng(seed)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(40):
            base = g.standard_normal(16)
            for _ in range(int(g.integers(1, 4))):
                rows.append((n, [float(x) for x in base + g.standard_normal(16) * g.choice([0.0, 0.05, 0.3])], label))
                n += 1
    crowd = g.standard_normal(16)
    for _ in range(150):
        rows.append((n, [float(x) for x in crowd + g.standard_normal(16) * 0.2], 1))
        n += 1
    return rows + [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [1.0, None], 1), (n + 4, [], 1), (n + 5, [2.0, 2.0], 1), (n + 6, [1.0, 1.0], 1), (n + 7, [float("inf"), 1.0], 1), (0, rows[0][1], 0), (None, [1.0, 1.0], 1)]


def test_embeddings_against_brute_force(spark):
    rows = vectors(4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.embedding_duplicates(df.repartition(3), window=8, block=32).collect()
    ok = [(i, np.array(v), k) for i, v, k in rows if i is not None and k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, count = [], defaultdict(list)
    for n, (a, x, k) in enumerate(ok):
        total = 0
        for m, (b, y, j) in enumerate(ok):
            if m != n and k == j and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links.append((a, b))
                total += 1
        count[a].append(total)
    want = roots([i for i, _, _ in rows if i is not None], [x for x in links if x[0] != x[1]])
    assert len(got) == len(rows)
    for x in got:
        if x.vec_id is not None:
            assert x.component_id == want[x.vec_id] and x.n_links in count.get(x.vec_id, [0]) and x.kept == (x.vec_id == x.component_id)
        else:
            assert x.n_links == 0


def test_embeddings_empty(spark):
    assert embedding_dedup.embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int, rep long")).count() == 0


def test_embeddings_in_a_crowd_are_not_missed(spark):
    """Pairs at 0.94 among vectors at mutual cosines of about 0.85, which leading bits hardly split."""
    g = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(g.standard_normal(128))
    around = g.standard_normal((3000, 128))
    x = unit(centre + np.sqrt(1 / 0.85 - 1) * unit(around - (around @ centre)[:, None] * centre))
    off = g.standard_normal((1500, 128))
    y = unit(x[:1500] + np.sqrt(1 / 0.94**2 - 1) * unit(off - (off * x[:1500]).sum(axis=1, keepdims=True) * x[:1500]))
    every = np.concatenate([x, y])
    near = every @ every.T >= 0.93
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(every)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_duplicates(df, block=512).collect()}
    want = near.sum(axis=1) - 1
    assert (want[:1500] >= 1).all() and sum(got[i] != n for i, n in enumerate(want)) <= 15


def test_one_row_of_each_group_stays(spark):
    t = "one two three four five six seven eight nine ten"
    other = t + " eleven"
    rows = [(None, t, 1), (None, t, 2), (3, other, 3), (3, other, 4), (5, t, 5), (None, "no such words at all here", 6), (None, "no such words at all here", 7), (8, None, 8), (8, None, 9), (9, "", 10), (9, " ", 11), (10, "alone", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_ int")
    got = sorted((r.doc_id or 0, r.text) for r in minhash.keep_first(docs, words=3, num=4, den=5).select("doc_id", "text").collect() if r.text and r.text.strip())
    assert got == [(0, "no such words at all here"), (3, other), (10, "alone")]
    kept = minhash.keep_first(docs, words=3, num=4, den=5)
    assert kept.columns == docs.columns and {r.row_ for r in kept.collect()} >= {8, 9, 10, 11, 12}
