import random

from redactum.llm import decontaminate as m


def brute(text, items):
    words = m.words_of(text)
    hit, owners = [False] * len(words), set()
    for key, t in items:
        for w in m.windows_of(m.words_of(t), m.WINDOW):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit[i : i + len(w)] = [True] * len(w)
                    owners.add(key)
    return len(words), sum(hit), sorted(map(str, owners))


def test_against_brute_force(spark):
    r = random.Random(5)
    v = ["alpha", "beta", "GAMMA", "delta", "épsilon", "z9"]
    text = lambda n: r.choice([" ", ", ", "_"]).join(r.choice(v) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 5, 12, 13, 14, 30]))) for i in range(3, 25)] + [(99, None), (98, "")]
    docs = [(i, text(r.randint(0, 60)) + " " + (r.choice(items)[1] or "") + " " + text(3)) for i in range(80)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = {i: brute(t, items) for i, t in docs}
    for block in (1_000_000, 40):  # in one block and in many
        got = {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in m.contamination(d, b, block_words=block).collect()}
        assert got == want


def test_rule():
    assert m.WINDOW == 13 and m.PERCENT == 5
    assert m.words_of("ÄB-c_1é") == ["Äb", "c", "1é"]


def test_awkward(awkward, empty, spark):
    b = spark.createDataFrame([(1, "the cat sat on the mat and looked at the dog in the yard"), (None, "123"), (2, None)], "item_id long, text string")
    got = {x.doc_id: x for x in m.contamination(awkward, b).collect()}
    assert got[2].contaminated and got[2].n_hit == 14 and got[2]["items"] == ["1"]
    assert got[3].n_words == 0 and not got[3].contaminated and got[8]["items"] == [""]
    assert m.contamination(empty, b).count() == 0
    assert m.contamination(awkward, b.limit(0)).where("contaminated").count() == 0
    assert "odd name" in m.contamination(awkward, b).columns
