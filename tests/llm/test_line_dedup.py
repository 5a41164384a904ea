import hashlib
import random

import pytest

from redactum.llm import line_dedup as m


def brute(docs):
    """{doc_id: (kept text, removed, near)} by comparing every line with every earlier one."""
    seen, out = [], {}
    for i, text in sorted(docs):
        kept, removed, near = [], 0, 0
        for line in text.split("\n"):
            w = line.encode().split()
            if not w:
                kept.append(line)
                continue
            same = any(w == x for x in seen)
            close = len(w) >= m.NEAR_WORDS and any(len(x) >= m.NEAR_WORDS and x != w and m.within_one_edit(w, x) for x in seen)
            if same or close:
                removed += 1
                # a line counts as near if its class has an earlier near line
                first = next((k for k, x in enumerate(seen) if x == w), len(seen))
                near += any(len(x) >= m.NEAR_WORDS and len(w) >= m.NEAR_WORDS and x != w and m.within_one_edit(w, x) for x in seen[:first])
            else:
                kept.append(line)
            seen.append(w)
        out[i] = ("\n".join(kept), removed, near)
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([3, 10, 11, 15, 30]))] for _ in range(25)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(1, 6)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                at = r.randrange(len(w))
                kind = r.randrange(3)
                w[at : at + (kind != 0)] = [] if kind == 2 and len(w) > 1 else [r.choice(vocabulary)]
            lines.append(r.choice(["", " "]).join(["", " ".join(w)]))
        docs.append((i, "\n".join([*lines, ""])))
    want = brute(docs)
    got = m.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {x.doc_id: (x.text, x.n_removed, x.n_near) for x in got} == want


@pytest.mark.parametrize("a,b,ok", [("a b c", "a b c", True), ("a b c", "a x c", True), ("a b c", "a c", True), ("b c", "a b c", True), ("a b c", "a x y", False), ("a b", "a b c d", False), ("", "a", True)])
def test_edits(a, b, ok):
    assert m.within_one_edit(a.split(), b.split()) is ok is m.within_one_edit(b.split(), a.split())


def test_awkward(awkward, empty):
    got = {(x.doc_id, x.n_removed, None if x.text is None else len(x.text)) for x in m.dedup_lines(awkward).collect()}
    assert len(m.dedup_lines(awkward).collect()) == awkward.count()
    assert (3, 0, None) in got and (4, 0, 0) in got and (2, 1, 0) in got
    assert (1, 0, 56) in got, "rows equal in key and text are treated alike: both keep the first occurrence"
    assert m.dedup_lines(empty).count() == 0
    assert set(awkward.columns) <= set(m.dedup_lines(awkward).columns)


def test_digest_is_of_the_text(spark):
    df = m.dedup_lines(spark.createDataFrame([(1, "a\na\nb")], "doc_id long, text string")).first()
    assert hashlib.sha256(df.text.encode()).hexdigest() == hashlib.sha256(b"a\nb").hexdigest()


def test_repeated_rows_keep_their_first_lines(spark):
    a = "one two three four five six seven eight nine ten"
    b = "one two three four five and now for something else entirely"
    rows = [(1, a), (1, a), (2, b), (None, f"{b} x y"), (None, f"{b} x y"), (3, a)]
    got = sorted((str(x.doc_id), x.text, x.n_removed, x.n_near) for x in m.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", a, 0, 0), ("1", a, 0, 0), ("2", b, 0, 0), ("None", f"{b} x y", 0, 0), ("None", f"{b} x y", 0, 0), ("3", "", 1, 0)])
