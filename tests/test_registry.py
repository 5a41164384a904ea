import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from redactum.operators import registry as m
from redactum.operators.detect import detect
from redactum.operators.replace import replace

SECRET = b"k" * 32


def whole(label, value):
    return hmac.new(SECRET, f"{label}:{value}".encode(), hashlib.sha256).hexdigest()


def brute(values, known, digits):
    """Widths by definition: the fewest digits that no other hash of the label starts with."""
    out = dict(known)
    every = {(k, whole(k, v)) for k, v in values} | set(known)
    for label, h in every - set(known):
        others = [o for k, o in every if k == label and o != h]
        out[label, h] = next(w for w in range(digits, 65) if w == 64 or not any(o[:w] == h[:w] for o in others))
    return out


def widths(df):
    return {(r.label, r.hash): r.width for r in df.collect()}


@pytest.mark.parametrize("digits", [1, 2, 8])
def test_collisions_get_more_digits_and_batches_agree(spark, digits):
    first = [(k, f"v{i}") for i in range(150) for k in ("NAME", "MRN")] + [("NAME", None), ("NAME", "v1")]
    later = [("NAME", f"v{i}") for i in range(100, 400)] + [("EMAIL", "a@b.org")]
    frame = lambda rows: spark.createDataFrame(rows, "label string, value string")
    one = m.extended(m.token_hashes(frame(first), SECRET), None, digits)
    want = brute([x for x in first if x[1]], {}, digits)
    assert widths(one) == want == widths(m.extended(m.token_hashes(frame(first[::-1]).repartition(5), SECRET), None, digits))
    two = m.extended(m.token_hashes(frame(later), SECRET), one, digits)
    assert widths(two) == brute(later, want, digits)
    names = [r.pseudonym for r in m.named(two.select("label", "hash"), two).collect()]
    assert len(set(names)) == len(names) and (digits == 8 or max(widths(two).values()) > digits)


def test_no_secret_in_a_plan(spark):
    df = m.token_hashes(spark.createDataFrame([("NAME", "x")], "label string, value string"), SECRET)
    text = df._jdf.queryExecution().toString()
    assert SECRET.hex() not in text and SECRET.decode() not in text and df.first().hash == whole("NAME", "x")


def test_texts_take_the_registrys_names(spark):
    texts = ["mail a@b.org or c@d.org", "c@d.org again, not [NAME-0A]", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = replace(detect(df), "PSEUDONYMISE", SECRET, digits=m.WHOLE).select("id", F.col("replacement.text").alias("text"))
    tokens = spark.createDataFrame([("EMAIL", f"u{i}@b.org") for i in range(300)] + [("EMAIL", "a@b.org"), ("EMAIL", "c@d.org")], "label string, value string")
    known = m.extended(m.token_hashes(tokens, SECRET), None, 2)
    name = {r.value: r.pseudonym for r in m.named(m.token_hashes(tokens, SECRET), known).collect()}
    got = {r.id: r.text for r in m.shortened(out, "id", known).collect()}
    assert got == {0: f"mail {name['a@b.org']} or {name['c@d.org']}", 1: f"{name['c@d.org']} again, not [NAME-0A]", 2: None, 3: ""}
    assert len(name["a@b.org"]) < 16
    bare = {r.id: r.text for r in m.shortened(out, "id", known.limit(0)).collect()}
    assert bare[1].startswith(f"[EMAIL-{whole('EMAIL', 'c@d.org').upper()}]")
