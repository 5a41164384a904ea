import random

import pytest
from pyspark.sql import functions as F

from redactum.functions.rules import PARTICLES, PRIORITY, RULES
from redactum.functions.sql import pieces, to_java
from redactum.operators.detect import SPAN, cut_sql, default_quasi, detect, label_counts, matches_sql, merge_sql, passes, run_rules
from redactum.operators.model_spans import TOKEN, groups_sql, token_spans, with_model

SNIPPETS = [
    ("mail Ann.B+c@x-y.example.org now", "EMAIL", "Ann.B+c@x-y.example.org"), ("see https://a.b/c?d=e f", "URL", "https://a.b/c?d=e"), ("from 10.0.255.1.", "IP", "10.0.255.1"),
    ("2001:0db8:0000:0000:0000:ff00:0042:8329", "IP", "2001:0db8:0000:0000:0000:ff00:0042:8329"), ("SSN 123-45-6789", "SSN", "123-45-6789"), ("no 943 476 5919 x", "NHS_NUMBER", "943 476 5919"),
    ("code 6120847732", "REFERENCE_ID", "6120847732"), ("NI AB 12 34 56 C", "UK_NINO", "AB 12 34 56 C"), ("010190-1234", "NATIONAL_ID_DK_CPR", "010190-1234"), ("DNI 12345678Z", "NATIONAL_ID_ES", "12345678Z"),
    ("CF RSSMRA85T10A562S", "NATIONAL_ID_IT_CF", "RSSMRA85T10A562S"), ("AHV 756.1234.5678.97", "NATIONAL_ID_CH_AHV", "756.1234.5678.97"), ("BSN: 123456782", "NATIONAL_ID_NL_BSN", "BSN: 123456782"),
    ("IBAN GB82WEST12345698765432", "IBAN", "GB82WEST12345698765432"), ("passport no: AB1234567", "PASSPORT", "passport no: AB1234567"), ("call +44 161 496 0102", "PHONE", "+44 161 496 0102"),
    ("Fax: 0161 496 0102", "FAX", "Fax: 0161 496 0102"), ("MRN: A12-345", "MRN", "MRN: A12-345"), ("member id 12345", "INSURANCE_ID", "member id 12345"), ("acct 9981X", "ACCOUNT_NUMBER", "acct 9981X"),
    ("licence no 55511", "LICENSE", "licence no 55511"), ("GMC: 6184472", "LICENSE", "GMC: 6184472"), ("bleep 4417", "DEVICE_ID", "bleep 4417"), ("1HGCM82633A004352", "VEHICLE_VIN", "1HGCM82633A004352"),
    ("Trust Reference: NWGH-DSC-2024", "REFERENCE_ID", "Trust Reference: NWGH-DSC-2024"), ("at SW1A 2AA", "POSTCODE_UK", "SW1A 2AA"), ("PLZ 10115", "POSTCODE_EU", "PLZ 10115"), ("NY 10001-1234", "POSTCODE_US", "10001-1234"),
    ("12 Dún Laoghaire Quay", "ADDRESS_LINE", "12 Dún Laoghaire Quay"), ("on 2 Jan 2024 ok", "DATE", "2 Jan 2024"), ("on Jan 2nd, 2024", "DATE", "Jan 2nd, 2024"), ("left thumbprint", "BIOMETRIC", "thumbprint"),
    ("Dr Hövding", "NAME", "Dr Hövding"), ("seen by Prof. Anna van der Berg today", "NAME", "Prof. Anna van der Berg"), ("signed by Eveline Achterberg\nDOB", "NAME", "signed by Eveline Achterberg"),
    ("Bernadette Aikens, RN", "NAME", "Bernadette Aikens, RN"), ("specialist nurse Karoline Stenberg", "NAME", "specialist nurse Karoline Stenberg"), ("his wife Asma al-Hashimi said", "NAME", "his wife Asma al-Hashimi"),
    ('"family": "Achterberg"', "NAME", '"family": "Achterberg"'), ("code Q91.0", "RARE_DISEASE_ICD", "Q91.0"), ("St Mary Hospital", "INSTITUTION", "St Mary Hospital"), ("ethnicity: asian", "ETHNICITY", "asian"),
    ("Occupation: retired teacher\nEthnicity", "OCCUPATION", "Occupation: retired teacher"), ("age 94", "AGE_OVER_89", "age 94"), ("94 years old", "AGE_OVER_89", "94 years old"),
]
NOTHING = ["000-12-3456 ".replace("000-12-3456", "x"), "age 87", "ISO 27001", "specialist nurse home visit", "code I10 and E11.9", "capable 12", None, "", "\x01\x02\x03"]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r.id: [*r.detection.spans, *r.detection.quasi] for r in detect(df).collect()}


def test_snippets(spark):
    got = found(spark, [t for t, _, _ in SNIPPETS])
    for i, (text, label, value) in enumerate(SNIPPETS):
        spans = [(s.label, s.text) for s in got[i]]
        assert (label, value) in spans, (text, spans)
        assert all(text[s.start : s.end] == s.text or s.cap_start is None for s in got[i])


def test_nothing(spark):
    got = found(spark, NOTHING)
    assert {i: [(s.label, s.text) for s in v] for i, v in got.items() if v} == {}


def test_catalogue_shape():
    assert len(RULES) == 41 and len({r.label for r in RULES}) == 34 and PRIORITY["LICENSE"] == 88 and PRIORITY["NAME"] == 86


def test_gates_hold_for_the_snippets():
    for text, label, value in SNIPPETS:
        rules = [r for r in RULES if r.label == label or (label == "REFERENCE_ID" and r.label == "NHS_NUMBER")]
        assert any((not r.gate or any(g in text.lower() for g in r.gate)) and (not r.digit or any(c.isdigit() for c in text)) for r in rules), (text, value)


def test_dialect():
    assert to_java(r"[\s\-]?\S", "").startswith("[\\t") and "(?i)" in to_java("a", "i") and to_java("a", "iu").startswith("(?iu)")


def test_blanks_and_boundaries(spark):
    rows = ["MRN: ABCD", "éMRN: ABCD", "MRN\x1f: ABCD", "1MRN: ABCD", "MRN\xa0: ABCD", "é12345"]
    got = found(spark, rows)
    assert [s.label for s in got[4]] == ["MRN"] and [s.label for s in got[5]] == ["POSTCODE_US"]
    assert [s.label for s in got[0]] == ["MRN"] and [s.label for s in got[1]] == ["MRN"] and not got[2] and not got[3]


def test_offsets_are_code_points(spark):
    df = spark.createDataFrame([("😀 a1 b2",)], "t string").select(F.expr(matches_sql("t", "([a-z])[0-9]", 1)).alias("m"))
    assert [(x.s, x.m, x.c) for x in df.first().m] == [(2, "a1", "a"), (5, "b2", "b")]


def fold(spans):
    merged = []
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if not merged or s["start"] >= merged[-1]["end"]:
            merged.append(dict(s))
            continue
        a = merged[-1]
        la, lb = a["end"] - a["start"], s["end"] - s["start"]
        if a["prio"] != s["prio"]:
            first = a["prio"] > s["prio"]
        elif la != lb:
            first = la > lb
        else:
            first = a["source"] == "ner"
        merged[-1] = dict(a if first else s) | {"start": a["start"], "end": max(a["end"], s["end"]), "cap_start": None, "cap_end": None}
    return merged


def test_merge_is_the_fold(spark):
    r = random.Random(9)
    rows = []
    for i in range(400):
        spans = []
        for k in range(r.randint(0, 9)):
            s = r.randint(0, 25)
            spans.append({"start": s, "end": s + r.randint(1, 8), "text": f"t{k}", "label": r.choice("ABC"), "category": "HIPAA", "source": r.choice(["rule", "ner"]), "confidence": 1.0, "cap_start": None, "cap_end": None, "rare_tier": None, "prio": r.choice([50, 70, 88])})
        rows.append((i, spans))
    df = spark.createDataFrame(rows, f"id long, s array<{SPAN}>").select("id", F.expr(merge_sql("s")).alias("m"))
    got = {x.id: [s.asDict() for s in x.m] for x in df.collect()}
    assert got == {i: fold(s) for i, s in rows}


def test_touching_and_union(spark):
    spans = lambda *p: [(s, e, "x", "L", "HIPAA", "rule", 1.0, None, None, None, q) for s, e, q in p]
    df = spark.createDataFrame([(spans((0, 10, 70), (8, 15, 88)),), (spans((0, 5, 50), (5, 9, 50)),)], f"s array<{SPAN}>").select(F.expr(merge_sql("s")).alias("m"))
    assert [[(s.start, s.end, s.prio) for s in r.m] for r in df.collect()] == [[(0, 15, 88)], [(0, 5, 50), (5, 9, 50)]]


def test_model_spans_and_buckets(spark):
    def load():
        return lambda texts: [[{"entity": "B-PER", "word": "x", "start": t.find("Holloway"), "end": t.find("Holloway") + 8, "score": 0.9 if "sure" in t else 0.6 if "maybe" in t else 0.3}] if "Holloway" in t else [] for t in texts]

    df = spark.createDataFrame([(1, "sure Holloway"), (2, "maybe Holloway"), (3, "no Holloway"), (4, None)], "id long, text string")
    got = {r.id: r.detection for r in detect(with_model(df, load), model_spans="model_spans").collect()}
    assert [s.text for s in got[1].spans] == ["Holloway"] and not got[2].spans and [s.text for s in got[2].uncertain] == ["Holloway"] and not got[3].spans and not got[3].uncertain and not got[4].spans

    def broken():
        def fail(texts):
            raise RuntimeError

        return fail

    assert with_model(df, broken).where("size(model_spans) > 0 OR model_spans_error IS NULL").count() == 0

    def picky():
        def model(texts):
            if any("maybe" in t for t in texts):
                raise ValueError("cannot")
            return load()(texts)

        return model

    rows = {r.id: (len(r.model_spans), r.model_spans_error) for r in with_model(df.coalesce(1), picky).collect()}
    assert rows == {1: (1, None), 2: (0, "ValueError: cannot"), 3: (1, None), 4: (0, None)}


def token(entity, start, end, score=0.99):
    return {"entity": entity, "word": "", "start": start, "end": end, "score": score}


def grouped(tokens, text):
    """The definition: an entity at a time, each token looked at with the last entity."""
    out = []
    for t in tokens:
        tag, _, kind = t["entity"].rpartition("-")
        gap = text[out[-1][2] : t["start"]] if out else ""
        if out and out[-1][0] == kind and not gap.strip() and (not gap or tag != "B"):
            out[-1][2:] = [t["end"], [*out[-1][3], t["score"]]]
        else:
            out.append([kind, t["start"], t["end"], [t["score"]]])
    return [(k, s, e, pytest.approx(sum(x) / len(x))) for k, s, e, x in out]


def test_token_groups(spark):
    t = "Anjula Weeranayake wrote this."
    rows = [([token("B-PER", 0, 2), token("I-PER", 2, 4), token("I-PER", 4, 6), token("I-PER", 7, 9), token("I-PER", 9, 18)], t), ([token("B-PER", 0, 5), token("B-PER", 10, 13)], "Alice met Bob."), ([token("B-ORG", 0, 4), token("I-ORG", 10, 19)], "NIST, and Microsoft"), ([], ""), ([], "x" * 3000)]
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choices("ab \n,é", k=40))
        places = sorted(r.sample(range(41), 8))
        rows.append(([token(r.choice(["B-", "I-", ""]) + r.choice(["PER", "LOC"]), a, b, r.random()) for a, b in zip(places[::2], places[1::2], strict=True)], text))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], f"id long, tokens array<{TOKEN}>, text string")
    got = {x.id: [(g.kind, g.s, g.e, g.score) for g in x.g] for x in df.select("id", F.expr(groups_sql("tokens", pieces("text"))).alias("g")).collect()}
    assert got == {i: grouped(*x) for i, x in enumerate(rows)}
    assert len(got[0]) == 1 and t[got[0][0][1] : got[0][0][2]] == "Anjula Weeranayake" and len(got[1]) == len(got[2]) == 2


@pytest.mark.parametrize("tokens,text,want", [
    ([token("B-ORG", 0, 2), token("B-ORG", 13, 14)], "An update on N systems.", []), ([token("B-PER", 10, 12)], "Signed by Weeranayake today.", ["Weeranayake"]), ([token("B-LOC", 0, 9)], "DISCHARGE SUMMARY for review.", []),
    ([token("B-ORG", 8, 18), token("I-ORG", 19, 28), token("I-ORG", 29, 33)], "Seen at Manchester Discharge Unit.", ["Manchester Discharge Unit"]),
])
def test_tokens_to_spans(spark, tokens, text, want):
    df = spark.createDataFrame([(tokens, text)], f"tokens array<{TOKEN}>, text string")
    assert [s.text for s in token_spans(df).first().model_spans] == want
    assert all(s.start >= 100 for s in token_spans(df, offset="100").first().model_spans)


def test_spans_of_awkward_texts(spark):
    long = "x" * 5000
    rows = [(1, [token("B-PER", 3000, 3002)], f"{long} y"), (2, [token("B-PER", 0, 1)], None), (3, None, "Bob"), (4, [token("B-ORG", 1, 3), token("B-MISC", 5, 9), token("PER", 5, 7)], "Ünï O'Neill-Smith, Bob"), (5, [token("B-LOC", 5004, 5006)], f"{long} 😀Àbcd e")]
    out = {r.id: [(s.start, s.end, s.text, s.label, s.category) for s in r.model_spans] for r in token_spans(spark.createDataFrame(rows, f"id long, tokens array<{TOKEN}>, text string")).collect()}
    assert out[1] == [(0, 5000, long, "NAME", "HIPAA")] and out[2] == [] == out[3]
    assert out[4] == [(0, 3, "Ünï", "INSTITUTION", "QUASI"), (4, 17, "O'Neill-Smith", "NAME", "HIPAA")] and out[5] == [(5002, 5006, "Àbcd", "ADDRESS_LINE", "HIPAA")]


def test_forced_and_counts(spark):
    df = spark.createDataFrame([(1, "Achterberg", "NAME"), (2, "  ", "NAME"), (3, "a@b.cd", None)], "id long, text string, forced string")
    out = detect(df, forced_label="forced")
    got = {r.id: [(s.start, s.end, s.label) for s in r.detection.spans] for r in out.collect()}
    assert got == {1: [(0, 10, "NAME")], 2: [], 3: [(0, 6, "EMAIL")]}
    assert {(r.label, r.n) for r in label_counts(out).collect()} == {("NAME", 1), ("EMAIL", 1)}


def test_default_quasi_and_catalogue(spark):
    df = spark.createDataFrame([("Q91.0 at St Mary Hospital",)], "text string")
    seen = detect(df)
    assert default_quasi(seen, False).first().redact == []
    assert set(default_quasi(seen, True).first().redact) == {"RARE_DISEASE_ICD", "INSTITUTION"}
    assert default_quasi(detect(df, catalogue={"Q91": "auto"}), False).first().redact == ["RARE_DISEASE_ICD"]
    assert run_rules(df, labels=["RARE_DISEASE_ICD"], catalogue={"I10": "flag"}).first().rule_spans == []
    assert len(PARTICLES) == 17


def test_rules_together_find_what_each_finds_alone(spark):
    rnd = random.Random(3)
    values = [v for _, _, v in SNIPPETS] + ["a@b.com_x@y.org", "ſigned by Ann Lee", "xſigned by Ann Lee", "é", "ISO 27001", "12 A 13 B Street", "St Mary Hospital Clinic", "_", "\x01"]
    texts = [rnd.choice(["", " ", ", ", "-"]).join(rnd.choices(values, k=rnd.randint(1, 9))) for _ in range(400)] + [" ".join(rnd.choices(values, k=600))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    together = {r.id: [tuple(s) for s in r.s] for r in run_rules(df, "text", "s").collect()}
    alone: dict[int, list] = {i: [] for i in together}
    for label in dict.fromkeys(r.label for r in RULES):
        assert not passes([r for r in RULES if r.label == label][:1])
    for n, rule in enumerate(RULES):
        parts = df.select("id", F.expr(f"transform({matches_sql('translate(text, chr(1), chr(65533))', to_java(rule.pattern, rule.flags), rule.groups)}, h -> h.s)").alias("at")).collect()
        for r in parts:
            alone[r.id] += [(n, at) for at in r.at]
    # Names, NHS numbers, codes and ages are tested further; of the others every place is a span's.
    further = {"NAME", "NHS_NUMBER", "REFERENCE_ID", "RARE_DISEASE_ICD", "AGE_OVER_89"}
    for i, spans in together.items():
        want = sorted((RULES[n].label, at) for n, at in alone[i] if RULES[n].label not in further)
        assert want == sorted((s[3], s[0]) for s in spans if s[3] not in further), texts[i]


def test_all_rules_take_few_walks_over_a_text():
    assert cut_sql(RULES).count("regexp_replace(") <= 6
