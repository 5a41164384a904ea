"""Further queries: texts that hold every rule and near misses of it, and the steps of the
flow over them, with SQL that finds the same by its own means.

``{k}`` is a BIGINT key; where both engines read the same SQL, it is written once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.functions import crypto, dates
from redactum.functions.rare_icd10 import RARE_CODES
from redactum.functions.rules import RULES
from redactum.operators import review
from redactum.operators.detect import SPAN, default_quasi, detect, merge_sql, run_rules
from redactum.operators.risk import assess_risk
from redactum.operators.validate import emit_allowed, release_allowed, validate
from redactum.plans.files import deidentify_files
from redactum.plans.pipeline import batch_progress, deidentify_texts, run_batch
from redactum.queries import _NAMES, SECRET, Query, _duck, _pad, _pads, _pick, _re2, _rule_counts, _table, _values
from redactum.session import spread
from redactum.sinks.rebuild import rebuild_csv, rebuild_hl7
from redactum.sources.csv import csv_leaves
from redactum.sources.formats import PREVIEW, confirm_format, detect_format_by_extension, intake, within_limit
from redactum.sources.hl7 import hl7_leaves


def _text(k: str, spark: bool) -> str:
    """A text that holds the rules that the notes lack, and shapes that are nearly theirs."""
    first, last = _pick(_NAMES[0], k, spark), _pick(_NAMES[1], k, spark)
    codes = "['E75.2', 'I10', 'Q91.0', 'J45.9', 'G40.5', 'E11.9', 'H49.8', 'Z00.0', 'D46.7', 'F84.2', 'U07.1']"
    parts = [
        "'IPv6 2001:0db8:0000:0000:0000:ff00:0042:'", _pad(f"{k} % 10000", 4), "' not 1:2:3:4:5:6:7. NHS '", _pad(f"{k} * 7919 % 1000", 3), "' '", _pad(f"{k} * 104729 % 1000", 3), "' '", _pad(f"{k} * 15485863 % 10000", 4),
        "'. DNI '", _pad(f"{k} * 31 % 100000000", 8), "'-Z not '", _pad(k, 8), "'-z; NIE X'", _pad(k, 7), "' L. CF RSSMRA'", _pad(f"{k} % 100", 2), "'T'", _pad(f"{k} % 31", 2), "'A'", _pad(f"{k} % 1000", 3), "'S not RSSMRA85Z10A562S. AHV 756.'", _pad(f"{k} % 10000", 4),
        "'.5678.'", _pad(f"{k} % 100", 2), "' not 757.1234.5678.97. BSN: '", _pad(k, 9), "', burgerservicenummer '", _pad(k, 8), "'. Call +44 161 '", _pad(f"{k} % 1000", 3), "' '", _pad(f"{k} % 10000", 4), "' or (0161) '", _pad(f"{k} % 1000", 3), "'-0102 not 12/34. acct no: '", _pad(k, 6),
        "'X, account number AC-'", _pad(k, 5), "'; licence no '", _pad(k, 5), "', DEA number BB'", _pad(k, 6), "'. VIN 1HGCM82633A'", _pad(k, 6), "' not 1HGCM82633I'", _pad(k, 6), "'. Lives at '", f"CAST({k} % 900 + 1 AS VARCHAR(20))", "' '", last, "' Street not 12 back street. Note by '",
        first, "' '", last, "', FRCP; specialist nurse '", last, "' '", first, "' today. Seen with his wife '", first, "' '", last, "' again; her sister was ill. Raw \"family\": \"'", last, "'\" and \"given\": [\"'", first, "'\"]. ICD '", _pick(codes, k, spark), "' aged '", f"CAST({k} % 60 + 75 AS VARCHAR(20))",
        "' or '", f"CAST({k} % 20 + 80 AS VARCHAR(20))", "' years old. On '", _pad(f"{k} % 28 + 1", 2), "'/0'", f"CAST({k} % 9 + 1 AS VARCHAR(20))", "'/2024, '", f"CAST({k} % 28 + 1 AS VARCHAR(20))", "' Jan 2024 and March '", f"CAST({k} % 28 + 1 AS VARCHAR(20))", "'th, 2023 not 2024-1.'",
    ]
    return " || ".join(parts)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).repartition(spark.sparkContext.defaultParallelism)
    return keys.select("id", F.expr(_text("id", True)).alias("text"))


TEXTS = f"texts AS (SELECT o_orderkey AS id, {_text('o_orderkey', False)} AS text FROM orders)"
_PLAIN = ["IP", "NATIONAL_ID_ES", "NATIONAL_ID_IT_CF", "NATIONAL_ID_CH_AHV", "NATIONAL_ID_NL_BSN", "ACCOUNT_NUMBER", "LICENSE", "VEHICLE_VIN", "ADDRESS_LINE", "DATE"]
_MORE = [*_PLAIN, "PHONE", "NHS_NUMBER", "RARE_DISEASE_ICD", "AGE_OVER_89"]


def rules_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the rules that the notes lack, by label and value."""
    spans = run_rules(texts(spark, sf_dir), "text", "s", RARE_CODES, _MORE).select(F.explode("s").alias("s"))
    return spans.groupBy("s.label", F.col("s.text").alias("value"), F.coalesce("s.rare_tier", F.lit("-")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def _phone(rows: str, text: str) -> str:
    """RE2 does not look around: a digit before or after is kept out by what has to stand there."""
    rule = next(r for r in RULES if r.label == "PHONE")
    core = _re2(rule).replace(r"(?<!\d)", "").replace(r"(?!\d)", "")
    return f"SELECT 'PHONE' AS label, value FROM (SELECT unnest(regexp_extract_all({text}, {_duck('(?:^|[^0-9])(' + core + ')(?:$|[^0-9])')}, 1)) AS value FROM {rows})"


def _of(label: str) -> str:
    return _duck(_re2(next(r for r in RULES if r.label == label)))


def _rules_more_sql() -> str:
    plain = " UNION ALL ".join(_values("texts", "text", r) for r in RULES if r.label in _PLAIN)
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    total = " + ".join(f"CAST(substr({digits}, {i}, 1) AS INT) * {11 - i}" for i in range(1, 10))
    check = f"(11 - ({total}) % 11) % 11"
    nhs = f"SELECT CASE WHEN {check} <> 10 AND {check} = CAST(substr({digits}, 10, 1) AS INT) THEN 'NHS_NUMBER' ELSE 'REFERENCE_ID' END AS label, value FROM (SELECT unnest(regexp_extract_all(text, {_of('NHS_NUMBER')})) AS value FROM texts)"
    age = f"SELECT 'AGE_OVER_89' AS label, value FROM (SELECT unnest(regexp_extract_all(text, {_of('AGE_OVER_89')})) AS value FROM texts) WHERE CAST(regexp_extract(value, '[0-9]+') AS INT) BETWEEN 90 AND 130"
    known = ", ".join(f"('{c}', '{t}')" for c, t in sorted(RARE_CODES.items()))
    rare = (
        f"SELECT 'RARE_DISEASE_ICD' AS label, value, CASE WHEN a.tier IS NULL OR b.tier = 'auto' THEN b.tier ELSE a.tier END AS tier FROM (SELECT unnest(regexp_extract_all(text, {_of('RARE_DISEASE_ICD')})) AS value FROM texts) "
        "LEFT JOIN known a ON a.code = value LEFT JOIN known b ON b.code = substr(value, 1, 3)"
    )
    rest = f"SELECT label, value, '-' AS tier FROM ({plain} UNION ALL {_phone('texts', 'text')} UNION ALL {nhs} UNION ALL {age})"
    return f"WITH {TEXTS}, known(code, tier) AS (VALUES {known}) SELECT label, value, tier, count(*) AS n FROM ({rest} UNION ALL SELECT * FROM ({rare}) WHERE tier IS NOT NULL) GROUP BY ALL"


def rules_name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as captured by the rules for credentials, roles, relations and raw FHIR."""
    spans = run_rules(texts(spark, sf_dir), "text", "s", labels=["NAME"]).select("text", F.explode("s").alias("s"))
    return spans.groupBy(F.expr("substring(text, s.cap_start + 1, s.cap_end - s.cap_start)").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _rules_name_forms_sql() -> str:
    found = []
    for r in (r for r in RULES if r.label == "NAME"):
        groups = [f"regexp_extract(m, {_duck(_re2(r))}, {g})" for g in range(1, r.groups + 1)]
        value = " || ".join(groups)  # one group of them is not empty
        if "i" in r.flags:  # what follows the last capitalised word is not of the name
            words = f"string_split({value}, ' ')"
            capital = f"list_transform({words}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))"
            value = f"array_to_string(({words})[1:coalesce(nullif(list_position({capital}, false), 0) - 1, len({words}))], ' ')"
        found.append(f"SELECT {value} AS value FROM (SELECT unnest(regexp_extract_all(text, {_duck(_re2(r))})) AS m FROM texts)")
    return f"WITH {TEXTS} SELECT value, count(*) AS n FROM ({' UNION ALL '.join(found)}) WHERE value <> '' GROUP BY value"


def rules_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_counts(_table(spark, sf_dir, "documents").select("text"), "text", ["PHONE"])


# Formats and intake.
_FILE = {True: "concat('f.', c_custkey, element_at(array('.hl7', '.DCM', '.json', '.pdf', '.docx', '.tsv', '.md', '.xyz', ''), CAST(c_custkey % 9 AS INT) + 1))", False: "'f.' || c_custkey || ['.hl7', '.DCM', '.json', '.pdf', '.docx', '.tsv', '.md', '.xyz', ''][CAST(c_custkey % 9 AS INT) + 1]"}
_BODY = "CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'MSH|^~' WHEN 1 THEN repeat(' ', CAST(c_custkey AS INT)) || '{{\"resourceType\": \"Patient\"' ELSE '{{\"a\": 1}}' || {pad} || '\"resourceType\": \"Patient\"' END".format(pad="repeat('x', CAST(c_custkey * 10 AS INT))")


# A file grows with its key, all files with its square; what is behind a preview's end is not made, as it is not read.
_SEEN = _BODY.replace("(c_custkey AS INT))", f"(least(c_custkey, {PREVIEW}) AS INT))").replace("(c_custkey * 10 AS INT))", f"(least(c_custkey * 10, {PREVIEW}) AS INT))")


def formats_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By name alone, and as confirmed from a preview of the content."""
    df = spread(_table(spark, sf_dir, "customer")).select("c_custkey", F.expr(_FILE[True]).alias("filename"), F.expr(_SEEN).alias("content"))
    return df.select("c_custkey", detect_format_by_extension().alias("guess"), confirm_format().alias("confirmed"))


_FORMATS_SQL = f"""
WITH f AS (SELECT c_custkey, lower(regexp_extract({_FILE[False]}, '[^.]*$')) AS e, ltrim(substr({_BODY}, 1, 4096)) AS c FROM customer),
g AS (SELECT *, c LIKE '{{%' AND regexp_matches(c, '"resourceType"\\s*:\\s*"[A-Za-z]+"') AS fhir, CASE e WHEN 'hl7' THEN 'HL7_V2' WHEN 'dcm' THEN 'DICOM' WHEN 'pdf' THEN 'PDF_TYPED' WHEN 'docx' THEN 'DOCX' WHEN 'tsv' THEN 'CSV' WHEN 'md' THEN 'TEXT' END AS known FROM f)
SELECT c_custkey, CASE WHEN e = 'json' THEN 'FHIR_R4' ELSE coalesce(known, 'UNKNOWN') END AS guess,
       CASE WHEN known IS NOT NULL THEN known WHEN e = 'json' THEN CASE WHEN fhir THEN 'FHIR_R4' ELSE 'TEXT' END WHEN c LIKE 'MSH|%' THEN 'HL7_V2' WHEN fhir THEN 'FHIR_R4' ELSE 'TEXT' END AS confirmed FROM g
"""


def staged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an intake takes: files under the limit that are not staged; and what is too large to be read."""
    files = _table(spark, sf_dir, "orders").selectExpr("concat('f', o_custkey, '.txt') AS filename", "o_orderkey AS size")
    staged = _table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").selectExpr("concat('f', c_custkey, '.txt') AS filename")
    large = within_limit(files, 20_000)[1].selectExpr("filename", "size", "'too large' AS state")
    return intake(files, staged, 20_000).selectExpr("filename", "size", "'taken' AS state").unionByName(large)


_STAGED_SQL = "SELECT 'f' || o_custkey || '.txt' AS filename, o_orderkey AS size, 'taken' AS state FROM orders WHERE o_orderkey < 20000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) UNION ALL SELECT 'f' || o_custkey || '.txt', o_orderkey, 'too large' FROM orders WHERE o_orderkey > 20000"

# Spans of a key: two that overlap, one that touches, as both engines compute them.
_A = {"s": "0", "e": "5 + id % 7", "p": "50 + id % 3 * 10", "src": "IF(id % 2 = 0, 'rule', 'ner')"}
_B = {"s": "2 + id % 4", "e": "6 + id % 11", "p": "50 + id % 4 * 10", "src": "'rule'"}


def merge_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who wins where two spans overlap, with the third far off."""
    span = lambda v, name: f"named_struct('start', CAST({v['s']} AS INT), 'end', CAST({v['e']} AS INT), 'text', '{name}', 'label', '{name}', 'category', 'HIPAA', 'source', {v['src']}, 'confidence', 1.0D, 'cap_start', CAST(0 AS INT), 'cap_end', CAST(1 AS INT), 'rare_tier', CAST(NULL AS STRING), 'prio', CAST({v['p']} AS INT))"
    far = span({"s": "40", "e": "45", "p": "1", "src": "'rule'"}, "C")
    df = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id").selectExpr("id", f"CAST(array({far}, {span(_B, 'B')}, {span(_A, 'A')}) AS array<{SPAN}>) AS s")
    df = df.select("id", F.explode(F.expr(merge_sql("s"))).alias("m"))
    return df.select("id", F.col("m.start").cast("bigint").alias("start"), F.col("m.end").cast("bigint").alias("stop"), "m.label", F.col("m.cap_start").isNull().alias("uncut"))


_MERGE_SQL = f"""
WITH s AS (SELECT id, {_A['s']} AS a0, {_A['e']} AS a1, {_A['p']} AS ap, id % 2 = 1 AS model, {_B['s']} AS b0, {_B['e']} AS b1, {_B['p']} AS bp FROM (SELECT o_orderkey AS id FROM orders)),
m AS (SELECT *, b0 < a1 AS met, CASE WHEN ap <> bp THEN ap > bp WHEN a1 - a0 <> b1 - b0 THEN a1 - a0 > b1 - b0 ELSE model END AS first FROM s)
SELECT id, CAST(0 AS BIGINT) AS start, CAST(CASE WHEN met THEN greatest(a1, b1) ELSE a1 END AS BIGINT) AS stop, CASE WHEN met AND NOT first THEN 'B' ELSE 'A' END AS label, met AS uncut FROM m
UNION ALL SELECT id, CAST(b0 AS BIGINT), CAST(b1 AS BIGINT), 'B', false FROM m WHERE NOT met UNION ALL SELECT id, 40, 45, 'C', false FROM m
"""


def model_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a model by confidence: merged, uncertain or dropped; direct and quasi apart, counted, defaults."""
    span = lambda s, e, c, label, cat: f"named_struct('start', {s}, 'end', {e}, 'text', 'x', 'label', '{label}', 'category', '{cat}', 'source', 'ner', 'confidence', {c}, 'cap_start', CAST(NULL AS INT), 'cap_end', CAST(NULL AS INT), 'rare_tier', CAST(NULL AS STRING), 'prio', 50)"
    conf = lambda m: f"IF(id % 11 = {m}, NULL, CAST((id * {m + 3} % 100) AS DOUBLE) / 100)"
    df = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "'no such thing in it' AS text").withColumn("m", F.expr(f"CAST(array({span(0, 2, conf(0), 'NAME', 'HIPAA')}, {span(3, 7, conf(1), 'INSTITUTION', 'QUASI')}, {span(8, 13, conf(2), 'NAME', 'HIPAA')}) AS array<{SPAN}>)"))
    df = default_quasi(detect(df, "text", "m"), True)
    return df.select("id", *[F.size(f"detection.{x}").cast("bigint").alias(x) for x in ("spans", "quasi", "uncertain")], F.coalesce(F.expr("try_element_at(detection.counts, 'NAME')"), F.lit(0)).cast("bigint").alias("names"), F.array_join("redact", ",").alias("redact"))


def _buckets_sql() -> str:
    c = [f"CASE WHEN id % 11 = {m} THEN 1.0 ELSE CAST(id * {m + 3} % 100 AS DOUBLE) / 100 END" for m in range(3)]
    return f"SELECT id, CAST((a >= 0.85)::INT + (c >= 0.85)::INT AS BIGINT) AS spans, CAST((b >= 0.85)::INT AS BIGINT) AS quasi, CAST((a >= 0.5 AND a < 0.85)::INT + (b >= 0.5 AND b < 0.85)::INT + (c >= 0.5 AND c < 0.85)::INT AS BIGINT) AS uncertain, CAST((a >= 0.85)::INT + (c >= 0.85)::INT AS BIGINT) AS names, CASE WHEN b >= 0.85 THEN 'INSTITUTION' ELSE '' END AS redact FROM (SELECT id, {c[0]} AS a, {c[1]} AS b, {c[2]} AS c FROM (SELECT o_orderkey AS id FROM orders))"


def decided_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer's decisions on uncertain spans: counts by record, and what is confirmed."""
    lines = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "CAST(l_linenumber AS INT) AS start", "CAST(l_linenumber + 3 AS INT) AS end", "'NAME' AS label")
    decisions = lines.where("start % 3 > 0").selectExpr("*", "start % 3 = 1 AS decision")
    yes = review.confirmed(lines, decisions, "id").groupBy("id").agg(F.count(F.lit(1)).alias("kept"))
    no = review.decide(lines, decisions, "id").where("NOT decision").groupBy("id").agg(F.count(F.lit(1)).alias("left"))
    return review.decision_counts(lines, decisions, "id").join(yes, "id", "left").join(no, "id", "left").na.fill(0)


_DECIDED_SQL = "SELECT l_orderkey AS id, count(*) FILTER (l_linenumber % 3 = 0) AS undecided, count(*) FILTER (l_linenumber % 3 = 1) AS confirmed, count(*) FILTER (l_linenumber % 3 = 2) AS dismissed, count(*) FILTER (l_linenumber % 3 = 1) AS kept, count(*) FILTER (l_linenumber % 3 <> 1) AS left FROM lineitem GROUP BY l_orderkey"


def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a reviewer marks, trimmed, and the texts cut at them."""
    df = _table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "concat('see ', c_name, ' now') AS text")
    marks = df.selectExpr("id", "3 AS start", "length(text) - 3 AS end", "IF(id % 5 = 0, 'URL', 'NAME') AS label")
    spans = review.manual_spans(df, marks, "id").groupBy("id").agg(F.collect_list(F.struct("start", "end", "label")).alias("spans"))
    df = df.join(spans, "id").withColumn("redact", F.array(F.lit("INSTITUTION")))
    df = review.toggle_quasi(review.highlight(df, "text", "spans"), ["OCCUPATION"], ["INSTITUTION"])
    return df.select("id", F.expr("array_join(transform(highlight, x -> concat(x.text, '/', coalesce(x.label, '-'))), '|')").alias("pieces"), F.array_join("redact", ",").alias("redact"))


_HIGHLIGHT_SQL = "SELECT c_custkey AS id, 'see /-|' || c_name || '/NAME| now/-' AS pieces, 'OCCUPATION' AS redact FROM customer WHERE c_custkey % 5 <> 0"


# The flow on texts with few identifiers, of which one stands again where no rule sees it.
def _record(k: str) -> str:
    return f"'Wrote from u' || CAST({k} AS VARCHAR(20)) || '@mail.example.com on 20' || {_pad(f'{k} % 24', 2)} || '-' || {_pad(f'{k} % 12 + 1', 2)} || '-' || {_pad(f'{k} % 28 + 1', 2)} || '. MRN: QX-' || {_pad(k, 7)} || '. Again QX-' || {_pad(k, 7)} || ' and xQX-' || {_pad(k, 7)} || ' came, ' || {_pad(f'{k} % 9 + 1', 1)} || ' times.'"


def replaced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(_table(spark, sf_dir, "orders")).selectExpr("o_orderkey AS id", f"{_record('o_orderkey')} AS text")
    out = deidentify_texts(df, "GDPR_ANON", audit=False)
    return out.select("id", F.size("detection.spans").cast("bigint").alias("spans"), F.col("replacement.sweeps").cast("bigint").alias("sweeps"), F.size("replacement.mapping").cast("bigint").alias("mapped"), "validation.passed", "emit_allowed", F.col("replacement.text").alias("text"))


_MAIL = next(_duck(_re2(r)) for r in RULES if r.label == "EMAIL")
_STEPS = f"r AS (SELECT o_orderkey AS id, {_record('o_orderkey')} AS t FROM orders), v AS (SELECT id, t, regexp_extract(t, 'MRN: ([A-Z0-9-]+)', 1) AS mrn, regexp_extract(t, {_MAIL}) AS mail, regexp_extract(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS day FROM r)"
_REPLACED_SQL = f"WITH {_STEPS} SELECT id, CAST(3 AS BIGINT) AS spans, CAST(len(regexp_extract_all(t, '[^A-Za-z0-9_]QX-[0-9]{{7}}')) - 1 AS BIGINT) AS sweeps, CAST(3 AS BIGINT) AS mapped, true AS passed, true AS emit_allowed, replace(replace(replace(t, mail, '[EMAIL]'), day, substr(day, 1, 4)), ' ' || mrn, ' [MRN]') AS text FROM v"


def pseudonymised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(_table(spark, sf_dir, "orders")).selectExpr("o_orderkey AS id", f"{_record('o_orderkey')} AS text")
    out = deidentify_texts(df, "GDPR_PSEUDO", SECRET, audit=False)
    return out.select("id", F.col("replacement.date_shift").cast("bigint").alias("date_shift"), "replacement.date_hint", "validation.passed", F.col("replacement.text").alias("text"))


def _pseudonymised_sql() -> str:
    inner, outer = _pads()
    name = lambda label, x: f"'[{label}-' || upper(substr(sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || encode('{label}:' || {x})))), 1, 8)) || ']'"
    shift = crypto.date_shift(SECRET)
    moved = f"strftime(CAST(day AS DATE) + INTERVAL ({shift}) DAY, '%Y-%m-%d')"
    return f"WITH {_STEPS} SELECT id, CAST({shift} AS BIGINT) AS date_shift, 'AMBIGUOUS' AS date_hint, true AS passed, replace(replace(replace(t, mail, {name('EMAIL', 'mail')}), day, {moved}), ' ' || mrn, ' ' || {name('MRN', 'mrn')}) AS text FROM v"


_OUT = "CASE CAST({k} % 4 AS INT) WHEN 0 THEN 'nothing [NAME] left' WHEN 1 THEN 'still QX-' || {pad} || ' here' WHEN 2 THEN 'mail u' || CAST({k} AS VARCHAR(20)) || '@mail.example.com and [MRN]' ELSE 'part of xQX-' || {pad} || 'y only' END"


def residual_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted survivors: originals and rule matches that are left in an output, and both gates."""
    k = "o_orderkey"
    df = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{_OUT.format(k=k, pad=_pad(k, 7))} AS out", f"array('QX-' || {_pad(k, 7)}, 'abc') AS originals")
    df = validate(df, "ANONYMISE", "out", "originals")
    df = df.withColumn("risk", F.expr("named_struct('k', CAST(id % 7 AS INT), 'level', IF(id % 2 = 0, 'HIGH', 'LOW'))"))
    return df.select("id", "validation.passed", F.array_join("validation.originals_leaked", ",").alias("leaked"), F.expr("array_join(transform(validation.leaks, s -> s.text), ',')").alias("leaks"), F.expr(emit_allowed("ANONYMISE")).alias("emit"), F.expr(release_allowed("id % 3 = 0")).alias("release"))


_RESIDUAL_SQL = f"""
WITH o AS (SELECT o_orderkey AS id, {_OUT.format(k='o_orderkey', pad=_pad('o_orderkey', 7))} AS out, 'QX-' || {_pad('o_orderkey', 7)} AS orig FROM orders),
v AS (SELECT *, regexp_matches(out, '\\b' || orig || '\\b') AS gone FROM o)
SELECT id, NOT gone AS passed, CASE WHEN gone THEN orig ELSE '' END AS leaked, array_to_string(regexp_extract_all(out, {_MAIL}), ',') AS leaks, NOT gone AND id % 7 >= 5 AS emit, NOT gone AND (id % 2 <> 0 OR id % 3 = 0) AS release FROM v
"""


def risk_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lambda labels: f"transform(filter(array({labels}), x -> x IS NOT NULL), x -> named_struct('label', x))"
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(made("'NAME', IF(c_custkey % 2 = 0, 'NAME', NULL), IF(c_custkey % 3 = 0, 'DATE', NULL)")).alias("d"), F.expr(made("IF(c_custkey % 5 = 0, 'INSTITUTION', NULL), IF(c_custkey % 10 = 0, 'INSTITUTION', NULL)")).alias("r"))
    df = assess_risk(df, "d", "r").select("c_custkey", F.explode("risk.breakdown").alias("b"))
    return df.select("c_custkey", "b.label", F.col("b.count").cast("bigint").alias("n"), "b.action")


_BREAKDOWN_SQL = "SELECT c_custkey, 'NAME' AS label, CAST(CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n, 'redacted' AS action FROM customer UNION ALL SELECT c_custkey, 'DATE', 1, 'redacted' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'INSTITUTION', CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END, 'kept (quasi)' FROM customer WHERE c_custkey % 5 = 0"


def date_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of day and month that an order's ship, commit and receipt dates tell."""
    shape = lambda c: f"date_format({c}, IF(l_orderkey % 3 = 0, 'dd/MM/yyyy', IF(l_orderkey % 3 = 1, 'MM/dd/yyyy', 'yyyy-MM-dd')))"
    df = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.expr(shape("l_shipdate")))).alias("d"))
    return df.select("l_orderkey", F.expr(dates.hint("d")).alias("hint"))


_ORDERS_SQL = "SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 2 OR NOT bool_or(day(l_shipdate) > 12) THEN 'AMBIGUOUS' WHEN l_orderkey % 3 = 0 THEN 'DMY' ELSE 'MDY' END AS hint FROM lineitem GROUP BY l_orderkey"


def batch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with files that are too large or empty: what became of how many."""
    files = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS record_id", "concat('f', s_suppkey) AS filename", "IF(s_suppkey % 7 = 0, 60000000L, 10L) AS size", "IF(s_suppkey % 5 = 0, NULL, 'write to u@mail.example.com') AS content")
    return batch_progress(run_batch(files, "GDPR_ANON", at="CAST('2024-01-01' AS TIMESTAMP)"))


_BATCH_SQL = "SELECT count(*) AS total, count(*) FILTER (s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0) AS done, count(*) FILTER (s_suppkey % 7 = 0 OR s_suppkey % 5 = 0) AS errors FROM supplier"
_HL7 = "'MSH|^~' || chr(92) || '&|A|B' || chr(13) || 'PID|1||' || c_custkey || '||' || {name} || '^{ann}^^~{b}|||||' || '|' || {seg} || '&{x}^{town}' || chr(13) || 'EVN|skip'"


def hl7_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose leaves are written in capitals, rebuilt."""
    df = _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_HL7.format(name='c_name', seg='lower(c_mktsegment)', ann='Ann', b='b', x='x', town='Town')} AS content")
    leaves = hl7_leaves(df, "c_custkey").withColumn("new_value", F.upper("value"))
    return rebuild_hl7(df, leaves, "c_custkey").select("c_custkey", "output")


def csv_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose cells are written in capitals, rebuilt."""
    df = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "'family,note' || chr(10) || c_name || ',' || lower(c_mktsegment) || chr(10) || '\"x, y\",n' || c_custkey AS content")
    leaves = csv_leaves(df, "c_custkey").withColumn("new_value", F.upper("value"))
    return rebuild_csv(df, leaves, "c_custkey").select("c_custkey", F.md5(F.regexp_replace(F.trim(F.regexp_replace("output", "\r", "")), "\n+$", "").cast("binary")).alias("output_md5"))


# Files of six kinds by key: text, HL7, CSV, FHIR, a FHIR file that is cut off, a PDF without a reader.
_MAILED = "'u' || {k} || '@mail.example.com'"
_FILE_NAME = "'f' || {k} || CASE CAST({k} % 6 AS INT) WHEN 0 THEN '.txt' WHEN 1 THEN '.hl7' WHEN 2 THEN '.csv' WHEN 5 THEN '.pdf' ELSE '.json' END"


def _file_text(name: str, ann: str, mail: str, fhir_break: str, csv_break: str, cut: str = "''") -> str:
    """The content of a file; ``fhir_break`` and ``csv_break`` are what parts lines there."""
    line = lambda depth: f"{fhir_break} || '{'  ' * depth}'" if fhir_break != "''" else "''"
    fhir = f"'{{{{' || {line(1)} || '\"resourceType\": \"Patient\",' || {line(1)} || '\"name\": [' || {line(2)} || '{{{{' || {line(3)} || '\"family\": \"' || {name} || '\"' || {line(2)} || '}}}}' || {line(1)} || '],' || {line(1)} || '\"note\": \"mail ' || {mail} || '\"'"
    return (
        f"CASE CAST({{k}} % 6 AS INT) WHEN 0 THEN 'write to ' || {mail} || ' soon' WHEN 1 THEN 'MSH|^~' || chr(92) || '&|A|B' || chr(13) || 'PID|1||x||' || {name} || '^' || {ann} || chr(13) || 'NTE|1||mail ' || {mail} "
        f"WHEN 2 THEN 'family,note' || {csv_break} || {name} || ',mail ' || {mail} WHEN 3 THEN {fhir} || {line(0)} || '}}}}' WHEN 4 THEN {fhir} || {cut} ELSE 'x' END"
    )


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several formats through one flow, each written again in its own format."""
    text = _file_text("c_mktsegment", "'Ann'", _MAILED, "''", "chr(10)").format(k="c_custkey")
    files = _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_FILE_NAME.format(k='c_custkey')} AS filename", f"CAST({text} AS BINARY) AS bytes", "IF(c_custkey % 11 = 0, 60000000L, 100L) AS size")
    out = deidentify_files(files, "c_custkey", "GDPR_ANON", at="CAST('2024-01-01' AS TIMESTAMP)")
    return out.select("c_custkey", "format", "status", "output_name", "media_type", "spans_found", "replacements_made", "validation.passed", F.decode("output", "UTF-8").alias("output"))


def _mixed_sql() -> str:
    text = _file_text("'[NAME]'", "'[NAME]'", "'[EMAIL]'", "chr(10)", "chr(13) || chr(10)").format(k="c_custkey")
    kind = lambda *v: "CASE CAST(c_custkey % 6 AS INT) " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(v)) + " END"
    ok = "c_custkey % 6 < 4 AND c_custkey % 11 <> 0"
    # Beyond the size limit a file has no content to judge by: JSON is text then.
    form = f"CASE WHEN c_custkey % 6 IN (3, 4) AND c_custkey % 11 = 0 THEN 'TEXT' ELSE {kind(*(repr(x) for x in ('TEXT', 'HL7_V2', 'CSV', 'FHIR_R4', 'FHIR_R4', 'PDF_TYPED')))} END"
    when = lambda x: f"CASE WHEN {ok} THEN {x} END"
    spans = f"CAST({when(kind(1, 3, 2, 2))} AS BIGINT)"
    name = "'f' || c_custkey || '.deidentified.' || " + kind("'txt'", "'hl7'", "'csv'", "'json'")
    media = kind("'text/plain'", "'application/hl7-v2'", "'text/csv'", "'application/json'")
    return f"SELECT c_custkey, {form} AS format, CASE WHEN {ok} THEN 'done' ELSE 'error' END AS status, {when(name)} AS output_name, {when(media)} AS media_type, {spans} AS spans_found, {spans} AS replacements_made, {when('true')} AS passed, {when(text)} AS output FROM customer"


def queries() -> dict[str, Query]:
    made: list[Callable] = [rules_more, rules_name_forms, rules_phone, formats_by_extension, staged_files, merge_winners, model_buckets, decided_spans, highlighted, replaced_texts, pseudonymised_texts, residual_leaks, risk_breakdowns, date_orders, batch_states, hl7_rebuilt, csv_rebuilt, mixed_files]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {
        "rules_more": _rules_more_sql(), "rules_name_forms": _rules_name_forms_sql(), "rules_phone": f"SELECT label, value, count(*) AS n FROM ({_phone('documents', 'text')}) GROUP BY ALL", "formats_by_extension": _FORMATS_SQL, "staged_files": _STAGED_SQL, "merge_winners": _MERGE_SQL,
        "model_buckets": _buckets_sql(), "decided_spans": _DECIDED_SQL, "highlighted": _HIGHLIGHT_SQL, "replaced_texts": _REPLACED_SQL, "pseudonymised_texts": _pseudonymised_sql(), "residual_leaks": _RESIDUAL_SQL, "risk_breakdowns": _BREAKDOWN_SQL, "date_orders": _ORDERS_SQL, "batch_states": _BATCH_SQL, "mixed_files": _mixed_sql(),
        "hl7_rebuilt": "SELECT c_custkey, " + _HL7.format(name="upper(c_name)", seg="upper(c_mktsegment)", ann="ANN", b="B", x="X", town="TOWN") + " AS output FROM customer",
        "csv_rebuilt": "SELECT c_custkey, md5('family,note' || chr(10) || upper(c_name) || ',' || upper(c_mktsegment) || chr(10) || '\"X, Y\",N' || c_custkey) AS output_md5 FROM customer",
    }
