"""Queries over words and their places in the given documents (entities of a model's tokens, boxes of spans), and over verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.functions.rules import RULES
from redactum.functions.sql import let, running
from redactum.operators.compliance import HEALTH, concern_sql, severity_sql
from redactum.operators.model_spans import TOKEN, token_spans
from redactum.operators.registry import extended, named, token_hashes
from redactum.plans.pipeline import screen
from redactum.plans.sql_functions import register
from redactum.queries import SECRET, Query, _duck, _pads, _re2, _table
from redactum.sources.pages import redaction_boxes
from redactum.workspace import Workspace

#: The words of a text between single blanks, and where each starts.
_PLACES = let("transform(w, x -> length(x) + 1)", "n_", let(running("n_", "p + q"), "e_", "transform(w, (x, i) -> struct(x AS word, e_[i] - n_[i] AS at, i AS no))"))
_DUCK_PLACED = "SELECT doc_id, no, word, CAST(sum(len(word) + 1) OVER (PARTITION BY doc_id ORDER BY no) - len(word) - 1 AS BIGINT) AS pos FROM (SELECT doc_id, i - 1 AS no, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents)))"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return df.withColumn("w", F.split("text", " ", -1)).withColumn("places", F.expr(_PLACES))


def model_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of tokens that a model could give: words of letters with a capital, of every
    fifth only the first two letters, the type by length, the tag by number."""
    df = _words(spark, sf_dir)
    of = "named_struct('entity', concat(IF(x.no % 3 = 0, 'B-', 'I-'), element_at(array('PER', 'LOC', 'ORG'), length(x.word) % 3 + 1)), 'word', x.word, 'start', x.at, 'end', x.at + IF(x.no % 5 = 0, 2, length(x.word)), 'score', (x.no % 4 + 1) / 4D)"
    df = df.withColumn("tokens", F.expr(f"CAST(transform(filter(places, x -> x.word RLIKE '^[A-Z][a-z]+$'), x -> {of}) AS array<{TOKEN}>)"))
    spans = token_spans(df, "tokens", "text", "spans").select("doc_id", F.explode("spans").alias("s"))
    return spans.select("doc_id", F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("stop"), F.col("s.text").alias("value"), "s.label", "s.category", F.round("s.confidence", 9).alias("confidence"))


_TOKENS_SQL = f"""
WITH p AS ({_DUCK_PLACED}),
k AS (SELECT doc_id, no, word, pos, pos + CASE WHEN no % 5 = 0 THEN 2 ELSE len(word) END AS stop, ['PER', 'LOC', 'ORG'][len(word) % 3 + 1] AS kind, no % 3 = 0 AS begins, (no % 4 + 1) / CAST(4 AS DOUBLE) AS score FROM p WHERE regexp_matches(word, '^[A-Z][a-z]+$')),
j AS (SELECT *, lag(kind) OVER o IS NOT DISTINCT FROM kind AND lag(stop) OVER o = pos - 1 AND NOT begins AS goes_on FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
g AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY no) AS entity FROM j),
s AS (SELECT doc_id, kind, min(pos) AS start, max(pos + len(word)) AS stop, string_agg(word, ' ' ORDER BY no) AS value, avg(score) AS score FROM g GROUP BY doc_id, entity, kind)
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, value, CASE kind WHEN 'PER' THEN 'NAME' WHEN 'LOC' THEN 'ADDRESS_LINE' ELSE 'INSTITUTION' END AS label, CASE kind WHEN 'ORG' THEN 'QUASI' ELSE 'HIPAA' END AS category, round(score, 9) AS confidence
FROM s WHERE len(value) >= 3 AND lower(value) NOT IN ('discharge', 'summary', 'patient', 'report', 'letter', 'clinic', 'ward', 'date', 'name', 'address', 'hospital', 'department', 'referral', 'consultant', 'notes', 'record', 'diagnosis', 'treatment', 'medication')
"""

# Pages of 50 lines of 80 characters, 7 by 12 pixels each.
_BOX = {"page": "at DIV 4000", "line": "at % 4000 DIV 80", "x0": "at % 80 * 7D", "x1": "(at % 80 + length(word)) * 7D", "y0": "at % 4000 DIV 80 * 12D", "y1": "at % 4000 DIV 80 * 12D + 11"}


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles over every ninth word and what follows within five characters, line by line."""
    words = _words(spark, sf_dir).select("doc_id", F.explode("places").alias("p")).select("doc_id", "p.*").where("word <> ''")
    placed = words.selectExpr("doc_id", "CAST(at AS BIGINT) AS start", "CAST(at + length(word) AS BIGINT) AS end", *[f"{x} AS {n}" for n, x in _BOX.items()], "792D AS page_height")
    spans = words.where("no % 9 = 0").selectExpr("doc_id", "CAST(at AS BIGINT) AS start", "CAST(at + length(word) + 5 AS BIGINT) AS end")
    box = redaction_boxes(placed, spans, "doc_id")
    return box.select("doc_id", "start", F.col("end").alias("stop"), F.col("page").cast("bigint").alias("page"), *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


_BOXES_SQL = f"""
WITH p AS (SELECT * FROM ({_DUCK_PLACED}) WHERE word <> ''),
w AS (SELECT doc_id, no, pos AS start, pos + len(word) AS stop, pos // 4000 AS page, pos % 4000 // 80 AS line, pos % 80 * CAST(7 AS DOUBLE) AS x0, (pos % 80 + len(word)) * CAST(7 AS DOUBLE) AS x1, pos % 4000 // 80 * CAST(12 AS DOUBLE) AS y0 FROM p),
s AS (SELECT doc_id, start, stop + 5 AS stop FROM w WHERE no % 9 = 0),
m AS (SELECT s.doc_id, s.start, s.stop, w.page, w.line, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y0 + 11) AS y1 FROM w JOIN s ON w.doc_id = s.doc_id AND w.start < s.stop AND w.stop > s.start GROUP BY ALL)
SELECT doc_id, start, stop, page, round(x0 * CAST(0.36 AS DOUBLE), 6) AS x, round((792 - y1) * CAST(0.36 AS DOUBLE), 6) AS y, round((x1 - x0) * CAST(0.36 AS DOUBLE), 6) AS width, round((y1 - y0) * CAST(0.36 AS DOUBLE), 6) AS height FROM m
"""


# Texts of pieces that a bit of the key puts in; both engines read this SQL.
_PIECES = {
    "EMAIL": "'Write to u' || CAST({k} AS VARCHAR(20)) || '@mail.example.com or v' || CAST({k} AS VARCHAR(20)) || '@mail.example.com. '", "SSN": "'SSN 123-45-' || lpad(CAST({k} % 10000 AS VARCHAR(20)), 4, '0') || ' here. '",
    "DATE": "'On 2024-0' || CAST({k} % 9 + 1 AS VARCHAR(20)) || '-1' || CAST({k} % 10 AS VARCHAR(20)) || ' it rained. '", "health": "'The patient slept. '", "RARE_DISEASE_ICD": "'Code E75.2 noted. '", "none": "'No more. '",
}
_MIXED = " || ".join(f"CASE WHEN {{k}} // {1 << i} % 2 = 1 THEN {x} ELSE '' END" for i, x in enumerate(_PIECES.values()))


def compliance_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts and findings of texts that hold any of five kinds of information, or none."""
    df = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{_MIXED.format(k='o_orderkey').replace('//', 'DIV')} AS text")
    c = screen(df, "US").select("id", "compliance.*")
    found = F.expr("array_join(transform(findings, f -> concat_ws(':', f.label, f.count, f.severity, f.concern, array_join(f.values, '+'))), ';')")
    return c.select("id", "verdict", F.col("ai_upload.safe").alias("safe"), "health_data", "primary_action", found.alias("findings"), F.size("notes").cast("bigint").alias("notes"))


def _compliance_sql() -> str:
    rule = {r.label: _duck(_re2(r)) for r in RULES if r.label in ("EMAIL", "SSN", "DATE", "RARE_DISEASE_ICD")}
    values = ", ".join(f"regexp_extract_all(text, {rule[x]}) AS {x.lower()}" for x in rule)
    one = " UNION ALL ".join(f"SELECT id, '{x}' AS label, {x.lower()} AS v, strpos(text, {x.lower()}[1]) AS place FROM v WHERE len({x.lower()}) > 0" for x in rule)
    level = severity_sql("label")
    return f"""
WITH t AS (SELECT o_orderkey AS id, {_MIXED.format(k='o_orderkey')} AS text FROM orders),
v AS (SELECT id, text, {values}, regexp_matches(lower(text), {_duck(HEALTH)}) OR regexp_matches(text, 'E75') AS health FROM t),
f AS (SELECT id, label, v, place, {level} AS severity, {concern_sql('label', 'US')} AS concern FROM ({one})),
j AS (SELECT id, string_agg(label || ':' || len(v) || ':' || severity || ':' || concern || ':' || array_to_string(v, '+'), ';' ORDER BY CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, label = 'RARE_DISEASE_ICD', place) AS findings, bool_or(label = 'RARE_DISEASE_ICD') AS rare, bool_or(label <> 'RARE_DISEASE_ICD') AS direct FROM f GROUP BY id),
w AS (SELECT v.id, health, coalesce(findings, '') AS findings, CASE WHEN findings IS NULL AND NOT health THEN 'SAFE' WHEN rare OR (health AND coalesce(direct, false)) THEN 'DO_NOT_UPLOAD' ELSE 'NEEDS_DEIDENTIFICATION' END AS verdict FROM v LEFT JOIN j USING (id))
SELECT id, verdict, verdict = 'SAFE' AS safe, health AS health_data, CASE verdict WHEN 'SAFE' THEN 'NONE' ELSE 'ANONYMISE' END AS primary_action, findings, CAST(2 + health::INT + (verdict <> 'SAFE')::INT AS BIGINT) AS notes FROM w
"""


def sql_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of documents by the session's table function, from SQL alone."""
    register(spark, None, ["EMAIL"], "mail_")
    _table(spark, sf_dir, "documents").createOrReplaceTempView("redactum_documents")
    return spark.sql("SELECT d.doc_id, x.label, x.text AS value, count(*) AS n FROM redactum_documents AS d, LATERAL mail_detected(d.text) AS x GROUP BY ALL")


_DIGITS = 2


def pseudonym_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonyms of all names and segments, as few digits as tell them apart: odd keys first, the others as a later batch."""
    tokens = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "stack(2, 'NAME', c_name, 'MRN', c_mktsegment) AS (label, value)")
    space = Workspace(spark, "registry")
    first = space.write(extended(token_hashes(tokens.where("c_custkey % 2 = 1"), SECRET), None, _DIGITS), "first")
    hashes = space.write(token_hashes(tokens, SECRET), "hashes")
    known = space.write(extended(hashes, first, _DIGITS), "known")
    return named(hashes, known).select("label", "value", "pseudonym")


def _registry_sql() -> str:
    inner, outer = _pads()
    common = lambda other: f"coalesce(list_min(list_filter(range(1, 65), lambda i: substr(h, 1, i) <> substr({other}, 1, i))) - 1, 0)"
    near = f"""SELECT *, lag(h) OVER o AS a, lead(h) OVER o AS b FROM {{0}} WINDOW o AS (PARTITION BY label ORDER BY h)"""
    width = f"greatest({_DIGITS}, {common('a')} + 1, {common('b')} + 1)"
    return f"""
WITH t AS (SELECT 'NAME' AS label, c_name AS value, c_custkey % 2 = 1 AS early FROM customer UNION ALL SELECT 'MRN', c_mktsegment, c_custkey % 2 = 1 FROM customer),
d AS (SELECT label, value, bool_or(early) AS early, sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || encode(label || ':' || value)))) AS h FROM t GROUP BY label, value),
e AS (SELECT * FROM d WHERE early), f AS (SELECT label, h, {width} AS w FROM ({near.format('e')})), g AS (SELECT label, value, h, early, {width} AS w FROM ({near.format('d')}))
SELECT g.label, g.value, '[' || g.label || '-' || upper(substr(g.h, 1, CAST(coalesce(f.w, g.w) AS INT))) || ']' AS pseudonym FROM g LEFT JOIN f ON f.label = g.label AND f.h = g.h
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (model_tokens, word_boxes, compliance_mixed, sql_detection, pseudonym_registry)}


def oracle_sql() -> dict[str, str]:
    return {"model_tokens": _TOKENS_SQL, "word_boxes": _BOXES_SQL, "compliance_mixed": _compliance_sql(), "pseudonym_registry": _registry_sql(), "sql_detection": f"SELECT doc_id, label, value, count(*) AS n FROM (SELECT doc_id, 'EMAIL' AS label, unnest(regexp_extract_all(text, {_duck(_re2(next(r for r in RULES if r.label == 'EMAIL')))})) AS value FROM documents) GROUP BY ALL"}
