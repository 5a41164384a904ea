"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.llm import bpe_count, decontaminate, embedding_dedup, filter_audit, line_dedup, minhash, mixing, quality, resampling, secrets_scan, toxicity, warc
from redactum.llm import language_id as lid
from redactum.session import ship_package, spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), decontaminate.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lid.fold(F.col("doc_id"), 5) == 0
    good = quality.trusted(_table(spark, sf_dir, "labels").where(~held_out))
    model = quality.train(docs.where(~held_out), good)
    out = quality.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = lid.fold(F.col("doc_id"), 4) == 2
    model = lid.train(docs.where(~held_out))
    out = lid.identify(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_count.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_text=False)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resample(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, _table(spark, sf_dir, "labels"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lid.fold(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs.where(~held_out), _table(spark, sf_dir, "labels").where(~held_out))
    out = toxicity.score(docs, model).withColumn("worst", F.expr("array_max(transform(offending, x -> struct(x.score AS score, -x.start AS place, x.end AS end)))"))
    return out.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.ACCEPT).cast("int").alias("predicted"), "n_sentences", F.size("offending").cast("bigint").alias("n_offending"),
        (-F.col("worst.place")).alias("worst_start"), F.col("worst.end").alias("worst_end"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_mixing, op3_decontamination, op4_secrets, op5_quality, op6_language_id, op7_embedding_dedup, op8_minhash, op9_token_counts, op10_warc, op11_resampling, op12_filter_audit, op13_toxicity, pipeline)}


_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = """
WITH lines AS (
  SELECT doc_id, i - 1 AS no, l[i] AS line, doc_id * 1000000 + i AS occ,
         list_filter(regexp_split_to_array(l[i], '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
known AS (SELECT w, min(occ) AS f FROM lines WHERE len(w) > 0 GROUP BY w),
cut AS (SELECT w, f, i, list_concat(w[1:i-1], w[i+1:]) AS v FROM (SELECT w, f, unnest(range(1, len(w) + 1)) AS i FROM known WHERE len(w) >= 10)),
pairs AS (
  SELECT a.w, min(b.f) AS m FROM cut a JOIN (SELECT i, v, min(f) AS f FROM cut GROUP BY i, v) b ON a.i = b.i AND a.v = b.v GROUP BY a.w
  UNION ALL SELECT a.w, min(k.f) FROM cut a JOIN known k ON a.v = k.w AND len(k.w) >= 10 GROUP BY a.w
  UNION ALL SELECT k.w, min(a.f) FROM cut a JOIN known k ON a.v = k.w AND len(k.w) >= 10 GROUP BY k.w),
near AS (SELECT p.w FROM pairs p JOIN known k ON k.w = p.w GROUP BY p.w, k.f HAVING min(p.m) < k.f),
judged AS (
  SELECT l.*, len(l.w) > 0 AS full_, n.w IS NOT NULL AS near, len(l.w) > 0 AND (n.w IS NOT NULL OR l.occ <> k.f) AS gone
  FROM lines l LEFT JOIN known k ON k.w = l.w LEFT JOIN near n ON n.w = l.w)
SELECT d.doc_id, count(*) FILTER (full_) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND near) AS n_near,
       CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) END AS text_sha256
FROM documents d LEFT JOIN judged j ON j.doc_id = d.doc_id GROUP BY d.doc_id
"""

_OP2 = """
WITH d AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source),
v AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM t),
f AS (SELECT *, sum(s) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(2 * s) OVER o, 0) AS ls, CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS BIGINT) AS lw
      FROM v WINDOW o AS (ORDER BY CAST(s AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CAST(ls AS DOUBLE) * w / lw >= 2 * s AS capped FROM f),
h AS (SELECT CAST(arg_max(ls, lw) AS DOUBLE) AS ls, max(lw) AS lw FROM g WHERE NOT capped),
r AS (SELECT source, s, CASE WHEN s = 0 THEN 0 WHEN capped OR h.lw IS NULL THEN CAST(2 * s AS DOUBLE) ELSE h.ls * w / h.lw END AS target FROM g, h),
c AS (SELECT d.doc_id, d.size, r.s, r.target, CASE WHEN r.s > 0 THEN r.target / r.s ELSE 0 END AS rate,
             CAST('0x' || substr(md5('SEED:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || md5(coalesce(d.text, ''))), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, s AS source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM c
""".replace("SEED", mixing.SEED)

_OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM benchmark),
p AS (SELECT item_id, w[i:i+least(len(w), 13)-1] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
q AS (SELECT DISTINCT len(x) AS n FROM p),
e AS (SELECT doc_id, i, n, w[i:i+n-1] AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, q WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM e JOIN p USING (x)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""

_OP10 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(3, -1, -1), lambda k:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(CAST('0x' || substr(h, CAST(g * 5 + 1 AS INT), 5) AS BIGINT) // CAST(pow(32, k) AS BIGINT)) % 32 + 1]), '')), '') AS payload_digest,
      min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM q
"""

_OP11 = f"""
WITH table_ AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT {_WORDS.format(t="coalesce(text, '')")} AS w FROM benchmark),
of_docs AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
of_items AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
known AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM of_docs UNION SELECT f FROM of_items)),
crcs AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM known, table_),
s AS (SELECT bucket, count(*) AS n FROM of_docs JOIN crcs USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM of_items JOIN crcs USING (f) GROUP BY bucket),
whole AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS sn, coalesce((SELECT sum(n) FROM t), 0) AS tn),
g AS (SELECT s.bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (sn + 10000) AS DOUBLE) / CAST((s.n + 1) * (tn + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), whole),
m AS (SELECT doc_id, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM of_docs JOIN crcs USING (f) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT d.doc_id, len(d.w) AS words, coalesce(m.n, 0) AS n_features, coalesce(m.weight, 0) AS weight, CAST('0x' || substr(sha256('SEED:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (doc_id)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM y WHERE words >= 20)
SELECT y.doc_id, y.n_features, y.weight, y.score, CASE WHEN z.r <= 25 * z.n // 100 THEN z.r END AS rank FROM y LEFT JOIN z USING (doc_id)
""".replace("SEED", resampling.SEED)

_OP12 = """
WITH d AS (SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t), regexp_matches(t, '[#$%&*|]'), doc_id > first] AS f FROM w),
k AS (SELECT m.part, m.f, l.quality = 1 AS good, l.toxic = 1 AS toxic FROM m LEFT JOIN labels l USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM k GROUP BY part, f),
o AS (SELECT a.i AS i1, b.i AS i2, c.i AS i3, d.i AS i4, e.i AS i5 FROM range(1, 6) a(i), range(1, 6) b(i), range(1, 6) c(i), range(1, 6) d(i), range(1, 6) e(i) WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
p AS (SELECT [i1, i2, i3, i4, i5] AS q, array_to_string(list_transform([i1, i2, i3, i4, i5], lambda x: 'ABCDE'[x]), '') AS filter_order FROM o),
s AS (SELECT q, filter_order, step, q[step] AS own FROM p, range(1, 6) r(step)),
x AS (SELECT c.part, s.filter_order, CAST(s.step AS INT) AS step, s.own, c.n, c.good, c.toxic, c.f[s.own] AS fails, list_bool_or(list_transform(s.q[1:s.step-1], lambda j: c.f[j])) AS gone,
             len(list_filter(c.f, lambda y: y)) = 1 AS alone FROM c, s),
r AS (SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT coalesce(gone, false)), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT coalesce(gone, false)), 0) AS BIGINT) AS removed,
             CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails AND alone), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(good) FILTER (fails AND NOT coalesce(gone, false)), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fails AND NOT coalesce(gone, false)), 0) AS BIGINT) AS toxic_lost FROM x GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""


def oracle_sql() -> dict[str, str]:
    """Those of op4 to op9, of op13 and of the pipeline have none: decoding, models, searches for
    neighbours and merges are held against brute force in the tests."""
    return {"op1_line_dedup": _OP1, "op2_mixing": _OP2, "op3_decontamination": _OP3, "op10_warc": _OP10, "op11_resampling": _OP11, "op12_filter_audit": _OP12}
