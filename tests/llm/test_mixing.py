import pytest
from pyspark.sql import functions as F

from redactum.llm import mixing as m


def level(sizes, weights=m.WEIGHTS):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, None: 5, "Z": 7, "é": 80}, {"a": 0, "b": 3}, {"x": 5}, {"a": 100, "b": 1, "c": 1, "d": 1, "e": 300}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in m.source_targets(df).collect()}
    assert got == pytest.approx(level(sizes))
    assert all(got[s] <= 2 * n for s, n in sizes.items())


def test_copies_follow_the_rate_and_reruns_agree(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    plan = m.plan_mix(df)
    rows = plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert all(abs(r.taken - r.target) < 0.03 * r.target and r.most <= 2 for r in rows)
    assert sorted(plan.collect()) == sorted(m.plan_mix(df.repartition(7)).select(plan.columns).collect())
    assert m.mix(df).count() == plan.agg(F.sum("copies")).first()[0]


@pytest.mark.parametrize("key", ["null", "1", "id"])
def test_targets_are_met_whatever_the_ids(spark, key):
    """Rows that share an id, or have none, draw apart by their texts: each source within five standard errors of its target."""
    df = spark.range(12_000).selectExpr(f"CAST({key if key != 'id' else 'id'} AS BIGINT) AS doc_id", "concat('one two three ', id) AS text", "concat('s', id % 5) AS source")
    plan = m.plan_mix(df)
    rows = plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.sum("size").alias("n")).collect()
    for r in rows:
        part = r.target / r.n % 1
        assert abs(r.taken - r.target) <= 5 * 4 * (2400 * part * (1 - part)) ** 0.5 + 1
    assert sorted(plan.collect(), key=str) == sorted(m.plan_mix(df.repartition(3)).select(plan.columns).collect(), key=str)


def test_levels_of_many_sources(spark):
    sizes = {f"s{i:03}": i * i % 97 + (10_000 if i % 50 == 0 else 0) for i in range(300)} | {None: 3}
    got = {r.source: r.target for r in m.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert got == pytest.approx(level(sizes))


def test_awkward(awkward, empty):
    got = m.plan_mix(awkward).collect()
    assert len(got) == awkward.count() and {r.size for r in got if r.doc_id in (3, 4, 5)} == {0}
    mixed = m.mix(awkward)
    assert set(mixed.columns) == set(awkward.columns) and mixed.collect() is not None
    assert m.plan_mix(empty).count() == 0 and m.mix(empty).count() == 0
