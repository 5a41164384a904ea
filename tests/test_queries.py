import duckdb
import pytest
from pyspark.sql import functions as F

from redactum import evidence, file_queries, page_queries
from redactum import queries as q
from redactum.functions.rules import RULES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(str(r[i]) for i in order) for r in values)


QUERIES, ORACLES = q.queries() | evidence.queries() | file_queries.queries() | page_queries.queries(), q.oracle_sql() | evidence.oracle_sql() | file_queries.oracle_sql() | page_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    sql = ORACLES.get(name)
    if sql:
        out = con.execute(sql)
        names = [d[0] for d in out.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, out.fetchall())
    else:
        assert got


def test_every_label_occurs_in_a_query_with_an_oracle(con):
    found = {"NAME"} if con.execute(ORACLES["rules_name_forms"]).fetchall() else set()
    for name in [*q._GROUPS, "rules_more"]:
        found |= {x[0] for x in con.execute(f"SELECT DISTINCT label FROM ({ORACLES[name]})").fetchall()}
    assert {r.label for r in RULES} <= found


@pytest.mark.parametrize("name", ["replaced_texts", "pseudonymised_texts"])
def test_texts_of_a_small_file_are_dealt_over_the_cores(spark, name):
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_files_are_made_no_longer_than_their_preview(spark):
    keys = spark.sql("SELECT explode(array(0, 1, 2, 408, 409, 410, 411, 4094, 4095, 4096, 4097, 4098, 200000, 200001, 200002)) AS c_custkey").withColumn("c_custkey", F.col("c_custkey").cast("bigint"))
    for row in keys.selectExpr(f"substring({evidence._BODY}, 1, 4096) AS whole", f"substring({evidence._SEEN}, 1, 4096) AS seen", f"length({evidence._SEEN}) AS n").collect():
        assert row.whole == row.seen and row.n < 2 * 4096
