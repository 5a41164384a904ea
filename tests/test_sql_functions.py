from pyspark.sql import functions as F

from redactum.functions.rare_icd10 import RARE_CODES
from redactum.operators.detect import detect
from redactum.plans.sql_functions import register

TEXTS = ["mail a@b.org MRN: A12-345 \x01 and Dr Holloway", None, "", "ICD E75.2 at St Mary Hospital", "call +44 161 496 0102 or see https://a.b/c, 943 476 5919", "é 😀 u@v.org u@v.org"]


def test_functions_give_what_detection_gives(spark):
    register(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100 AS id", "text"))
    df.createOrReplaceTempView("texts")
    want = detect(df, catalogue=RARE_CODES).select("id", F.explode(F.expr("array_sort(concat(detection.spans, detection.quasi))")).alias("s")).select("id", "s.*").drop("prio")
    as_array = spark.sql("SELECT id, s.* FROM (SELECT id, detect_spans(text) AS spans FROM texts) LATERAL VIEW explode(spans) v AS s").drop("prio")
    as_table = spark.sql("SELECT texts.id, d.* FROM texts, LATERAL detected(texts.text) AS d").drop("prio")
    expected = sorted(map(str, want.collect()))
    assert expected and sorted(map(str, as_array.collect())) == expected == sorted(map(str, as_table.collect()))
    assert "Python" not in as_table._jdf.queryExecution().executedPlan().toString()


def test_rules_of_some_labels_under_a_prefix(spark):
    register(spark, None, ["EMAIL"], "mail_")
    assert [tuple(r) for r in spark.sql("SELECT label, start, `end`, text FROM mail_detected('Dr Lee x@y.org')").collect()] == [("EMAIL", 7, 14, "x@y.org")]
    assert spark.sql("SELECT size(mail_detect_spans(NULL)) AS n").first().n == 0
