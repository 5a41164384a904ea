"""Detection from SQL: temporary functions of a session, that need neither Python nor DataFrames.

``detect_spans(text)`` gives the merged spans of a text as an array; ``detected(text)``
is a table function of a row each, for ``LATERAL``. Spark puts their definitions in
place of their calls, so that filters and columns are pruned as in any query and no
worker leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from redactum.functions.rare_icd10 import RARE_CODES
from redactum.operators.detect import SPAN, detection_sql


def register(spark: SparkSession, catalogue: Mapping[str, str] | None = RARE_CODES, labels: Sequence[str] | None = None, prefix: str = "") -> None:
    """Makes both functions known to the session, under ``prefix``; ``labels`` limits the rules.

    A null text has no spans.
    """
    spans = detection_sql("t", catalogue, labels)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}detect_spans(t STRING) RETURNS array<{SPAN}> RETURN {spans}")
    columns = ", ".join("`{}` {}".format(*f.split(":")) for f in SPAN.removeprefix("struct<").removesuffix(">").split(","))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}detected(t STRING) RETURNS TABLE ({columns}) RETURN SELECT s.* FROM explode({spans}) AS x(s)")
