"""A reviewer's decisions as tables, applied by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactum.functions.rules import MANUAL, OTHER_PRIORITY, PRIORITY, QUASI
from redactum.functions.sql import js_trim, lit
from redactum.operators.detect import SPAN, SPAN_FIELDS, span_sql


def span_rows(df: DataFrame, key: str, spans: str) -> DataFrame:
    """(key, start, end, text, label, ...): an array of spans as rows."""
    return df.select(key, F.explode(F.expr(spans)).alias("s")).select(key, "s.*")


def dismiss(spans: DataFrame, dismissed: DataFrame, key: str) -> DataFrame:
    """Spans without those that (key, start, end, label) dismisses."""
    return spans.join(dismissed.select(key, "start", "end", "label").distinct(), [key, "start", "end", "label"], "left_anti")


def decide(uncertain: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Uncertain spans with ``decision``; what nobody decided counts as no."""
    asked = decisions.select(key, "start", "end", "label", "decision").dropDuplicates([key, "start", "end", "label"])
    return uncertain.join(asked, [key, "start", "end", "label"], "left").withColumn("decision", F.coalesce("decision", F.lit(False)))


def confirmed(uncertain: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Uncertain spans that a decision confirms."""
    return uncertain.join(decisions.where("decision").select(key, "start", "end", "label").distinct(), [key, "start", "end", "label"], "left_semi")


def decision_counts(uncertain: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """(key, undecided, confirmed, dismissed)."""
    asked = decisions.select(key, "start", "end", "label", "decision").dropDuplicates([key, "start", "end", "label"])
    rows = uncertain.join(asked, [key, "start", "end", "label"], "left")
    return rows.groupBy(key).agg(F.count_if(F.col("decision").isNull()).alias("undecided"), F.count_if(F.col("decision")).alias("confirmed"), F.count_if(~F.col("decision")).alias("dismissed"))


def manual_spans(texts: DataFrame, added: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Spans a reviewer marks: (key, start, end, label) cut to their text without blanks at
    the edges; of two characters at least; of the labels a reviewer may give."""
    rows = added.where(F.col("label").isin(*MANUAL)).join(texts.select(key, F.col(text).alias("whole_")), key)
    cut = "substring(whole_, start + 1, end - start)"
    rows = rows.withColumn("text", F.expr(js_trim(cut))).where("length(text) >= 2")
    rows = rows.withColumn("start", F.expr(f"start + instr({cut}, text) - 1")).withColumn("end", F.expr("start + length(text)"))
    prio = "CASE label " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in PRIORITY.items()) + f" ELSE {OTHER_PRIORITY} END"
    category = f"IF(label IN ({', '.join(lit(q) for q in QUASI)}), 'QUASI', 'HIPAA')"
    shape = span_sql(start="start", end="end", text="text", label="label", category=category, source="'ner'", prio=prio)
    return rows.select(key, F.expr(f"CAST({shape} AS {SPAN})").alias("s")).select(key, "s.*")


def active_spans(direct: DataFrame, added: DataFrame, uncertain: DataFrame, dismissed: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """What is redacted: direct spans not dismissed, marked ones and confirmed ones; not merged again."""
    return dismiss(direct, dismissed, key).unionByName(added).unionByName(confirmed(uncertain, decisions, key))


def with_spans(df: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """``df`` with the reviewed rows as ``detection.spans``; their number per record is bounded by its text."""
    lists = spans.groupBy(key).agg(F.collect_list(F.struct(*SPAN_FIELDS)).alias("reviewed_"))
    out = df.join(lists, key, "left")
    empty = F.array().cast(f"array<{SPAN}>")
    return out.withColumn("detection", F.col("detection").withField("spans", F.coalesce(F.col("reviewed_").cast(f"array<{SPAN}>"), empty))).drop("reviewed_")


def toggle_quasi(df: DataFrame, add: list[str] = (), remove: list[str] = (), column: str = "redact") -> DataFrame:
    """``df`` with labels added to and taken from the set of quasi labels to redact."""
    a, r = F.array(*map(F.lit, add)).cast("array<string>"), F.array(*map(F.lit, remove)).cast("array<string>")
    return df.withColumn(column, F.array_except(F.array_union(column, a), r))


def highlight(df: DataFrame, text: str = "text", spans: str = "detection.spans", out: str = "highlight") -> DataFrame:
    """``df`` with the text cut at its spans: array<struct<text, label>>, overlaps clipped."""
    piece = "struct<text:string,label:string>"
    order = "CASE WHEN l.start < r.start THEN -1 WHEN l.start > r.start THEN 1 WHEN l.end > r.end THEN -1 WHEN l.end < r.end THEN 1 ELSE 0 END"
    t = f"coalesce(`{text}`, '')"
    before = f"IF(s.start > a.at, array(named_struct('text', substring({t}, a.at + 1, s.start - a.at), 'label', CAST(NULL AS STRING))), CAST(array() AS array<{piece}>))"
    own = f"named_struct('text', substring({t}, greatest(s.start, a.at) + 1, s.end - greatest(s.start, a.at)), 'label', s.label)"
    step = f"IF(s.end <= a.at, a, named_struct('at', s.end, 'out', concat(a.out, {before}, array({own}))))"
    rest = f"IF(a.at < length({t}), concat(a.out, array(named_struct('text', substring({t}, a.at + 1), 'label', CAST(NULL AS STRING)))), a.out)"
    return df.withColumn(out, F.expr(f"aggregate(array_sort({spans}, (l, r) -> {order}), named_struct('at', 0, 'out', CAST(array() AS array<{piece}>)), (a, s) -> {step}, a -> {rest})"))
