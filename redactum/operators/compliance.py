"""COMPLIANCE: may a record be shared or uploaded, and why not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactum.functions.columns import held
from redactum.functions.rules import HIGH, MEDIUM, STRONG
from redactum.functions.sql import BLANKS, js_trim, lit, to_java

# Words of a health context, texts and limits of a report.
HEALTH = r"\b(?:patient|diagnos(?:is|ed)|condition|symptom|clinic|clinical|treatment|therapy|medicine|medication|prescription|dose|surgery|admission|discharge|ward|consultant|doctor|nurse|hospital|mrn|nhs|diabetes|cancer|asthma|hypertension|infection|disease|icd-?10|lab|blood|scan|x-?ray|mri|ct)\b"
JURISDICTIONS = {
    "EU": "EU: GDPR + EU AI Act + EHDS",
    "UK": "UK: UK GDPR + DPA 2018 + ICO guidance",
    "US": "US: HIPAA + AI processor caution",
    "GENERAL": "General / International AI upload safety",
}
VERDICTS = {
    "SAFE": ("Safe", "No obvious personal or health identifiers were found. Review the document manually before sharing."),
    "NEEDS_DEIDENTIFICATION": ("Needs de-identification", "This document contains personal or health information. De-identify it before distribution or AI upload."),
    "DO_NOT_UPLOAD": ("Do not upload/share", "This document appears unsafe to share or upload to AI unless you have a compliant legal basis and processor agreement."),
}
AI_UNSAFE = {
    "EU": "Identifiable health or personal data was detected. AI upload is unsafe unless GDPR, EU AI Act, EHDS, and processor obligations are satisfied.",
    "UK": "Identifiable health or personal data was detected. AI upload is unsafe unless UK GDPR/DPA obligations and processor arrangements are satisfied.",
    "US": "PHI or identifiers were detected. AI upload is unsafe unless the recipient is covered by a suitable compliant arrangement such as a BAA.",
    "GENERAL": "Personal or health-related data was detected. Use anonymisation before AI upload unless you have a compliant processor arrangement.",
}
AI_SAFE = "No obvious personal or health identifiers were found. Confirm the document manually before upload."
SHARE_UNSAFE = "Personal or health-related data was detected. De-identify before sharing outside a controlled workflow."
SHARE_SAFE = "No obvious personal or health identifiers were found. Review manually before sharing."
CONCERN_RARE = "Rare disease information can identify a person even after direct identifiers are removed."
CONCERN_STRONG = {True: "Strong PHI identifier under HIPAA-style sharing rules.", False: "Strong personal-data identifier under the selected profile."}
CONCERN_DATE = "Dates can identify patients when combined with care events or location."
CONCERN_PLACE = "Location data can identify people when combined with health context."
CONCERN_QUASI = "Quasi-identifier that can re-identify a person in combination."
CONCERN_OTHER = "Potential personal or sensitive data detected."
NOTE_FIRST = "This screening is not legal advice. It is a conservative client-side risk check."
NOTE_HEALTH = "Health-data context was detected or inferred from the document."
NOTE_NEXT = "Recommended next step: de-identify the document before sharing."
VALUES, CONTEXTS, AROUND = 10, 5, 36


def _in(x: str, labels) -> str:
    return f"{x} IN ({', '.join(lit(v) for v in labels)})"


def severity_sql(label: str) -> str:
    return f"CASE WHEN {_in(label, HIGH)} THEN 'HIGH' WHEN {_in(label, MEDIUM)} THEN 'MEDIUM' ELSE 'LOW' END"


def rank_sql(severity: str) -> str:
    return f"CASE {severity} WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"


def concern_sql(label: str, jurisdiction: str) -> str:
    return (
        f"CASE WHEN {label} = 'RARE_DISEASE_ICD' THEN {lit(CONCERN_RARE)} WHEN {_in(label, STRONG)} THEN {lit(CONCERN_STRONG[jurisdiction == 'US'])} "
        f"WHEN {label} = 'DATE' THEN {lit(CONCERN_DATE)} WHEN {label} LIKE 'POSTCODE%' OR {label} = 'ADDRESS_LINE' THEN {lit(CONCERN_PLACE)} "
        f"WHEN {_in(label, ('ETHNICITY', 'OCCUPATION', 'INSTITUTION'))} THEN {lit(CONCERN_QUASI)} ELSE {lit(CONCERN_OTHER)} END"
    )


def context_sql(text: str, span: str) -> str:
    cut = f"substring({text}, greatest({span}.start - {AROUND}, 0) + 1, {span}.end + {AROUND} - greatest({span}.start - {AROUND}, 0))"
    squeezed = f"regexp_replace({cut}, {lit(f'[{BLANKS}]+')}, ' ')"
    return js_trim(squeezed)


def assess_compliance(df: DataFrame, jurisdiction: str = "GENERAL", text: str = "text", detection: str = "detection", unscreened_is_unsafe: bool = False) -> DataFrame:
    """``df`` with ``compliance``: the verdict, its texts and the findings by label.

    Findings stand by severity, then by first appearance. With ``unscreened_is_unsafe``
    (an addition) a null or blank text, from which nothing could be read, is not SAFE.
    """
    if jurisdiction not in JURISDICTIONS:
        raise ValueError(f"unknown jurisdiction {jurisdiction}")
    t = f"coalesce(`{text}`, '')"
    df = held(df, {"all_": F.expr(f"concat({detection}.spans, {detection}.quasi)")})
    df = held(df, {"health_": F.expr(f"{t} RLIKE {lit(to_java(HEALTH, 'i'))} OR exists({detection}.quasi, s -> {_in('s.label', ('RARE_DISEASE_ICD', 'ETHNICITY', 'INSTITUTION', 'OCCUPATION'))})")})
    rare, direct = f"exists({detection}.quasi, s -> s.label = 'RARE_DISEASE_ICD')", f"size({detection}.spans) > 0"
    blank = f" AND {t} RLIKE {lit(f'[^{BLANKS}]')}" if unscreened_is_unsafe else ""
    verdict = f"CASE WHEN size(all_) = 0 AND NOT health_{blank} THEN 'SAFE' WHEN {rare} OR (health_ AND {direct}) THEN 'DO_NOT_UPLOAD' ELSE 'NEEDS_DEIDENTIFICATION' END"
    df = held(df, {"verdict_": F.expr(verdict)})
    group = "filter(all_, s -> s.label = x)"
    finding = (
        f"named_struct('label', x, 'count', size({group}), 'severity', {severity_sql('x')}, 'concern', {concern_sql('x', jurisdiction)}, 'value_hidden', true, "
        f"'values', slice(array_distinct(transform({group}, s -> s.text)), 1, {VALUES}), 'contexts', transform(slice({group}, 1, {CONTEXTS}), s -> {context_sql(t, 's')}))"
    )
    order = f"{rank_sql('r.severity')} - {rank_sql('l.severity')}"
    df = held(df, {"findings_": F.expr(f"array_sort(transform(array_distinct(transform(all_, s -> s.label)), x -> {finding}), (l, r) -> {order})")})

    def per(verdicts: dict, k: int) -> str:
        return "CASE verdict_ " + " ".join(f"WHEN {lit(v)} THEN {lit(x[k])}" for v, x in verdicts.items()) + " END"

    safe = "verdict_ = 'SAFE'"
    notes = f"array_compact(array({lit(NOTE_FIRST)}, IF(health_, {lit(NOTE_HEALTH)}, NULL), IF({safe}, NULL, {lit(NOTE_NEXT)}), {lit(f'Profile used: {JURISDICTIONS[jurisdiction]}.')}))"
    out = (
        f"named_struct('jurisdiction', {lit(jurisdiction)}, 'jurisdiction_label', {lit(JURISDICTIONS[jurisdiction])}, 'verdict', verdict_, 'verdict_label', {per(VERDICTS, 0)}, 'verdict_description', {per(VERDICTS, 1)}, "
        f"'distribution', named_struct('safe', {safe}, 'label', IF({safe}, 'Appears safe for distribution', 'Not safe for distribution'), 'description', IF({safe}, {lit(SHARE_SAFE)}, {lit(SHARE_UNSAFE)})), "
        f"'ai_upload', named_struct('safe', {safe}, 'label', IF({safe}, 'Appears safe for AI upload', 'Not safe for AI upload'), 'description', IF({safe}, {lit(AI_SAFE)}, {lit(AI_UNSAFE[jurisdiction])})), "
        f"'findings', findings_, 'health_data', health_, 'primary_action', IF({safe}, 'NONE', 'ANONYMISE'), 'actions', IF({safe}, array('NONE'), array('ANONYMISE', 'PSEUDONYMISE')), 'notes', {notes})"
    )
    return held(df, {"compliance": F.expr(out)}).drop("all_", "health_", "verdict_", "findings_")


def share_safe(df: DataFrame, column: str = "compliance") -> DataFrame:
    """The report without the values and contexts of its findings."""
    bare = F.transform(F.col(column)["findings"], lambda f: f.dropFields("values", "contexts"))
    return df.withColumn(column, F.col(column).withField("findings", bare))


def findings_table(df: DataFrame, key: str) -> DataFrame:
    """One row per finding, as a table to report from."""
    return df.select(key, F.col("compliance.verdict").alias("verdict"), F.explode("compliance.findings").alias("f")).select(key, "verdict", "f.label", "f.count", "f.severity")
