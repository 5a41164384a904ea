"""DETECT: rule matches with offsets, overlap merging, buckets and counts.

A rule's matches get control characters around them; splitting there and running sums
of the lengths give offsets, all inside the JVM. Rules run on their own, their overlaps
are resolved afterwards by a left fold over each run of sorted spans that overlap. Both
take a time in proportion to a text's length, but for a logarithm.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from string import ascii_letters, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactum.functions.columns import held
from redactum.functions.rules import FAILED_NHS_PRIORITY, OTHER_PRIORITY, PARTICLES, PRIORITY, RULES, STARTER_HEADS, Rule
from redactum.functions.sql import BLANKS, cut, let, lit, pieces, running

#: Offsets are code points, ends exclusive. ``prio`` decides overlaps.
SPAN = "struct<start:int,end:int,text:string,label:string,category:string,source:string,confidence:double,cap_start:int,cap_end:int,rare_tier:string,prio:int>"
SPAN_FIELDS = ("start", "end", "text", "label", "category", "source", "confidence", "cap_start", "cap_end", "rare_tier", "prio")
NO_SPANS = f"CAST(array() AS array<{SPAN}>)"
_HIT = "struct<s:int,m:string,c:string>"
NO_HITS = "CAST(array() AS array<struct<k:int,s:int,m:string,c:string>>)"
#: What folds to ASCII letters without being any.
FOLDED = "\u0130\u0131\u017F\u212A"
ACCEPT, REVIEW = 0.85, 0.5
#: Parts of a text up to which its matches are folded one by one.
FEW = 100


def _clean(text: str) -> str:
    """The marks' characters become another character that no pattern treats differently."""
    return f"translate({text}, '\x01\x02\x03', '���')"


def _gate(rule: Rule, low: str) -> str:
    tests = [" OR ".join(f"contains({low}, {lit(g)})" for g in rule.gate)] if rule.gate else []
    if rule.digit:
        tests.append("has_digit_")
    return " AND ".join(f"({t})" for t in tests) or "true"


def parts_sql(text: str, pattern: str, groups: int = 0) -> str:
    """The text cut at its matches: every second part is a match, with its first group behind a mark."""
    group = "\x03" + "".join(f"${k}" for k in range(1, groups + 1)) if groups else ""
    # One character to cut at is no pattern, so that nothing is compiled for each text.
    return f"split(regexp_replace({text}, {lit(pattern)}, {lit(f'\x01$0{group}\x01')}), '\x01', -1)"


def hits_sql(parts: str) -> str:
    """array<struct<s, m, c>> of the parts of a text: a part's place is the length of those before it."""
    hit = lambda at: f"named_struct('s', {at}, 'm', whole_[i], 'c', substring(parts_[i], length(whole_[i]) + 2))"
    every = "sequence(1, size(parts_) - 2, 2)"
    many = let(let("transform(whole_, x -> length(x))", "lengths_", running("lengths_", "p + q")), "ends_", f"transform({every}, i -> {hit('ends_[i - 1]')})")
    # A few matches are found faster by a fold, which copies what it has built at every step.
    at = "a.at + length(whole_[i - 1])"
    few = f"aggregate({every}, named_struct('at', 0, 'out', CAST(array() AS array<{_HIT}>)), (a, i) -> named_struct('at', {at} + length(whole_[i]), 'out', concat(a.out, array({hit(at)}))), a -> a.out)"
    found = let("transform(parts_, (x, i) -> IF(i % 2 = 1, substring_index(x, '\x03', 1), x))", "whole_", f"IF(size(parts_) < {FEW}, {few}, {many})")
    return let(parts, "parts_", f"IF(size(parts_) < 3, CAST(array() AS array<{_HIT}>), {found})")


def matches_sql(text: str, pattern: str, groups: int = 0) -> str:
    """array<struct<s, m, c>>: place (from 0), match and first group of every match."""
    return hits_sql(parts_sql(text, pattern, groups))


def valid_nhs_sql(x: str) -> str:
    """Whether the ten digits of a text have the right check digit, modulo 11."""
    total = "aggregate(sequence(1, 9), 0, (a, i) -> a + CAST(substring(d_, i, 1) AS INT) * (11 - i))"
    return let(f"regexp_replace({x}, '[^0-9]', '')", "d_", let(f"(11 - {total} % 11) % 11", "check_", "length(d_) = 10 AND check_ <> 10 AND check_ = CAST(substring(d_, 10, 1) AS INT)"))


def kept_name_sql(c: str) -> str:
    """Length of the leading run of name words in a capture; 0 if there is none.

    A word counts if it starts with a capital or its part before ``-`` or ``'`` is a
    particle; the run ends with its last word that has a capital.
    """
    particles = ", ".join(lit(p) for p in PARTICLES)
    good = f"w RLIKE {lit(f'^[{BLANKS}]*' + chr(92) + 'p{Lu}')} OR lower(regexp_extract(w, {lit(f'^[{BLANKS}]*([^' + chr(92) + '-' + chr(39) + ']*)')}, 1)) IN ({particles})"
    step = f"IF(a.go AND ({good}), named_struct('go', true, 'n', a.n + 1, 'last', IF(w RLIKE {lit(chr(92) + 'p{Lu}')}, a.n + 1, a.last)), named_struct('go', false, 'n', a.n, 'last', a.last))"
    # Words with the blanks before them, so that lengths add up.
    words = f"regexp_extract_all({c}, {lit(f'[{BLANKS}]*[^{BLANKS}]+')}, 0)"
    n = f"aggregate(words_, named_struct('go', true, 'n', 0, 'last', 0), (a, w) -> {step}, a -> a.last)"
    return let(words, "words_", f"length(array_join(slice(words_, 1, {n}), ''))")


def tier_sql(code: str, catalogue: Mapping[str, str] | None) -> str:
    """``auto``, ``flag`` or null: the exact code, then its head if it is ``auto`` or the code is unknown."""
    c = f"upper(regexp_replace({code}, {lit(f'[{BLANKS}]+')}, ''))"
    if catalogue is None:
        return f"IF(substring({c}, 1, 3) IN ({', '.join(lit(h) for h in STARTER_HEADS)}), 'flag', CAST(NULL AS STRING))"
    # One text of all codes of a tier: a code is looked up between commas, without a plan node for each.
    of = lambda tier, x: f"contains({lit(',' + ','.join(sorted(k for k, v in catalogue.items() if v == tier)) + ',')}, concat(',', {x}, ','))"
    h = "substring(c_, 1, 3)"
    # Most codes' heads are none of the catalogue's.
    known = f"contains({lit(',' + ','.join(sorted({k[:3] for k in catalogue})) + ',')}, concat(',', {h}, ','))"
    return let(c, "c_", f"CASE WHEN NOT {known} THEN CAST(NULL AS STRING) WHEN {of('auto', 'c_')} OR {of('auto', h)} THEN 'auto' WHEN {of('flag', 'c_')} OR {of('flag', h)} THEN 'flag' END")


def span_sql(**v: str) -> str:
    base = {"category": "'HIPAA'", "source": "'rule'", "confidence": "1.0D", "cap_start": "CAST(NULL AS INT)", "cap_end": "CAST(NULL AS INT)", "rare_tier": "CAST(NULL AS STRING)"} | v
    return "named_struct(" + ", ".join(f"'{f}', {base[f]}" for f in SPAN_FIELDS) + ")"


def passes(rules: Sequence[Rule]) -> list[list[int]]:
    """Numbers of the rules that are looked for together, at words that start with a digit and at those that start with a letter.

    A rule that may start elsewhere is in none of them.
    """
    found = [[i for i, r in enumerate(rules) if r.first and (r.fast or r.pattern.startswith(r"\b")) and not r.anywhere and re.search(r.first.replace(r"\p{Lu}", "A-Z"), chars, re.I if "i" in r.flags else 0)] for chars in (digits, ascii_letters)]
    return found if all(len(x) > 1 for x in found) else []


def pass_parts_sql(text: str, rules: Sequence[Rule], numbers: Sequence[int], letters: bool) -> str:
    """The text cut where a word starts that any of the rules matches at: every second part is a list of their matches.

    What a rule matches at a place does not depend on the places before, so that one walk over
    the text does for all of them; ``apart_sql`` leaves out what starts inside a rule's match before.
    """
    ahead, back, fields, g = [], [], [], 1
    for r in (rules[i] for i in numbers):
        ahead.append(f"(?=({r.java})|)")
        back.append(f"\\{g}")
        fields.append(f"${g}" + ("\x02" + "".join(f"${g + k}" for k in range(1, r.groups + 1)) if r.groups else ""))
        g += 1 + r.groups
    # Letters that fold to ASCII ones are no ASCII word's: a word's edge is before them if one of it precedes.
    start = f"(?:(?=[A-Za-z])(?<!\\w)|(?=[{FOLDED}])(?<=\\w))" if letters else "(?=[0-9])(?<!\\w)"
    pattern = f"{start}{''.join(ahead)}(?:{'|'.join(f'(?={x})' for x in back)})"
    return f"split(regexp_replace({text}, {lit(pattern)}, {lit(chr(1) + chr(3).join(fields) + chr(1))}), '\x01', -1)"


def pass_hits_sql(parts: str, numbers: Sequence[int]) -> str:
    """array<struct<k, s, m, c>> of the parts of a text: number of the rule, place, match, first group."""
    rule = f"array({', '.join(map(str, numbers))})"
    shape = lambda at: f"named_struct('k', {rule}[j], 's', {at}, 'm', m, 'c', substring(fields_[j], length(m) + 2))"
    match = "substring_index(fields_[j], '\x02', 1)"
    hits = lambda at: let("split(parts_[i], '\x03', -1)", "fields_", f"transform(filter(sequence(0, {len(numbers) - 1}), j -> length(fields_[j]) > 1), j -> {let(match, 'm', shape(at))})")
    every = "sequence(1, size(parts_) - 2, 2)"
    lengths = "transform(parts_, (x, i) -> IF(i % 2 = 1, 0, length(x)))"
    many = let(let(lengths, "lengths_", running("lengths_", "p + q")), "ends_", f"flatten(transform({every}, i -> {hits('ends_[i - 1]')}))")
    at = "a.at + length(parts_[i - 1])"
    few = f"aggregate({every}, named_struct('at', 0, 'out', {NO_HITS}), (a, i) -> named_struct('at', {at}, 'out', concat(a.out, {hits(at)})), a -> a.out)"
    return let(parts, "parts_", f"CASE WHEN size(parts_) < 3 THEN {NO_HITS} WHEN size(parts_) < {FEW} THEN {few} ELSE {many} END")


def apart_sql(hits: str) -> str:
    """Of sorted hits those that do not start inside a match before of the same rule that counts."""
    start, end = "CAST(h.k AS BIGINT) * 4294967296 + h.s", "CAST(h.k AS BIGINT) * 4294967296 + h.s + length(h.m)"
    starts = "filter(sequence(0, size(all_) - 1), i -> i = 0 OR starts_[i] >= reach_[i - 1])"
    next_ = "IF(n + 1 < size(runs_), runs_[n + 1], size(all_))"
    step = "IF(starts_[i] < a.at, a, named_struct('at', ends_[i], 'out', concat(a.out, array(all_[i]))))"
    one = f"aggregate(sequence(b, {next_} - 1), named_struct('at', CAST(0 AS BIGINT), 'out', {NO_HITS}), (a, i) -> {step}, a -> a.out)"
    walked = let(running("ends_", "greatest(p, q)"), "reach_", let(starts, "runs_", f"flatten(transform(runs_, (b, n) -> {one}))"))
    meet = "exists(sequence(1, size(all_) - 1), i -> starts_[i] < ends_[i - 1])"
    checked = let(f"transform(all_, h -> {start})", "starts_", let(f"transform(all_, h -> {end})", "ends_", f"IF({meet}, {walked}, all_)"))
    return let(hits, "all_", f"IF(size(all_) < 2, all_, {checked})")


def cut_sql(rules: Sequence[Rule]) -> str:
    """array<array<string>>: the parts of ``clean_`` by each pass, then by each rule that is in none."""
    together = passes(rules)
    parts = []
    for n, numbers in enumerate(together):
        gates = [f"({_gate(rules[i], 'low_')})" for i in numbers]
        gate = "true" if "(true)" in gates else " OR ".join(dict.fromkeys(gates))
        parts.append(f"IF({gate}, {pass_parts_sql('clean_', rules, numbers, n == 1)}, CAST(array() AS array<string>))")
    alone = _alone(rules, together)
    parts += [f"IF({_gate(rules[i], 'low_')}, {parts_sql('clean_', rules[i].java, rules[i].groups)}, CAST(array() AS array<string>))" for i in alone]
    return f"array({', '.join(parts)})"


def _alone(rules: Sequence[Rule], together: Sequence[Sequence[int]]) -> list[int]:
    return [i for i in range(len(rules)) if not any(i in x for x in together)]


def all_hits_sql(rules: Sequence[Rule]) -> str:
    """array<struct<k, s, m, c>> of ``cut_``, by rule and place."""
    together = passes(rules)
    found = [pass_hits_sql(f"cut_[{n}]", numbers) for n, numbers in enumerate(together)]
    found += [f"transform({hits_sql(f'cut_[{len(together) + n}]')}, h -> named_struct('k', {i}, 's', h.s, 'm', h.m, 'c', h.c))" for n, i in enumerate(_alone(rules, together))]
    return apart_sql(f"array_sort(concat({', '.join(found)}))")


def spans_sql(rules: Sequence[Rule], catalogue: Mapping[str, str] | None) -> str:
    """The spans of ``hits_``, by rule and place."""
    which = lambda test: [i for i, r in enumerate(rules) if test(r)]
    is_ = lambda numbers: f"h.k IN ({', '.join(map(str, numbers))})" if numbers else "false"
    of = lambda x: f"array({', '.join(map(x, rules))})[h.k]"
    names, nhs, rare, age = which(lambda r: r.label == "NAME" and "i" in r.flags), which(lambda r: r.label == "NHS_NUMBER"), which(lambda r: r.label == "RARE_DISEASE_ICD"), which(lambda r: r.label == "AGE_OVER_89")
    last = "IF(h.c = '', CAST(NULL AS INT), length(h.m) - length(h.c) - (instr(reverse(h.m), reverse(h.c)) - 1))"
    kept = f"IF({is_(names)}, {kept_name_sql('h.c')}, length(h.c))" if names else "length(h.c)"
    tier = f"IF({is_(rare)}, {tier_sql('h.m', catalogue)}, CAST(NULL AS STRING))" if rare else "CAST(NULL AS STRING)"
    failed = f"IF({is_(nhs)}, NOT {valid_nhs_sql('h.m')}, false)" if nhs else "false"
    more = f"transform(hits_, h -> named_struct('k', h.k, 's', h.s, 'm', h.m, 'c', h.c, 'last', {last}, 'kept', {kept}, 'tier', {tier}, 'failed', {failed}))"
    tests = [f"NOT ({is_(names)}) OR h.kept > 0"] * bool(names) + [f"NOT ({is_(rare)}) OR h.tier IS NOT NULL"] * bool(rare) + [f"NOT ({is_(age)}) OR coalesce(CAST(h.c AS INT) BETWEEN 90 AND 130, false)"] * bool(age)
    if tests:
        more = f"filter({more}, h -> {' AND '.join(f'({t})' for t in tests)})"
    # A name gives up the words behind it that are none, and so does a match that ends with it.
    end = "IF(h.kept < length(h.c) AND h.last + length(h.c) = length(h.m), h.s + h.last + h.kept, h.s + length(h.m))"
    shape = span_sql(
        start="h.s", end=end, text=f"substring(h.m, 1, {end} - h.s)", label=f"IF(h.failed, 'REFERENCE_ID', {of(lambda r: lit(r.label))})", category=f"IF(h.failed, 'HIPAA', {of(lambda r: lit(r.category))})",
        cap_start="h.s + h.last", cap_end="h.s + h.last + h.kept", rare_tier="h.tier", prio=f"IF(h.failed, {FAILED_NHS_PRIORITY}, {of(lambda r: str(PRIORITY[r.label]))})",
    )
    return f"transform({more}, h -> CAST({shape} AS {SPAN}))"


def run_rules(df: DataFrame, text: str = "text", out: str = "rule_spans", catalogue: Mapping[str, str] | None = None, labels: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the raw spans of all rules in ``out``, in the catalogue's order.

    ``catalogue`` gives the tier of ICD-10 codes; ``labels`` limits the rules. A null
    text has no spans.
    """
    rules = [r for r in RULES if labels is None or r.label in labels]
    t = f"coalesce(`{text}`, '')"
    df = held(df, {"text_": F.expr(t), "clean_": F.expr(_clean(t))})
    df = held(df, {"low_": F.lower("clean_"), "has_digit_": F.expr("clean_ RLIKE '[0-9]'")})
    df = held(df, {"cut_": F.expr(cut_sql(rules))})
    df = held(df, {"hits_": F.expr(all_hits_sql(rules))})
    df = held(df, {"found_": F.expr(spans_sql(rules, catalogue))})
    # Where the text has characters like the marks, a span's text is taken from it as it was.
    as_it_was = "named_struct(" + ", ".join(f"'{f}', {cut('pieces_', 's.start', 's.end') if f == 'text' else f's.{f}'}" for f in SPAN_FIELDS) + ")"
    own = let(pieces("text_"), "pieces_", f"transform(found_, s -> CAST({as_it_was} AS {SPAN}))")
    return held(df, {out: F.expr(f"IF(clean_ = text_, found_, {own})")}).drop("text_", "clean_", "low_", "has_digit_", "cut_", "hits_", "found_")


def detection_sql(text: str, catalogue: Mapping[str, str] | None = None, labels: Sequence[str] | None = None) -> str:
    """SQL for the merged spans of a text as one expression, for surfaces that have no columns to build on.

    The same builders as in ``run_rules``; each step has a name of its own, in a lambda.
    """
    rules = [r for r in RULES if labels is None or r.label in labels]
    as_it_was = "named_struct(" + ", ".join(f"'{f}', {cut('pieces_', 's.start', 's.end') if f == 'text' else f's.{f}'}" for f in SPAN_FIELDS) + ")"
    own = let(pieces("text_"), "pieces_", f"transform(found_, s -> CAST({as_it_was} AS {SPAN}))")
    spans = let(spans_sql(rules, catalogue), "found_", f"IF(clean_ = text_, found_, {own})")
    spans = let(cut_sql(rules), "cut_", let(all_hits_sql(rules), "hits_", spans))
    spans = let("lower(clean_)", "low_", let("clean_ RLIKE '[0-9]'", "has_digit_", spans))
    whole = let(f"coalesce({text}, '')", "text_", let(_clean("text_"), "clean_", spans))
    return let(whole, "raw_", merge_sql("raw_"))


def merge_sql(spans: str) -> str:
    """Overlapping spans as one: the union's extent, the winner's other fields, no capture.

    The winner has the higher priority, then the greater length (of the union so far),
    then is the earlier one if that came from a model, else the later one. Spans that
    touch stay apart.
    """
    order = "CASE WHEN l.start < r.start THEN -1 WHEN l.start > r.start THEN 1 WHEN l.end > r.end THEN -1 WHEN l.end < r.end THEN 1 ELSE 0 END"
    first = "CASE WHEN a.prio <> s.prio THEN a.prio > s.prio WHEN a.end - a.start <> s.end - s.start THEN a.end - a.start > s.end - s.start ELSE a.source = 'ner' END"
    fields = {f: f"IF(w, a.{f}, s.{f})" for f in SPAN_FIELDS} | {"start": "least(a.start, s.start)", "end": "greatest(a.end, s.end)", "cap_start": "CAST(NULL AS INT)", "cap_end": "CAST(NULL AS INT)"}
    union = "named_struct(" + ", ".join(f"'{f}', {fields[f]}" for f in SPAN_FIELDS) + ")"
    step = f"IF(a IS NULL, CAST(s AS {SPAN}), CAST({let(first, 'w', union)} AS {SPAN}))"
    # A run starts where no span before reaches: each run is folded on its own.
    starts = "filter(sequence(0, size(sorted_) - 1), i -> i = 0 OR sorted_[i].start >= reach_[i - 1])"
    next_ = "IF(k + 1 < size(starts_), starts_[k + 1], size(sorted_))"
    runs = f"transform(starts_, (b, k) -> aggregate(slice(sorted_, b + 1, {next_} - b), CAST(NULL AS {SPAN}), (a, s) -> {step}))"
    merged = let(let("transform(sorted_, s -> s.end)", "ends_", running("ends_", "greatest(p, q)")), "reach_", let(starts, "starts_", runs))
    return let(f"array_sort({spans}, (l, r) -> {order})", "sorted_", f"IF(size(sorted_) < 2, sorted_, {merged})")


def counts_sql(spans: str) -> str:
    """map<label, count>, labels in the order of their first span."""
    labels = f"array_distinct(transform({spans}, s -> s.label))"
    return f"map_from_arrays({labels}, transform({labels}, l -> size(filter({spans}, s -> s.label = l))))"


def detect(df: DataFrame, text: str = "text", model_spans: str | None = None, forced_label: str | None = None, catalogue: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with ``detection``: struct(spans, quasi, uncertain, counts).

    ``model_spans`` names a column of spans of a model: confidence of 0.85 or more takes
    part in the merge, of 0.5 or more goes to ``uncertain``, less is dropped, none counts
    as 1. ``forced_label`` names a column whose label, where it is not null, covers a
    whole text that is not blank. Order for ties: rules, model, forced.
    """
    df = run_rules(df, text, "raw_", catalogue)
    parts, unsure = ["raw_"], NO_SPANS
    if model_spans:
        m = f"coalesce(`{model_spans}`, {NO_SPANS})"
        parts.append(f"filter({m}, s -> coalesce(s.confidence, 1.0D) >= {ACCEPT}D)")
        unsure = f"filter({m}, s -> coalesce(s.confidence, 1.0D) >= {REVIEW}D AND coalesce(s.confidence, 1.0D) < {ACCEPT}D)"
    if forced_label:
        prio = "CASE x " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in PRIORITY.items()) + f" ELSE {OTHER_PRIORITY} END"
        whole = span_sql(start="0", end=f"length(`{text}`)", text=f"`{text}`", label="x", prio=prio)
        parts.append(f"IF(`{forced_label}` IS NOT NULL AND coalesce(`{text}`, '') RLIKE {lit(f'[^{BLANKS}]')}, transform(array(`{forced_label}`), x -> CAST({whole} AS {SPAN})), {NO_SPANS})")
    df = held(df, {"merged_": F.expr(merge_sql(f"concat({', '.join(parts)})"))})
    df = held(df, {"detection": F.expr(f"named_struct('spans', filter(merged_, s -> s.category <> 'QUASI'), 'quasi', filter(merged_, s -> s.category = 'QUASI'), 'uncertain', {unsure}, 'counts', {counts_sql('merged_')})")})
    return df.drop("raw_", "merged_")


def label_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, n) over all detected spans."""
    spans = df.select(*by, F.explode(F.expr("concat(detection.spans, detection.quasi)")).alias("s"))
    return spans.groupBy(*by, F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def default_quasi(df: DataFrame, suppress_all: bool, mode: str = "", from_check: bool = False) -> DataFrame:
    """``df`` with ``redact``: the quasi labels to redact unless a reviewer says otherwise.

    All that occur if the profile suppresses them (from a compliance check also in
    ANONYMISE mode), else rare diseases if one of them has the tier ``auto``.
    """
    every = suppress_all or (from_check and mode == "ANONYMISE")
    if every:
        return held(df, {"redact": F.expr("array_distinct(transform(detection.quasi, s -> s.label))")})
    return held(df, {"redact": F.expr("IF(exists(detection.quasi, s -> s.rare_tier = 'auto'), array('RARE_DISEASE_ICD'), CAST(array() AS array<string>))")})
