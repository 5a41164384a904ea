"""Spans of a token-classification model: grouping of tokens, word snapping, plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactum.functions.columns import held
from redactum.functions.rules import OTHER_PRIORITY, PRIORITY
from redactum.functions.sql import BLANKS, cut, js_trim, let, lit, pieces
from redactum.operators.detect import SPAN, span_sql

#: struct of one token as models give it.
TOKEN = "struct<entity:string,word:string,start:int,end:int,score:double>"
# Entity types as labels, words that alone are no entity, the shortest span.
LABELS = {"PER": "NAME", "LOC": "ADDRESS_LINE", "ORG": "INSTITUTION"}
DOCUMENT_WORDS = frozenset("discharge summary patient report letter clinic ward date name address hospital department referral consultant notes record diagnosis treatment medication".split())
LEAST = 3


_INSIDE = r"[\p{L}\p{N}'_\-]"
#: Code points beside a token that are looked at first for the rest of its word.
_NEAR = 256


def groups_sql(tokens: str, parts: str) -> str:
    """array<struct<kind, s, e, score>>: neighbouring tokens of one type as one entity, from a
    text in ``pieces``.

    They touch, or blanks alone part them and the later one continues (``I-``). Whether
    a token starts an entity depends on the one before alone, so that no fold is needed:
    an entity runs from one start to the next.
    """
    kind = "substring_index({0}.entity, '-', -1)"
    gap = cut(parts, "y.end", "x.start")
    first = f"{kind.format('x')} <> {kind.format('y')} OR gap_ RLIKE {lit(f'[^{BLANKS}]')} OR (gap_ <> '' AND left(x.entity, greatest(length(x.entity) - length({kind.format('x')}) - 1, 0)) = 'B')"
    starts = f"filter(sequence(0, size({tokens}) - 1), i -> i = 0 OR {let(f'{tokens}[i]', 'x', let(f'{tokens}[greatest(i - 1, 0)]', 'y', let(gap, 'gap_', first)))})"
    members = f"slice({tokens}, b + 1, IF(k + 1 < size(starts_), starts_[k + 1], size({tokens})) - b)"
    one = f"named_struct('kind', {kind.format('m[0]')}, 's', m[0].start, 'e', m[size(m) - 1].end, 'score', aggregate(m, 0.0D, (a, t) -> a + t.score) / size(m))"
    return f"IF(size({tokens}) = 0, array(), {let(starts, 'starts_', f'transform(starts_, (b, k) -> {let(members, chr(109), one)})')})"


def spans_sql(groups: str, parts: str, length: str, offset: str = "0") -> str:
    """Entities as spans: whole words, three characters at least, no lone document word."""
    left = lambda a: f"length(regexp_extract({cut(parts, a, 'g.s')}, {lit(_INSIDE + '*' + chr(92) + 'z')}, 0))"
    right = lambda b: f"length(regexp_extract({cut(parts, 'g.e', b)}, {lit('^' + _INSIDE + '*')}, 0))"
    near = lambda n, far: let(n, "n_", f"IF(n_ < {_NEAR}, n_, {far})")
    s, e = f"g.s - {near(left(f'greatest(g.s - {_NEAR}, 0)'), left('0'))}", f"g.e + {near(right(f'least(g.e + {_NEAR}, {length})'), right(length))}"
    whole = f"transform({groups}, g -> {let(s, 's_', let(e, 'e_', f'named_struct({chr(39)}kind{chr(39)}, g.kind, {chr(39)}s{chr(39)}, s_, {chr(39)}e{chr(39)}, e_, {chr(39)}score{chr(39)}, g.score, {chr(39)}t{chr(39)}, ' + cut(parts, 's_', 'e_') + ')'))})"
    known = ", ".join(lit(k) for k in LABELS)
    kept = f"filter({whole}, g -> g.kind IN ({known}) AND length({js_trim('g.t')}) >= {LEAST} AND lower(g.t) NOT IN ({', '.join(lit(w) for w in sorted(DOCUMENT_WORDS))}))"
    of = lambda table, other: "CASE g.kind " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in table.items()) + f" ELSE {other} END"
    label = of({k: lit(v) for k, v in LABELS.items()}, "NULL")
    shape = span_sql(start=f"g.s + {offset}", end=f"g.e + {offset}", text="g.t", label=label, category=of({k: lit("QUASI") for k, v in LABELS.items() if v == "INSTITUTION"}, lit("HIPAA")), source="'ner'", confidence="g.score", prio=of({k: str(PRIORITY.get(v, OTHER_PRIORITY)) for k, v in LABELS.items()}, "0"))
    return f"transform({kept}, g -> CAST({shape} AS {SPAN}))"


def token_spans(df: DataFrame, tokens: str = "tokens", text: str = "text", out: str = "model_spans", offset: str = "0") -> DataFrame:
    """``df`` with the spans of the column ``tokens`` (array of ``TOKEN``) in ``out``, inside the JVM.

    Null tokens and null texts have no spans, tokens that lie outside their text do not count. ``offset`` (SQL) is added to the places, for
    texts that are a part of another.
    """
    t = f"coalesce(`{text}`, '')"
    df = held(df, {"tokens_": F.expr(f"filter(CAST(coalesce(`{tokens}`, array()) AS array<{TOKEN}>), x -> x.start >= 0 AND x.start <= x.end AND x.end <= length({t}))"), "pieces_": F.expr(pieces(t))})
    df = held(df, {"groups_": F.expr(groups_sql("tokens_", "pieces_"))})
    return held(df, {out: F.expr(spans_sql("groups_", "pieces_", f"length({t})", offset))}).drop("tokens_", "pieces_", "groups_")


def with_model(df: DataFrame, load: Callable[[], Callable[[list[str]], list[list[dict]]]], text: str = "text", out: str = "model_spans") -> DataFrame:
    """``df`` with the spans of a model in ``out``.

    ``load`` runs once a task and gives a function from texts to their tokens; no more
    than that is left to Python. Where it
    fails on a batch it is asked text by text; a text on which it fails has no spans, so
    that the rules stand alone there, and its error in ``{out}_error`` (null elsewhere).
    """
    failed = f"{out}_error"
    names = [c for c in df.columns if c not in (out, failed)]
    rows = df.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", found_ array<{TOKEN}>, `{failed}` string"
    kinds = pa.list_(pa.struct([("entity", pa.string()), ("word", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            errors: list[str | None] = [None] * len(texts)
            try:
                tokens = model(texts)
            except Exception:  # the texts that did not fail it keep their spans
                tokens = []
                for i, t in enumerate(texts):
                    try:
                        tokens += model([t])
                    except Exception as e:
                        tokens.append([])
                        errors[i] = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens, kinds), pa.array(errors, pa.string())], names=[*names, "found_", failed])

    spans = token_spans(rows.mapInArrow(run, schema), "found_", text, out)
    return spans.select(*[F.col(f"`{c}`") for c in (*names, out, failed)])
