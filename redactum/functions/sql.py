"""Small builders of SQL text: expressions are composed as text and parsed once by Spark."""

from __future__ import annotations

#: What a JavaScript \\s matches, inside a character class (a fixed value of that dialect).
BLANKS = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
#: An ASCII word boundary, whatever letters stand beside it.
BOUNDARY = "(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))"
#: The same where an ASCII word character is sure to follow.
BEFORE_WORD = "(?<!\\w)"


def lit(s: str | None) -> str:
    """A SQL string literal."""
    if s is None:
        return "CAST(NULL AS STRING)"
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def to_java(pattern: str, flags: str = "") -> str:
    """A pattern of the JavaScript dialect as a Java one with the same matches.

    ``\\s`` takes the wider set of blanks, ``\\b`` looks at ASCII word characters only;
    where a pattern or a branch of one starts with it, an ASCII word character has to
    follow, unless ``u`` is set. ``i`` folds ASCII letters, ``iu`` all letters.
    """
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            n = pattern[i + 1]
            if n == "s":
                out.append(BLANKS if inside else f"[{BLANKS}]")
            elif n == "S" and not inside:
                out.append(f"[^{BLANKS}]")
            elif n == "b" and not inside:
                starts = "u" not in flags and (i == 0 or pattern[i - 1] == "|")
                out.append(BEFORE_WORD if starts else BOUNDARY)
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[" and inside:
            out.append("\\[")
        else:
            inside = c == "[" or (inside and c != "]")
            out.append(c)
        i += 1
    head = "(?iu)" if "i" in flags and "u" in flags else "(?i)" if "i" in flags else ""
    return head + "".join(out)


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^[{BLANKS}]+|[{BLANKS}]+' + chr(92) + 'z')}, '')"


def flexible(x: str) -> str:
    """SQL for a regular expression that matches ``x`` literally, trimmed, with any blanks for blanks."""
    escaped = f"regexp_replace({js_trim(x)}, {lit('([.*+?^${}()|\\[\\]\\\\])')}, {lit('\\\\$1')})"
    return f"regexp_replace({escaped}, {lit(f'[{BLANKS}]+')}, {lit('[' + BLANKS.replace(chr(92), chr(92) * 2) + ']+')})"


def as_replacement(x: str) -> str:
    """SQL for ``x`` as a replacement without group references."""
    return f"regexp_replace({x}, {lit('([$\\\\])')}, {lit('\\\\$1')})"


#: Code points in a piece of a text that is cut at many places.
PIECE = 1024


def let(x: str, name: str, body: str) -> str:
    """``body`` with ``x`` computed once as ``name``."""
    return f"element_at(transform(array({x}), {name} -> {body}), 1)"


def running(x: str, op: str) -> str:
    """The running result of ``op`` (an expression of p and q) over an array of numbers.

    Every round combines each item with the one 1, 2, 4, ... places before, so that the
    cost is n log n; a fold would copy what it has built at every step.
    """
    return f"aggregate(sequence(0, CAST(ceil(log2(greatest(size({x}), 2))) AS INT) - 1), {x}, (acc_, k_) -> transform(acc_, (p, i_) -> IF(i_ >= shiftleft(1, k_), {let('acc_[i_ - shiftleft(1, k_)]', 'q', op)}, p)))"


def pieces(text: str) -> str:
    """A text in pieces of ``PIECE`` code points; a position is found without walking from the start."""
    return f"regexp_extract_all({text}, {lit('(?s).{1,' + str(PIECE) + '}')}, 0)"


def cut(parts: str, start: str, end: str) -> str:
    """The code points from ``start`` to before ``end`` (from 0) of a text in pieces."""
    first, last = f"({start}) DIV {PIECE}", f"(({end}) - 1) DIV {PIECE}"
    far = f"concat(substring({parts}[CAST({first} AS INT)], ({start}) % {PIECE} + 1), array_join(slice({parts}, CAST({first} AS INT) + 2, CAST({last} - {first} AS INT) - 1), ''), substring({parts}[CAST({last} AS INT)], 1, (({end}) - 1) % {PIECE} + 1))"
    return f"CASE WHEN ({end}) <= ({start}) THEN '' WHEN {first} = {last} THEN substring({parts}[CAST({first} AS INT)], ({start}) % {PIECE} + 1, ({end}) - ({start})) ELSE {far} END"


def first_word(x: str) -> str:
    """The first run of ASCII word characters; empty if there is none."""
    return f"regexp_extract({x}, {lit('[A-Za-z0-9_]+')}, 0)"


def words_in_common(text: str, words: str) -> str:
    """Those of ``words`` that stand in ``text`` as whole runs of ASCII word characters."""
    return f"array_intersect(regexp_extract_all({text}, {lit('[A-Za-z0-9_]+')}, 0), {words})"
