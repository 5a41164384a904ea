"""Secret scans with structural confirmation.

Lexical patterns give the base findings. Candidates in base64 or hexadecimal, wrapped
or on one line, are then decoded and reported only if their structure holds: key files whose nested
DER lengths fill their parents and whose fields are a private key's, OpenSSH containers
whose length fields add up, signed tokens whose header is a JSON object that names an
algorithm and whose claims are one too.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactum.llm.common import in_small_batches

# The patterns of the base findings.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE_KINDS = ("assign", "access", "hex")
#: Kinds that structure confirms, in the order in which they follow the base ones.
MORE_KINDS = ("pem", "openssh", "der_base64", "der_hex", "signed_token", "jwk")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

_HINT = ("pass", "secret", "token", "api")
# Texts in JSON or env files have their line ends escaped, once or more often.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*(?:KEY|CERTIFICATE))-----((?:[A-Za-z0-9+/=\s]|\\+[nr])+?)-----END \1-----")
_ESCAPED = re.compile(r"\\+[nr]")
# Armour with headers of its own, as older tools write it around an encrypted key.
_LINE = r"(?:\r?\n|(?:\\+r)?\\+n)"
_HEADED = re.compile(rf"-----BEGIN ([A-Z0-9 ]*KEY)-----{_LINE}((?:[A-Za-z][A-Za-z0-9-]*:[^\r\n\\]*{_LINE})+){_LINE}?((?:[A-Za-z0-9+/=\s]|\\+[nr])+?)-----END \1-----")
# What may be the base64 of a key, a token or armour, on one line or wrapped; of the other alphabet on one line.
_LONG64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40,}(?:[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*[A-Za-z0-9+/]{4,})*={0,2}")
_LONGURL = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9_-]{40,}={0,2}(?![A-Za-z0-9+/_-])")
_LONGHEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){40,}")
# JSON as the standard library reads it. An item is a value without parts and what follows it, or what has parts.
_JSON_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})[^"\\\x00-\x1f]*+)*+"'
_JSON_SPACE = r"[\x20\t\r\n]*+"
_JSON_VALUE = rf"(?:(?P<plain>{_JSON_STRING}|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null|NaN|-?Infinity){_JSON_SPACE}(?P<then>[,\]}}])|(?P<parts>[\[{{]))"
_JSON_ELEMENT = re.compile(_JSON_SPACE + _JSON_VALUE)
_JSON_MEMBER = re.compile(rf"{_JSON_SPACE}(?P<name>{_JSON_STRING}){_JSON_SPACE}:{_JSON_SPACE}{_JSON_VALUE}")
_JSON_BLANKS = re.compile(_JSON_SPACE)
_JSON_THEN = re.compile(_JSON_SPACE + r"(?P<then>[,\]}])")
_JSON_OPEN = re.compile(r"[\[{]")
# A JSON object, with or without blanks after its brace, starts with ey or ew.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_BREAK = r"[\x20\t]*(?:(?:\r|\\+r)?(?:\n|\\+n))[\x20\t]*"
# A DER sequence (30, then any length) starts with M and a letter from A to P, the OpenSSH magic with b3Bl...
_START64 = re.compile(r"(?:M[A-P]|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9+/]{14,}")
_STARTHEX = re.compile(r"(?:30|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]763100)[0-9A-Fa-f]{14,}")
_NEXT64 = re.compile(_BREAK + r"([A-Za-z0-9+/]+)")
_NEXTHEX = re.compile(_BREAK + r"([0-9A-Fa-f]+)")
_BEFORE64 = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
_BEFOREHEX = frozenset("0123456789abcdefABCDEF")
_ESCAPE_END = re.compile(r"\\[nrt]")
_SSH_MAGIC = b"openssh-key-v1\x00"


def der_items(data: bytes, start: int, end: int) -> Iterator[tuple[int, int, int]] | None:
    """(tag, start, end) of the items that fill data[start:end] exactly, or None."""
    out = []
    while start < end:
        if end - start < 2:
            return None
        tag, n, at = data[start], data[start + 1], start + 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            n, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        start = at + n
    return out


def _filled(data: bytes, todo: list[tuple[int, int, int]]) -> bool:
    """Whether the sequences and sets among the items, and all inside of them, are filled exactly."""
    todo = list(todo)
    while todo:
        tag, a, b = todo.pop()
        if tag & 0x20:
            items = der_items(data, a, b)
            if items is None:
                return False
            todo += items
        elif tag == 0x02 and a == b:
            return False
    return True


def is_der_key(data: bytes) -> bool:
    """Whether ``data`` is a private key: its lengths fill their parents and its fields are those of

    PKCS#8 (version 0 or 1, algorithm, octets), the same encrypted (algorithm, octets),
    PKCS#1 (version and eight integers, more in a third form), DSA (version 0 and five)
    or SEC 1 (version 1 and octets, then tagged fields only). Public keys and
    certificates are none.
    """
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30 or len(data) < 32:
        return False
    fields = der_items(data, top[0][1], top[0][2]) or []
    tags = bytes(t for t, _, _ in fields)
    version = int.from_bytes(data[fields[0][1] : fields[0][2]], "big") if tags[:1] == b"\x02" else -1

    def algorithm(k: int) -> bool:
        items = der_items(data, fields[k][1], fields[k][2]) or []
        return bool(items) and items[0][0] == 0x06 and items[0][2] > items[0][1]

    if tags[:3] == b"\x02\x30\x04" and version in (0, 1):
        known = algorithm(1) and set(tags[3:]) <= {0xA0, 0x80, 0xA1, 0x81}
    elif tags == b"\x30\x04":
        known = algorithm(0)
    elif tags[:2] == b"\x02\x04" and version == 1:
        known = fields[1][2] - fields[1][1] >= 14 and set(tags[2:]) <= {0xA0, 0xA1}
    else:
        known = (tags == b"\x02" * 9 and version == 0) or (tags == b"\x02" * 9 + b"\x30" and version == 1) or (tags == b"\x02" * 6 and version == 0)
    return known and _filled(data, top)


def is_openssh(data: bytes) -> bool:
    """Cipher, KDF, options, key count and that many public keys, each with its length."""
    if not data.startswith(_SSH_MAGIC):
        return False
    at = len(_SSH_MAGIC)

    def field(at: int) -> int:
        if at + 4 > len(data):
            return -1
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return end if end <= len(data) else -1

    for _ in range(3):
        at = field(at)
        if at < 0:
            return False
    if at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if keys < 1:
        return False
    for _ in range(keys + 1):
        at = field(at)
        if at < 0:
            return False
    return True


def _b64(s: str, url: bool = False) -> bytes | None:
    s = "".join(s.split()).rstrip("=")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    data = _b64(part, url=True)
    try:
        # Integers of any length: their values do not count.
        found = json.loads(data, parse_int=float) if data else None
    except RecursionError:
        return _deep_object(data.decode(json.detect_encoding(data), "surrogatepass"))
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _deep_object(text: str) -> dict | None:
    """The fields of a text that is one JSON object, nested to any depth."""
    ends, first = {}, _JSON_BLANKS.match(text).end()
    for at, items in _json_objects(text, ends):
        if at == first and _JSON_BLANKS.match(text, ends[at]).end() == len(text):
            return _json_fields(text, items, ends)
    return None


def is_signed_token(header: str, body: str, signature: str = "c2ln") -> bool:
    """A header that names an algorithm, claims that are a JSON object (unless the header
    gives another type or an encryption) and a signature (unless the algorithm is none)."""
    found = _object(header)
    if found is None or not isinstance(found.get("alg"), str) or _b64(body, url=True) is None:
        return False
    claims = "enc" in found or str(found.get("typ", "JWT")).upper() != "JWT" or _object(body) is not None
    return claims and (found["alg"].lower() == "none" or bool(_b64(signature, url=True)))


class _Run:
    """A run of base64 or hexadecimal over wrapped lines, read by byte offsets from any of its lines."""

    def __init__(self, text: str, start: int, end: int, following: re.Pattern, is_hex: bool):
        self.is_hex, self.starts = is_hex, {start: 0}
        parts, self.ends, held = [text[start:end]], {end - start: end}, end - start
        while m := following.match(text, end):
            self.starts[m.start(1)] = held
            parts.append(m[1])
            end, held = m.end(), held + len(m[1])
            self.ends[held] = end
        self.chars = "".join(parts)

    def bytes(self, at: int, a: int, b: int) -> bytes:
        """Bytes a to b of what starts at the character ``at``; fewer if the run ends before."""
        if self.is_hex:
            s = self.chars[at + 2 * a : at + 2 * b]
            return bytes.fromhex(s[: len(s) // 2 * 2])
        s = self.chars[at + a // 3 * 4 : at + -(-b // 3) * 4]
        s = s[:-1] if len(s) % 4 == 1 else s
        return base64.b64decode(s + "=" * (-len(s) % 4))[a % 3 : a % 3 + b - a]

    def place(self, at: int, size: int) -> int | None:
        """Where ``size`` bytes from the character ``at`` end in the text, if a line ends there."""
        return self.ends.get(at + (2 * size if self.is_hex else -(-size * 4 // 3)))


def _der_size(head: bytes) -> int:
    """Bytes of the sequence that starts so; 0 if none does."""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    if not head[1] & 0x80:
        return 2 + head[1]
    width = head[1] & 0x7F
    return 2 + width + int.from_bytes(head[2 : 2 + width], "big") if 1 <= width <= 4 else 0


def _openssh_size(run: _Run, at: int) -> int:
    """Bytes of the OpenSSH container that starts at the character ``at``; 0 if its fields do not add up."""
    n = len(_SSH_MAGIC)
    if run.bytes(at, 0, n) != _SSH_MAGIC:
        return 0

    def number(a: int) -> int:
        x = run.bytes(at, a, a + 4)
        return int.from_bytes(x, "big") if len(x) == 4 else -1

    fields, keys = 3, 0
    while fields:
        size = number(n)
        if size < 0:
            return 0
        n, fields = n + 4 + size, fields - 1
        if not fields and not keys:
            keys = number(n)
            if keys < 1:
                return 0
            n, fields = n + 4, keys + 1
    return n


def bare_spans(text: str, is_hex: bool) -> list[tuple[str, int, int]]:
    """(kind, start, end) of keys without armour, wrapped or on one line.

    The lengths in the data say where a key ends; a line has to end there.
    """
    first, following, before = (_STARTHEX, _NEXTHEX, _BEFOREHEX) if is_hex else (_START64, _NEXT64, _BEFORE64)
    out, run, done = [], None, 0
    for m in first.finditer(text):
        s = m.start()
        if s < done or (s and text[s - 1] in before and not _ESCAPE_END.match(text, s - 2)):
            continue
        if run is None or s not in run.starts:
            run = _Run(text, s, m.end(), following, is_hex)
        at, kind = run.starts[s], "der_hex" if is_hex else "der_base64"
        size = _der_size(run.bytes(at, 0, 6))
        end = run.place(at, size) if size else None
        if end is not None and not is_der_key(run.bytes(at, 0, size)):
            end = None
        if end is None and (size := _openssh_size(run, at)):
            end, kind = run.place(at, size), "openssh"
        if end is not None:
            while not is_hex and text[end : end + 1] == "=" and end - run.place(at, size) < 2:
                end += 1
            out.append((kind, s, end))
            done = end
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base findings; offsets are code points."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINT):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # Runs of 32 or more; a shorter run has no part that long, so none is lost.
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _headed(headers: str, body: bytes) -> bool:
    """A key that its headers say is encrypted, in whole blocks of the cipher, or one that is none."""
    told = dict(re.findall(r"([A-Za-z][A-Za-z0-9-]*):[\x20\t]*([^\r\n\\]*)", headers))
    if "ENCRYPTED" not in told.get("Proc-Type", ""):
        return is_der_key(body)
    cipher, _, start = told.get("DEK-Info", "").partition(",")
    block = 8 if "DES" in cipher else 16
    return bool(cipher) and re.fullmatch(rf"[0-9A-Fa-f]{{{2 * block}}}", start.strip()) is not None and len(body) >= 32 and len(body) % block == 0


_PRIVATE = {"RSA": ("n", "e", "d"), "EC": ("crv", "x", "d"), "OKP": ("crv", "x", "d"), "oct": ("k",)}


def _is_jwk(found: dict) -> bool:
    """A JSON Web Key with its private part, of 16 bytes or more."""
    fields = _PRIVATE.get(found.get("kty")) if isinstance(found.get("kty"), str) else None
    if not fields or not all(isinstance(found.get(f), str) for f in fields):
        return False
    return all(f == "crv" or _b64(found[f], url=True) is not None for f in fields) and len(_b64(found[fields[-1]], url=True) or b"") >= 16


def _is_json_token(found: dict) -> bool:
    """A signed token in JSON: a payload, and a protected header with a signature or several of them."""
    signed = found.get("signatures") if isinstance(found.get("signatures"), list) else [found]
    ok = lambda x: isinstance(x, dict) and all(isinstance(v, str) for v in (found.get("payload"), x.get("protected"), x.get("signature")))
    return bool(signed) and all(ok(x) and is_signed_token(x["protected"], found["payload"], x["signature"]) for x in signed)


def _json_items(text: str, at: int, ends: dict[int, int]) -> tuple[int, list[tuple[str, int, int]]] | None:
    """End of the object or array at ``at`` and (name, start, end) of its items, names as written, or None.

    ``ends`` has the ends of the objects and arrays behind ``at``.
    """
    named, items = text[at] == "{", []
    item, close = (_JSON_MEMBER, "}") if named else (_JSON_ELEMENT, "]")
    if (m := _JSON_THEN.match(text, at + 1)) and m["then"] == close:
        return m.end(), items
    at += 1
    while m := item.match(text, at):
        name, (start, end), then = m["name"] if named else "", m.span("plain"), m
        if m["parts"]:
            start = m.start("parts")
            end = ends.get(start)
            then = None if end is None else _JSON_THEN.match(text, end)
            if not then:
                return None
        items.append((name, start, end))
        if then["then"] != ",":
            return (then.end(), items) if then["then"] == close else None
        at = then.end()
    return None


def _json_objects(text: str, ends: dict[int, int]) -> Iterator[tuple[int, list[tuple[str, int, int]]]]:
    """(start, items) of every JSON object in a text, the last one first; ``ends`` gets the ends of objects and arrays.

    Each brace and bracket is tried once. What lies inside has been read by then and is
    stepped over or ends the try, so that the work grows with the text, however deep or far.
    """
    for at in reversed([m.start() for m in _JSON_OPEN.finditer(text)]):
        if read := _json_items(text, at, ends):
            ends[at] = read[0]
            if text[at] == "{":
                yield at, read[1]


def _json_fields(text: str, items: list[tuple[str, int, int]], ends: dict[int, int], listed: bool = True) -> dict:
    """The strings among an object's items by name, and (``listed``) what its ``signatures`` list; None for other values."""
    places = {json.loads(name) if "\\" in name else name[1:-1]: (a, b) for name, a, b in items}
    found = {}
    for name, (a, b) in places.items():
        found[name] = json.loads(text[a:b]) if text[a] == '"' else None
        if listed and name == "signatures" and text[a] == "[":
            found[name] = [_json_fields(text, _json_items(text, x, ends)[1], ends, False) if text[x] == "{" else None for _, x, _ in _json_items(text, a, ends)[1]]
    return found


def _json_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of JSON objects that are private keys or signed tokens.

    Every object is read; one inside of another that is one is part of it.
    """
    ends, found, out, done = {}, [], [], 0
    for at, items in _json_objects(text, ends):
        if any(name in ('"kty"', '"payload"') or "\\" in name for name, _, _ in items):
            fields = _json_fields(text, items, ends)
            kind = "jwk" if _is_jwk(fields) else "signed_token" if _is_json_token(fields) else None
            if kind:
                found.append((kind, at, ends[at]))
    for x in reversed(found):
        if x[2] > done:
            out.append(x)
            done = x[2]
    return out


def _inner(data: bytes, is_hex: bool) -> str | None:
    """What decoded bytes are: a key, or a text that is armour or a token throughout."""
    if is_der_key(data):
        return "der_hex" if is_hex else "der_base64"
    if is_openssh(data):
        return "openssh"
    if data.isascii() and (b"-----BEGIN " in data or data.count(b".") == 2 or b'"kty"' in data or b'"payload"' in data):
        found = confirmed_spans(data.decode("utf-8", "replace"), nested=False)
        return found[0][0] if found else None
    return None


def _wrapped(m: re.Match) -> Iterator[list[tuple[int, int]]]:
    """Of each stretch of lines of one length what may be one text: with the shorter line
    that follows, which may be its end or something else, and without it; or a line alone."""
    lines = [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"[A-Za-z0-9+/_-]+=*", _ESCAPED.sub(lambda e: "\n" * len(e[0]), m[0]))]
    i = 0
    while i < len(lines):
        width, j = lines[i][1] - lines[i][0], i
        while j < len(lines) and lines[j][1] - lines[j][0] == width:
            j += 1
        more = [(lines[i][0], lines[j][1])] if j < len(lines) and lines[j][1] - lines[j][0] < width else []
        yield [*more, (lines[i][0], lines[j - 1][1])]
        if j - i > 1:
            yield from ([x] for x in lines[i:j])
        i = j


def nested_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of long runs of base64 or hexadecimal that decode to a key, to armour or to a token.

    Every run is decoded, and the parsers decide.
    """
    out = []
    for is_hex, pattern in ((False, _LONG64), (False, _LONGURL), (True, _LONGHEX)):
        for m in pattern.finditer(text):
            if pattern is _LONGURL and not any(c in m[0] for c in "-_"):
                continue
            for tries in [[(m.start(), m.end())]] if is_hex else _wrapped(m):
                for a, b in tries:
                    run = _ESCAPED.sub("", text[a:b])
                    data = bytes.fromhex(run) if is_hex else _b64(run.replace("-", "+").replace("_", "/"))
                    if data and (kind := _inner(data, is_hex)):
                        out.append((kind, a, b))
                        break
    return out


def confirmed_spans(text: str, nested: bool = True) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what decoding and parsing confirms; ``nested``: also inside of what is encoded once more."""
    out = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = _b64(_ESCAPED.sub("", m[2]))
            if data and is_openssh(data):
                out.append(("openssh", m.start(), m.end()))
            elif data and is_der_key(data):
                out.append(("pem", m.start(), m.end()))
        for m in _HEADED.finditer(text):
            if (data := _b64(_ESCAPED.sub("", m[3]))) and _headed(m[2], data):
                out.append(("pem", m.start(), m.end()))
    out += [("signed_token", m.start(), m.end()) for m in _TOKEN.finditer(text) if is_signed_token(m[1], m[2], m[3])]
    if '"kty"' in text or '"payload"' in text:
        out += _json_spans(text)
    armoured = [x for x in out if x[0] in ("pem", "openssh", "jwk", "signed_token")]
    bare = bare_spans(text, False) + bare_spans(text, True)
    out += [x for x in bare if not any(a <= x[1] and x[2] <= b for _, a, b in armoured)]
    if nested:
        # A run that is, holds or lies in what was found is no other finding.
        for x in nested_spans(text):
            if not any(x[1] < b and a < x[2] for _, a, b in out):
                out.append(x)
    return out


_ORDER = {k: i for i, k in enumerate((*BASE_KINDS, *MORE_KINDS))}


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], _ORDER[x[0]], x[2])))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256, spans and redacted.

    Offsets are code points, ends exclusive. Null and empty texts have no finding
    and a redacted text of null or "". Texts are read whole and each row on its own.
    ``redacted`` has ``[kind]`` in place of every finding, overlaps as one. Columns
    of ``docs`` with these names are replaced.
    """
    return _scan(docs, text, True)


def scan_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """``scan`` without the texts."""
    return _scan(docs, text, False)


def _scan(docs: DataFrame, text: str, with_texts: bool) -> DataFrame:
    added = {"n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"} | ({"redacted": "string"} if with_texts else {})
    names = [c for c in docs.columns if c not in added]
    kept = names if with_texts else [c for c in names if c != text]
    ask = [F.col(f"`{c}`") for c in [*(c for c in kept if c != text), text]]
    cur = docs.select(*ask)
    out_names = [c for c in kept if c != text] + ([text] if with_texts else [])
    fields = {f.name: f for f in cur.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c].dataType.simpleString()}" for c in out_names), *(f"{n} {t}" for n, t in added.items())])
    width = len(out_names)

    def run(batches):
        for b in in_small_batches(batches, 500):
            counts, digest, spans, redacted = {k: [] for k in BASE_KINDS}, [], [], []
            for t in b.column(b.num_columns - 1):
                whole = t.as_py()
                base = base_spans(whole or "")
                found = base + confirmed_spans(whole or "")
                for k in BASE_KINDS:
                    counts[k].append(sum(x[0] == k for x in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
                if with_texts:
                    redacted.append(blank_out(whole, found))
            arrays = [pa.array(counts[k], pa.int64()) for k in BASE_KINDS] + [pa.array(digest), pa.array(spans)] + ([pa.array(redacted, pa.string())] if with_texts else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *arrays], names=[*out_names, *added])

    return cur.mapInArrow(run, schema)


def blank_out(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if not spans or text is None:
        return text
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
