import base64
import gzip
import json
import hashlib
import io
import random
import zlib

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from redactum.llm import bpe_count, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
OURS = bpe_count.Counter(bpe_count.Vocabulary(PATH))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab '\n<|endoftext|>1é", max_size=60))
def test_counts_equal_the_library(text):
    assert OURS.count(text) == len(THEIRS.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 9_000, "<|endoftext|><|endoftext|> x<|endoftext|>", "  \n\n   x  ", "日本語" * 500, "it's we'll I'D"])
def test_long_and_special(text):
    assert OURS.count(text) == len(THEIRS.encode(text, add_special_tokens=False).ids)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: len(THEIRS.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in bpe_count.count_tokens(docs, PATH).collect()} == want


def test_tokens_awkward(awkward, empty):
    got = {r.doc_id: r for r in bpe_count.count_tokens(awkward, PATH).collect()}
    assert got[3].n_tokens == got[4].n_tokens == got[3].n_bytes == 0 and got[6].over_limit and not got[7].over_limit
    assert bpe_count.count_tokens(empty, PATH).count() == 0


def digest(x):
    return base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()


def pages(seed, n=400):
    r = random.Random(seed)
    html = [None, "", "<p>é</p>", "same", "x" * 300_000] + [f"<html>{r.random()}</html>" * r.randint(1, 40) for _ in range(n // 2)]
    return [(i, r.choice(["http://a.b/é x?q=1\r\n", None, "u"]), r.choice(html)) for i in range(n)]


def test_round_trip(spark, tmp_path):
    rows = pages(2)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r for r in warc.archive_pages(df, str(tmp_path), keep_monolithic=True).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(digest(h), i)
    assert len(got) == len(rows)
    for i, _, h in rows:
        g, f = got[i], first[digest(h)]
        assert (g.payload_bytes, g.payload_digest) == (len((h or "").encode()), digest(h))
        assert (g.record_type, g.refers_to) == (("response", None) if f == i else ("revisit", f))
    # every file is a gzip file that any reader inflates whole; the index cuts it into members
    found = list(tmp_path.glob("*.warc.gz"))
    assert found and list(tmp_path.glob("monolithic/*.warc.gz"))
    for f in found:
        data = f.read_bytes()
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") >= 1
        import json

        index = [json.loads(x) for x in f.with_name(f.name.replace(".warc.gz", ".idx")).read_text().splitlines()]
        assert sum(x["length"] for x in index) == len(data) and [x["offset"] for x in index] == [sum(y["length"] for y in index[:k]) for k in range(len(index))]
        assert zlib.decompress(data[: index[0]["length"]], 31).startswith(b"WARC/1.1\r\n")


def test_monolithic_streams_inflate_in_pieces():
    data = b"".join(warc.response(warc.record_name(i, "a", i), "http://x/é", bytes([i]) * 50_000, "D") for i in range(60))
    for raw in (gzip.compress(data), gzip.compress(data[:1000]) + gzip.compress(data[1000:])):
        assert b"".join(warc.inflated(io.BytesIO(raw))) == data
    assert [h.first("warc-record-id") for h, _ in warc.parse_records(iter([data[i : i + 777] for i in range(0, len(data), 777)]))] == [warc.record_name(i, "a", i) for i in range(60)]
    with pytest.raises(ValueError):
        list(warc.parse_records(iter([data[:-9]])))


def test_warc_awkward(spark):
    rows = [(1, "u", "a", 0), (1, "u", "a", 0), (None, None, "a", 0), (None, None, "b", 0), (2, "u", None, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, archive int")
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.archive_pages(df).collect())
    assert got == [(0, 1, "response", 0), (0, 1, "revisit", 1), (1, 1, "response", 0), (1, 1, "revisit", 1), (2, 0, "response", 0)]
    assert warc.archive_pages(df, least=2).where("record_type = 'revisit'").count() == 0
    assert warc.archive_pages(df.limit(0)).count() == 0


def foreign() -> bytes:
    """An archive of another maker: other records, other cases, blanks, folded and repeated headers."""
    def one(head: str, block: bytes) -> bytes:
        return head.replace("\n", "\r\n").encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\ncontent-type:text/html\r\nX-A: 1\r\nX-A: 2\r\n\r\n"
    info = b"software: crawler\r\n\r\nformat: WARC"
    return b"".join([
        one(f"WARC/1.0\nWARC-Type: warcinfo\nWARC-Record-ID: <urn:uuid:1>\nContent-Length: {len(info)}", info),
        one("WARC/1.1\nwarc-type:request\nWARC-RECORD-ID:<urn:uuid:2>\nWARC-Concurrent-To: <a>\nWARC-Concurrent-To: <b>\ncontent-length:4", b"GET\n"),
        one(f"WARC/1.1\nWARC-Type:response\nWARC-Record-ID:  <urn:uuid:3>\nWARC-Target-URI: http://x/\n y\nContent-Type: application/http;msgtype=response\ncontent-length: {len(http) + 5}", http + b"hello"),
        one("WARC/1.1\nWARC-Type: metadata\nContent-Length: 0", b""),
    ])


def test_foreign_archives(spark, tmp_path):
    data = foreign()
    files = {"whole": gzip.compress(data), "members": gzip.compress(data[:300]) + gzip.compress(data[300:]), "cut": gzip.compress(data)[:-30], "trailer": gzip.compress(data)[:-8], "text": gzip.compress(b"no record\r\n\r\n"), "empty": b"", "plain": data}
    for k, v in files.items():
        (tmp_path / f"{k}.warc.gz").write_bytes(v)
    paths = spark.createDataFrame([(f"{tmp_path}/{k}.warc.gz",) for k in [*files, "absent"]] + [(None,)], "path string")
    out = f"file://{tmp_path}/out"
    rows = warc.normalise_files(paths, out).collect()
    got = {None if r.path is None else r.path.rsplit("/", 1)[-1].split(".")[0]: r for r in rows}
    assert {k for k, r in got.items() if r.error} == {"cut", "trailer", "text", "plain", "absent"} and got["empty"].records == 0 and got[None].archive is None
    for k in ("whole", "members"):
        assert got[k].records == 4
        made = (tmp_path / "out" / f"{got[k].archive}.warc.gz").read_bytes()
        index = [json.loads(x) for x in (tmp_path / "out" / f"{got[k].archive}.idx").read_text().splitlines()]
        assert [x["type"] for x in index] == ["warcinfo", "request", "response", "metadata"] and [x["name"] for x in index] == ["<urn:uuid:1>", "<urn:uuid:2>", "<urn:uuid:3>", None]
        assert [x["digest"] for x in index] == [None, None, f"sha1:{digest('hello')}", None]
        parts = [zlib.decompress(made[x["offset"] : x["offset"] + x["length"]], 31) for x in index]
        # Nothing but the writing of headers and the version differs from the source, record by record.
        before, after = list(warc.parse_records(iter([data]))), [next(warc.parse_records(iter([p]))) for p in parts]
        assert [b for _, b in after] == [b for _, b in before]
        assert [sorted(h.without("content-length")) for h, _ in after] == [sorted(h.without("content-length")) for h, _ in before]
        assert after[1][0].without("content-length").count(("WARC-Concurrent-To", "<b>")) == 1 and after[2][0].first("warc-target-uri") == "http://x/ y"
    read = warc.read_archives(spark.createDataFrame([(got["whole"].archive,)], "archive string"), out).collect()
    assert [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read] == [(None, 5, digest("hello"), "response", None)]


def test_a_digest_that_fails_is_an_error_of_its_record(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    one = lambda name, told, body: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {name}\r\nContent-Type: application/http;msgtype=response\r\nWARC-Payload-Digest: sha1:{told}\r\nContent-Length: {len(http) + len(body)}\r\n\r\n".encode() + http + body + b"\r\n\r\n"
    data = one("<urn:page:x:y:1>", digest("good"), b"good") + one("<urn:page:7:y:1>", digest("other"), b"bad") + one("<urn:page:99999999999999999999:y:1>", digest("more"), b"more")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    out = f"file://{tmp_path}/out"
    (made,) = warc.normalise_files(spark.createDataFrame([(f"{tmp_path}/a.warc.gz",)], "path string"), out).collect()
    read = warc.read_archives(spark.createDataFrame([(made.archive,)], "archive string"), out).collect()
    assert [(r.page_id, r.payload_bytes, r.error) for r in read] == [(None, 4, None), (7, 3, "the digest does not hold"), (None, 4, None)]
    assert [warc.page_of(x) for x in ("<urn:page:5:a:1>", "<urn:page:none:a:1>", "<urn:page:-3:a:1>", "<urn:page:x:y:1>", "<urn:page:5:a>", None, "")] == [5, None, -3, None, None, None, None]
