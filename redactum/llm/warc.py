"""WARC archives, and the normaliser of archives that are one gzip stream.

Pages are first written as monolithic archives: one gzip stream a file. The
normaliser inflates each stream once, rewrites every record as a gzip member of its
own and writes a sidecar index of offsets; a record whose payload another one has
becomes a revisit on the way. Payloads are never shuffled: only ids and digests are
compared, and each archive meets its few decisions where it is rewritten. Archives of
other makers, with records of any type, are normalised by the same code.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactum.llm.common import Workspace, delete

#: An archive ends at so many records or payload bytes: bounds what one task rewrites.
ARCHIVE_RECORDS = 5_000
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
#: Payloads of fewer bytes never become revisits.
LEAST_BYTES = 0
_CHUNK = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None, archive: str, seq: int) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{archive}:{seq}>"


def page_of(name: str | None) -> int | None:
    """The page in a record's name; null if it has none or the name is not one of ours."""
    parts = (name or "").strip("<>").split(":")
    ours = parts[:2] == ["urn", "page"] and len(parts) == 5 and re.fullmatch(r"-?[0-9]{1,19}", parts[2])
    page = int(parts[2]) if ours else 0
    return page if ours and -(1 << 63) <= page < 1 << 63 else None


class Headers(list):
    """(name, value) pairs in their order; names are looked up without regard to case, the first one counts."""

    def first(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self if k.lower() == name.lower()), default)

    def without(self, *names: str) -> list[tuple[str, str]]:
        return [(k, v) for k, v in self if k.lower() not in names]

    @classmethod
    def of(cls, lines: list[str]) -> Headers:
        """From ``name:value`` lines, with or without blanks; a line that starts with a blank goes on with the one before."""
        out = cls()
        for x in lines:
            if x[:1] in (" ", "\t") and out:
                out[-1] = (out[-1][0], f"{out[-1][1]} {x.strip()}")
            elif x:
                k, colon, v = x.partition(":")
                if not colon:
                    raise ValueError(f"a header line without a colon: {x[:80]!r}")
                out.append((k.strip(), v.strip()))
        return out


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def response(name: str, url: str | None, payload: bytes, digest: str) -> bytes:
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ], http_head(len(payload)) + payload)


class Gzip:
    """A gzip stream that remembers nothing but its compressor."""

    def __init__(self, level: int):
        self.z = zlib.compressobj(level, zlib.DEFLATED, 31)

    def whole(self, data: bytes) -> bytes:
        return self.z.compress(data) + self.z.flush()


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[Headers, bytes]]:
    """(headers, block) of each record in a stream of inflated bytes; holds one record at a time.

    A stream that ends inside a record, and bytes that are no record, are a ValueError.
    """
    held = bytearray()

    def more() -> bool:
        for c in chunks:
            held.extend(c)
            return True
        return False

    while True:
        seen = 0
        while (at := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                break
        if at < 0:
            if held.strip():
                raise ValueError("the archive ends inside a record")
            return
        lines = bytes(held[:at]).decode("utf-8", "surrogateescape").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = Headers.of(lines[1:])
        size = headers.first("Content-Length")
        if size is None or not size.isdigit():
            raise ValueError("a WARC record without a length")
        need = at + 4 + int(size)
        while len(held) < need + 4:
            if not more():
                break
        if len(held) < need or not b"\r\n\r\n".startswith(bytes(held[need : need + 4])):
            raise ValueError("the archive ends inside a record, or a record's length is wrong")
        block = bytes(held[at + 4 : need])
        del held[: need + 4]
        yield headers, block


def inflated(file) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in chunks; a ValueError if a member does not end."""
    z, begun = zlib.decompressobj(31), False
    while data := file.read(_CHUNK):
        while data:
            if not begun and not (data := data.lstrip(b"\0")):  # padding after a member
                break
            begun = True
            out = z.decompress(data, _CHUNK)
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, begun = z.unused_data, False
                z = zlib.decompressobj(31)
    while begun and (out := z.decompress(z.unconsumed_tail, _CHUNK)):
        yield out
    if begun and not z.eof:
        raise ValueError("the gzip stream ends before its trailer")


def payload_of(headers: Headers, block: bytes) -> bytes:
    """What follows the HTTP head of a record that has one, else the whole block."""
    at = block.find(b"\r\n\r\n")
    http = (headers.first("Content-Type") or "").lower().startswith("application/http")
    return block[at + 4 :] if http and at >= 0 else block


def _open(path: str):
    where, inner = fs.FileSystem.from_uri(path)
    return where, inner


def write_monolithic(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", level: int = LEVEL, records: int = ARCHIVE_RECORDS, size: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of one gzip stream each; (archive, seq, page_id, digest, bytes) for each record.

    A null payload is empty, a null url ``about:blank``. Names hold a random part, so
    a task that runs again leaves the files of its lost attempt unnamed, never mixed.
    """
    cur = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))

    def run(batches):
        where, inner = _open(f"{folder}/monolithic")
        where.create_dir(inner, recursive=True)
        out, z, name, n, held = None, None, "", 0, 0
        for b in batches:
            rows = ([], [], [], [], [])
            for i in range(b.num_rows):
                if out is None:
                    name, n, held = uuid.uuid4().hex[:16], 0, 0
                    out, z = where.open_output_stream(f"{inner}/{name}.warc.gz", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                page, link, text = (b.column(c)[i].as_py() for c in range(3))
                payload = (text or "").encode()
                digest = digest_of(payload)
                out.write(z.compress(response(record_name(page, name, n), link, payload, digest)))
                for x, v in zip(rows, (name, n, page, digest, len(payload)), strict=True):
                    x.append(v)
                n, held = n + 1, held + len(payload)
                if n >= records or held >= size:
                    out.write(z.flush())
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["archive", "seq", "page_id", "digest", "bytes"])
        if out is not None:
            out.write(z.flush())
            out.close()

    return cur.mapInArrow(run, "archive string, seq int, page_id bigint, digest string, bytes bigint")


def revisit_plan(written: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(archive, seqs, refs): per archive the records that become revisits and the names they refer to.

    Of records with equal payloads of at least ``least`` bytes, the first by page_id
    (nulls last), archive and place stays a response. Lists are as long as an archive at most.
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"), F.col("archive"), F.col("seq"))
    same = written.where(F.col("bytes") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    again = written.where(F.col("bytes") >= least).join(same, "digest").where((F.col("archive") != F.col("first.archive")) | (F.col("seq") != F.col("first.seq")))
    ref = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first.page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("first.archive"), F.lit(":"), F.col("first.seq").cast("string"), F.lit(">"))
    rows = again.select("archive", F.struct("seq", ref.alias("ref")).alias("x")).unionByName(written.where("seq = 0").select("archive", F.lit(None).cast("struct<seq:int,ref:string>").alias("x")))
    return rows.groupBy("archive").agg(F.collect_list("x").alias("x")).select("archive", F.col("x.seq").alias("seqs"), F.col("x.ref").alias("refs"))


def _rewrite(where, source: str, base: str, again: dict[int, str], level: int) -> int:
    """Inflates ``source`` once and writes ``base``.warc.gz, a member per record, and ``base``.idx; the number of records."""
    offset, lines = 0, []
    with where.open_input_stream(source, compression=None) as file, where.open_output_stream(f"{base}.warc.gz", compression=None) as out:
        for seq, (headers, block) in enumerate(parse_records(inflated(file))):
            data, kind = rewritten(headers, block, again.get(seq))
            member = Gzip(level).whole(data)
            out.write(member)
            digest = headers.first("WARC-Payload-Digest") or (f"sha1:{digest_of(payload_of(headers, block))}" if kind in ("response", "resource") else None)
            lines.append({"offset": offset, "length": len(member), "name": headers.first("WARC-Record-ID"), "type": kind, "digest": digest})
            offset += len(member)
    with where.open_output_stream(f"{base}.idx") as out:
        out.write("".join(json.dumps(x) + "\n" for x in lines).encode("utf-8", "surrogateescape"))
    return len(lines)


def normalise(plan: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrites each monolithic archive record by record; (archive, records) for each.

    ``<archive>.warc.gz`` has a member per record and ``<archive>.idx`` a JSON line
    per record: offset, length, name, type, digest. Names hold a random part: files that
    the result does not name come from lost attempts and do not count.
    """

    def run(batches):
        where, inner = _open(folder)
        for b in batches:
            names, counts = [], []
            for archive, seqs, refs in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                names.append(f"{archive}.{uuid.uuid4().hex[:8]}")
                counts.append(_rewrite(where, f"{inner}/monolithic/{archive}.warc.gz", f"{inner}/{names[-1]}", dict(zip(seqs, refs, strict=True)), level))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["archive", "records"])

    return plan.mapInArrow(run, "archive string, records bigint")


def normalise_files(paths: DataFrame, folder: str, path: str = "path", level: int = LEVEL) -> DataFrame:
    """Normalises archives of any maker; (path, archive, records, error) for each row of ``paths``.

    Records of every type are kept with their headers as they are. A file that ends too
    early, or holds what is no record, is an ``error`` of its own and stops no other; a
    null path gives a row without archive and error. ``folder`` and the files are on
    one file system that the executors reach.
    """

    def run(batches):
        where, inner = _open(folder)
        where.create_dir(inner, recursive=True)
        for b in batches:
            rows = ([], [], [], [])
            for p in b.column(0).to_pylist():
                name = count = error = None
                if p is not None:
                    name = f"{posixpath.basename(p).removesuffix('.gz').removesuffix('.warc')}.{uuid.uuid4().hex[:8]}"
                    try:
                        count = _rewrite(where, _open(p)[1] if "://" in p else p, f"{inner}/{name}", {}, level)
                    except (ValueError, zlib.error, OSError) as e:
                        name, error = None, str(e)
                for col, v in zip(rows, (p, name, count, error), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "archive", "records", "error"])

    return paths.select(F.col(f"`{path}`").alias("path")).mapInArrow(run, "path string, archive string, records bigint, error string")


def rewritten(headers: Headers, block: bytes, refers_to: str | None) -> tuple[bytes, str]:
    kept = headers.without("content-length")
    if refers_to is None:
        return record(kept, block), headers.first("WARC-Type", "")
    kept = [("WARC-Type", "revisit"), *headers.without("content-length", "warc-type"), ("WARC-Refers-To", refers_to), ("WARC-Profile", _PROFILE)]
    return record(kept, block[: block.index(b"\r\n\r\n") + 4]), "revisit"


def _read_back(member: bytes, told: str | None) -> tuple | None:
    """The fields of one record; None for a type that has no payload of a page."""
    headers, block = next(parse_records(iter([zlib.decompress(member, 31)])))
    kind = headers.first("WARC-Type")
    if kind not in ("response", "revisit"):
        return None
    at = block.find(b"\r\n\r\n")
    http = Headers.of(block[: max(at, 0)].decode("utf-8", "surrogateescape").split("\r\n")[1:])
    length = http.first("Content-Length")
    payload = payload_of(headers, block)
    digest = (told or "").removeprefix("sha1:") or None
    plain = (told or "").startswith("sha1:") and not http.first("Transfer-Encoding")
    size = len(payload) if kind == "response" else int(length) if length and length.isdigit() else None
    error = "the digest does not hold" if kind == "response" and plain and digest_of(payload) != digest else None
    return page_of(headers.first("WARC-Record-ID")), size, digest, kind, page_of(headers.first("WARC-Refers-To")), error


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Reads the records back through the index, one member at a time, and checks every
    SHA-1 digest of a payload that stands as it is.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, error for
    responses and revisits; records of other types have no payload of a page. page_id and
    refers_to are null where a name is not one of ours, payload_bytes where a revisit tells
    no length. A digest that does not hold, and a member that cannot be read, are an
    ``error`` of that record alone.
    """

    def run(batches):
        where, inner = _open(folder)
        for b in batches:
            for archive in b.column(0).to_pylist():
                with where.open_input_stream(f"{inner}/{archive}.idx") as f:
                    index = [json.loads(x) for x in f.read().decode().splitlines()]
                rows = ([], [], [], [], [], [])
                with where.open_input_file(f"{inner}/{archive}.warc.gz") as file:
                    for x in index:
                        file.seek(x["offset"])
                        try:
                            found = _read_back(file.read(x["length"]), x["digest"])
                        except (ValueError, zlib.error, StopIteration) as e:
                            found = (None, None, None, None, None, f"{archive} at {x['offset']}: {e}")
                        for col, v in zip(rows, found or (), strict=False):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"])

    return archives.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, error string")


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES, level: int = LEVEL, keep_monolithic: bool = False, **columns) -> DataFrame:
    """Writes ``pages`` as archives, normalises them and reads them back: a row per page.

    ``folder`` (default: a new one in the shared folder) gets the archives and their
    indexes, and ``manifest``, a table of the archives that count. Repeated rows become revisits of the first; rows with a null page_id
    come last among equals, and a revisit of such a row refers to null. An empty
    table gives no archive. Extra columns are not read.
    """
    spark = pages.sparkSession
    space = Workspace(spark, "warc")
    folder = folder or space.folder("archives")
    if folder.startswith("/"):
        folder = f"file://{folder}"
    written = space.write(write_monolithic(pages, folder, level=level, **columns), "written")
    plan = space.write(revisit_plan(written, least), "plan")
    archives = max(1, plan.count())
    parts = min(archives, spark.sparkContext.defaultParallelism * 100)
    done = space.write(normalise(plan.repartition(parts), folder, level), "normalised")
    done.write.mode("overwrite").parquet(f"{folder}/manifest")
    if not keep_monolithic:
        delete(spark, f"{folder}/monolithic")
    # What was written here reads back as it was, or the run fails.
    back = read_archives(done.repartition(parts), folder)
    return back.withColumn("page_id", F.expr("IF(error IS NULL, page_id, raise_error(error))")).drop("error")
