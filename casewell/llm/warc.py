"""WARC archives, written from and read into a table of payload chunks.

A payload is rows of (record, chunk number) with at most `chunk_bytes` bytes each. Every row
carries the bytes and the SHA-1 digest of the payload up to its end, so the last one has the
whole payload's, and a payload of any size is shuffled, written, read and checked chunk by chunk.
Archives are gzipped record by record and hold standard `response` and `revisit` records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell.llm.common import slim
from casewell.session import stage, staging_root

CHUNK_BYTES = 256 << 10
ARCHIVE_BYTES = 1 << 30
LEAST_BYTES = 1000
LEVEL = 4
# Fixed values of the format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
KEY, REFERS = "X-Record-Key", "X-Refers-To-Key"
_HEAD = -1
_BATCH_BYTES = 4 << 20
_HEADER_BYTES = 1 << 20


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, repr(parts))}>"


class _Rows:
    """Rows gathered into Arrow batches of a few megabytes."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size + 200
        if self.bytes >= _BATCH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
            self.rows, self.bytes = [], 0


def payload_chunks(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """Chunk rows of every row's payload: record, key, url, chunk, n_bytes and sha1 (both up to
    the chunk's end), last, and with `data` its bytes. A null or empty payload is one chunk of
    no bytes. Rows with one key, address and payload share a record id."""
    kind = df.schema[key].dataType.simpleString()

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for frame in frames:
            if out is None:
                fields = [("record", pa.string()), ("key", frame.schema.field(0).type), ("url", pa.string()), ("chunk", pa.int32())]
                fields += [("n_bytes", pa.int64()), ("sha1", pa.string()), ("last", pa.bool_())] + [("data", pa.binary())] * data
                out = _Rows(pa.schema(fields))
            keys, urls = frame.column(0).to_pylist(), frame.column(1).to_pylist()
            for key_, url_, cell in zip(keys, urls, frame.column(2), strict=True):
                whole = memoryview(cell.as_buffer()) if cell.is_valid else memoryview(b"")
                record = _urn(key_, url_, hashlib.sha1(whole).hexdigest())
                many = max(1, -(-len(whole) // chunk_bytes))
                digest = hashlib.sha1()
                for i in range(many):
                    part = whole[i * chunk_bytes : (i + 1) * chunk_bytes]
                    digest.update(part)
                    done = min(len(whole), (i + 1) * chunk_bytes)
                    row = (record, key_, url_, i, done, digest.copy().hexdigest(), i == many - 1)
                    yield from out.add((*row, bytes(part)) if data else row, len(part) if data else 0)
        if out is not None:
            yield from out.flush()

    shape = f"record string, key {kind}, url string, chunk int, n_bytes bigint, sha1 string, last boolean" + ", data binary" * data
    rows = df.select(df[key].alias("key"), df[url].cast("string").alias("url"), df[payload].cast("binary").alias("payload"))
    return rows.mapInArrow(task, shape)


def record_heads(ends: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One row per record of `ends` (last chunks): its key, address, size, digest, number of equal
    rows, and in `refers`, `refers_to`, `refers_url` the record it revisits, if any.

    Of equal payloads of at least `least_bytes` the one with the largest key is stored; the
    largest record id decides between equal keys, and rows without a key come last.
    """
    heads = ends.groupBy("record", "key", "url", "sha1", "n_bytes").agg(F.count(F.lit(1)).alias("copies"))
    large = heads.filter(F.col("n_bytes") >= least_bytes).groupBy("sha1", "n_bytes")
    shared = large.agg(F.max(F.struct("key", "record", "url")).alias("first"), F.count(F.lit(1)).alias("records")).filter("records > 1")
    # Staged: a join with the aggregate itself could not be split where a digest is frequent.
    first = stage(shared.select("sha1", "n_bytes", F.col("first.record").alias("refers"), F.col("first.key").alias("refers_to"), F.col("first.url").alias("refers_url")), "shared")
    joined = heads.join(first, ["sha1", "n_bytes"], "left")
    stored = F.coalesce(F.col("refers") == F.col("record"), F.lit(True))
    return joined.withColumns({c: F.when(~stored, F.col(c)) for c in ("refers", "refers_to", "refers_url")})


def _uri(url: str | None) -> str | None:
    """An address as a URI: what is not printable ASCII is percent-encoded; null if empty."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else None


def _headers(fields: list[tuple[str, str | None]], size: int) -> bytes:
    lines = ["WARC/1.1", *[f"{name}: {value}" for name, value in fields if value is not None], f"Content-Length: {size}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def _base32(sha1: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()


class _Archive:
    """An archive being written: records are gzip members of their own."""

    def __init__(self, fs: pafs.FileSystem, root: str, date: str, level: int):
        self.fs, self.root, self.name, self.level, self.date = fs, root, f"{uuid.uuid4().hex}.warc.gz", level, date
        self.out = fs.open_output_stream(f"{root}/{self.name}.open", compression=None)
        self.bytes = self.records = 0
        info = b"format: WARC File Format 1.1\r\n"
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(self.name)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
        self.begin(_headers(fields, len(info)))
        self.add(info)
        self.end()
        self.records = 0

    def begin(self, head: bytes) -> None:
        self.gz = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self.add(head)

    def add(self, data) -> None:
        self._put(self.gz.compress(data))

    def end(self) -> None:
        self.add(b"\r\n\r\n")
        self._put(self.gz.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        """Files get their name when whole; the manifest names those that count."""
        self.out.close()
        self.fs.move(f"{self.root}/{self.name}.open", f"{self.root}/{self.name}")
        return self.name, self.records, self.bytes


def _write_records(folder: str, least_bytes: int, archive_bytes: int, date: str, level: int):
    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        archive: _Archive | None = None
        written: list[tuple[str, int, int]] = []
        head: dict | None = None
        digest, size, next_chunk, small = hashlib.sha1(), 0, 0, b""

        def fields(kind: str, record: str) -> list[tuple[str, str | None]]:
            named = None if head["key"] is None else quote(head["key"], safe="")
            out = [("WARC-Type", kind), ("WARC-Record-ID", record), ("WARC-Date", date), ("WARC-Target-URI", _uri(head["url"]))]
            return [*out, ("WARC-Payload-Digest", _base32(head["sha1"])), ("Content-Type", "application/http;msgtype=response"), (KEY, named)]

        def opened() -> _Archive:
            nonlocal archive
            if archive is not None and archive.bytes >= archive_bytes:
                written.append(archive.close())
                archive = None
            if archive is None:
                archive = _Archive(fs, root, date, level)
            return archive

        def response(copy: int) -> _Archive:
            top = HTTP_HEAD.format(head["n_bytes"]).encode()
            out = opened()
            out.begin(_headers(fields("response", head["record"] if copy == 0 else _urn(head["record"], copy)), len(top) + head["n_bytes"]))
            out.add(top)
            return out

        def revisit(copy: int, record: str, key: str | None, url: str | None) -> None:
            top = HTTP_HEAD.format(head["n_bytes"]).encode()
            own = head["record"] if copy == 0 else _urn(head["record"], copy)
            more = [("WARC-Profile", REVISIT), ("WARC-Refers-To", record), ("WARC-Refers-To-Target-URI", _uri(url)), (REFERS, None if key is None else quote(key, safe=""))]
            out = opened()
            out.begin(_headers(fields("revisit", own) + more, len(top)))
            out.add(top)
            out.end()

        def finish() -> None:
            """End the record at hand and write those of its equal rows."""
            if head is None or head["refers"] is not None:
                return
            if size != head["n_bytes"] or digest.hexdigest() != head["sha1"]:
                raise ValueError(f"record {head['record']}: its chunks are not those of its digest")
            if head["n_bytes"] < least_bytes:
                for copy in range(head["copies"]):
                    out = response(copy)
                    out.add(small)
                    out.end()
            else:
                archive.end()
                for copy in range(1, head["copies"]):
                    revisit(copy, head["record"], head["key"], head["url"])

        names = ["record", "chunk", "key", "url", "sha1", "n_bytes", "copies", "refers", "refers_to", "refers_url"]
        for frame in frames:
            columns = [frame.column(i).to_pylist() for i in range(len(names))]
            cells = frame.column(len(names))
            for i, row in enumerate(zip(*columns, strict=True)):
                if row[1] == _HEAD:
                    finish()
                    head = dict(zip(names, row, strict=True))
                    digest, size, next_chunk, small = hashlib.sha1(), 0, 0, b""
                    if head["refers"] is not None:
                        for copy in range(head["copies"]):
                            revisit(copy, head["refers"], head["refers_to"], head["refers_url"])
                    elif head["n_bytes"] >= least_bytes:
                        response(0)
                    continue
                # Equal rows bring equal chunks; each is taken once. A revisit needs none.
                if head["refers"] is not None or row[1] != next_chunk:
                    continue
                part = memoryview(cells[i].as_buffer())
                digest.update(part)
                size, next_chunk = size + len(part), next_chunk + 1
                if head["n_bytes"] < least_bytes:
                    small += part
                else:
                    archive.add(part)
        finish()
        if archive is not None:
            written.append(archive.close())
        columns = list(zip(*written, strict=True)) or [(), (), ()]
        kinds = [("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    return task


def write_warc(
    df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES,
    chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z", level: int = LEVEL,
) -> DataFrame:
    """Write a record per row of `df` to archives in `folder` (a URI that all machines share), and
    return the manifest: archive, n_records, n_bytes. An archive is closed at `archive_bytes`.

    Of equal payloads of at least `least_bytes` one is a response and the others revisit it, see
    `record_heads`; of equal rows the first is the one stored. Chunks go to the task of their
    record by its id, in order, and are compressed as they come. Files that no manifest names are
    left behind by failed attempts and don't count.
    """
    spark = df.sparkSession
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    ends = stage(payload_chunks(df, key, url, payload, chunk_bytes, data=False).filter("last"), "ends")
    text = lambda c: F.col(c).cast("string").alias(c)
    heads = record_heads(ends, least_bytes).select(
        "record", F.lit(_HEAD).alias("chunk"), text("key"), "url", "sha1", "n_bytes", "copies", "refers", text("refers_to"), "refers_url", F.lit(None).cast("binary").alias("data")
    )
    chunks = payload_chunks(df, key, url, payload, chunk_bytes).select("record", "chunk", "data")
    both = heads.unionByName(chunks, allowMissingColumns=True).repartition("record").sortWithinPartitions("record", "chunk")
    task = _write_records(folder, least_bytes, archive_bytes, date, level)
    return stage(both.mapInArrow(task, "archive string, n_records bigint, n_bytes bigint"), "archives")


def _fields(file: io.BufferedReader, room: int) -> tuple[dict[str, str], int]:
    """Header lines up to the empty one, by lower-case name, and the bytes read."""
    out, read = {}, 0
    while True:
        line = file.readline(room + 1)
        read += len(line)
        if len(line) > room or not line:
            raise ValueError("a header without an end")
        room -= len(line)
        if not line.strip():
            return out, read
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()


def _hex_digest(value: str | None) -> str | None:
    """Lower-case hex of a `sha1:` header in base 32 or hex; null for another algorithm or none."""
    name, _, code = (value or "").partition(":")
    if name.lower() != "sha1":
        return None
    return code.lower() if len(code) == 40 else base64.b32decode(code.upper()).hex()


def read_records(raw, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """(headers, chunk, n_bytes, sha1, last, intact, data) of every record of an open archive, plain
    or gzipped, chunk by chunk.

    The payload of an HTTP response is what follows its header, and of other records the block. A
    revisit has one row with the stated size (null if not told) and digest. `intact` tells on last
    chunks whether the digest is the stated one, null if none is.
    """
    buffered = io.BufferedReader(raw, 1 << 16)
    file = io.BufferedReader(gzip.GzipFile(fileobj=buffered), 1 << 16) if buffered.peek(2)[:2] == b"\x1f\x8b" else buffered
    while line := file.readline(_HEADER_BYTES):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        head, _ = _fields(file, _HEADER_BYTES)
        left = int(head["content-length"])
        stated = _hex_digest(head.get("warc-payload-digest"))
        http: dict[str, str] = {}
        if left and head.get("content-type", "").startswith("application/http"):
            first = file.readline(left)
            http, read = _fields(file, left - len(first))
            left -= len(first) + read
        if head.get("warc-type") == "revisit":
            size = http.get("content-length")
            yield head, 0, None if size is None else int(size), stated, True, None, None
            while left:
                left -= len(_some(file, min(left, chunk_bytes)))
            continue
        digest, done, chunk = hashlib.sha1(), 0, 0
        while True:
            data = _some(file, min(left, chunk_bytes))
            left -= len(data)
            digest.update(data)
            done += len(data)
            sha1 = digest.copy().hexdigest()
            yield head, chunk, done, sha1, not left, None if left or stated is None else stated == sha1, data
            chunk += 1
            if not left:
                break


def _some(file: io.BufferedReader, size: int) -> bytes:
    data = file.read(size)
    if len(data) < size:
        raise ValueError("an archive ends inside a record")
    return data


def read_warc(archives: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """The chunk table of the archives named in the column `archive`: archive, record, record_type,
    key, url, refers, refers_to, chunk, n_bytes, sha1, last, intact, and with `data` the bytes.
    Archives are dealt evenly to tasks, and each is read as a stream."""
    fields = [(n, pa.string()) for n in ("archive", "record", "record_type", "key", "url", "refers", "refers_to")]
    fields += [("chunk", pa.int32()), ("n_bytes", pa.int64()), ("sha1", pa.string()), ("last", pa.bool_()), ("intact", pa.bool_())] + [("data", pa.binary())] * data
    schema = pa.schema(fields)

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out = _Rows(schema)
        for frame in frames:
            for name in frame.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    for head, chunk, n_bytes, sha1, last, intact, part in read_records(raw, chunk_bytes):
                        keys = [None if (v := head.get(h.lower())) is None else unquote(v) for h in (KEY, REFERS)]
                        row = (name, head.get("warc-record-id"), head.get("warc-type"), keys[0], head.get("warc-target-uri"), head.get("warc-refers-to"), keys[1])
                        row += (chunk, n_bytes, sha1, last, intact)
                        yield from out.add((*row, part) if data else row, len(part) if data and part else 0)
        yield from out.flush()

    strings = ", ".join(f"{n} string" for n, _ in fields[:7])
    shape = f"{strings}, chunk int, n_bytes bigint, sha1 string, last boolean, intact boolean" + ", data binary" * data
    names = archives.select("archive")
    return names.repartition(max(1, names.count())).mapInArrow(task, shape)


def warc_records(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES, **options) -> DataFrame:
    """Write the archives and read them back: `key`, payload_bytes, payload_digest, record_type,
    refers_to and intact, one row per row of `df`.

    A null payload is an empty one. A row without a key has a record without one, and is the stored
    one only where no equal payload has a key; a revisit of it has a null refers_to. Of equal rows
    from `least_bytes` on one is the response. An empty table gives no rows and no archive.
    """
    folder = f"{staging_root(df.sparkSession)}/warc-{uuid.uuid4().hex}"
    manifest = write_warc(slim(df, key, url, payload), folder, key, url, payload, least_bytes, **options)
    kind = df.schema[key].dataType
    rows = read_warc(manifest, folder, data=False).filter(F.col("last") & F.col("record_type").isin("response", "revisit"))
    return rows.select(
        F.col("key").cast(kind).alias(key), F.col("n_bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "intact"
    )


ORACLE = """
WITH placed AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload,
    row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS place,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest
  FROM pages
)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN octet_length(payload) >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(payload) >= 1000 AND place > 1 THEN largest END AS refers_to,
  CASE WHEN octet_length(payload) < 1000 OR place = 1 THEN true END AS intact
FROM placed
"""
