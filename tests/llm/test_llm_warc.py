"""WARC archives: round trips, chunks, revisits, and the format read by other code."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid

import duckdb
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from casewell.llm import warc
from casewell.session import staging_root


def odd_pages():
    long = "<html>" + "é日x" * 3000
    pages = [(1, "http://a/1", long), (9, "http://a/9", long), (4, None, long), (None, "http://a/n", long)]
    pages += [(10, "", "short"), (11, "http://a b/\r\nX: y", "short"), (12, "u", None), (13, "u", ""), (None, "u", "")]
    pages += [(20, "u", "q" * 1000), (21, "u", "q" * 1000), (22, "u", "r" * 999), (23, "u", "r" * 999)]
    pages += [(30, "u", "equal rows " * 200)] * 3 + [(31, "u", "equal")] * 2 + [(32, "v", "own key " * 300), (32, "w", "own key " * 300)]
    pages += [(40, "u", "z" * 1_000_000), (41, "u", "WARC/1.1\r\n\r\n" * 90), (None, "a", "none " * 300), (None, "b", "none " * 300)]
    return pages


def plain(pages, least=1000):
    out, groups = [], {}
    for page in pages:
        groups.setdefault(page[2] or "", []).append(page[0])
    for html, keys in groups.items():
        raw = html.encode()
        own = sorted(keys, key=lambda k: (k is None, -(k or 0)))
        for i, key in enumerate(own):
            again = len(raw) >= least and i > 0
            out.append((key, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", own[0] if again else None, None if again else True))
    return sorted(out, key=str)


def frame(spark, pages):
    return spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, record string, chunk int").repartition(3)


@pytest.mark.parametrize("chunk,archive", [(256 << 10, 1 << 30), (700, 2000)])
def test_records_equal_plain_version(spark, chunk, archive):
    found = warc.warc_records(frame(spark, odd_pages()), chunk_bytes=chunk, archive_bytes=archive)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(odd_pages())


def test_oracle_equals_plain_version():
    link, pages = duckdb.connect(), odd_pages()
    link.register("pages", pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "html": pa.array([p[2] for p in pages], pa.string())}))
    assert sorted(link.sql(warc.ORACLE).fetchall(), key=str) == plain(pages)


def test_empty_table_and_text_keys(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.warc_records(none).collect() == []
    rows = [("a b\r\nc%0A", "u", "x" * 1500), ("é", "u", "x" * 1500), ("", "u", "y")]
    df = spark.createDataFrame(rows, "name string, at string, body string")
    found = {r["name"]: (r["record_type"], r["refers_to"]) for r in warc.warc_records(df, "name", "at", "body").collect()}
    assert found == {"é": ("response", None), "a b\r\nc%0A": ("revisit", "é"), "": ("response", None)}


def test_chunks_carry_running_digests(spark):
    df = spark.createDataFrame([(1, "u", "abcdefghij")], "page_id long, url string, html string")
    rows = warc.payload_chunks(df, chunk_bytes=4).orderBy("chunk").collect()
    assert [bytes(r["data"]) for r in rows] == [b"abcd", b"efgh", b"ij"] and [r["last"] for r in rows] == [False, False, True]
    assert [(r["n_bytes"], r["sha1"]) for r in rows] == [(n, hashlib.sha1(b"abcdefghij"[:n]).hexdigest()) for n in (4, 8, 10)]


def test_archives_hold_payloads_and_standard_records(spark):
    pages = odd_pages()
    folder = f"{staging_root(spark)}/test-{uuid.uuid4().hex}"
    manifest = warc.write_warc(frame(spark, pages), folder, chunk_bytes=5000, archive_bytes=3000)
    names = manifest.collect()
    assert len(names) > 1 and sum(r["n_records"] for r in names) == len(pages)
    rows = warc.read_warc(manifest, folder, chunk_bytes=999)
    assert rows.filter(F.length("data") > 999).count() == 0
    bodies, refers = {}, {}
    for r in rows.filter("record_type != 'warcinfo'").orderBy("record", "chunk").collect():
        if r["record_type"] == "revisit":
            refers[r["record"]] = r["refers"]
        else:
            bodies.setdefault(r["record"], []).append(bytes(r["data"]))
    assert set(refers.values()) <= bodies.keys() and len(refers) + len(bodies) == len(pages)
    stored = sorted(b"".join(b).decode() for b in bodies.values())
    assert stored == sorted([p[2] or "" for p in pages if len((p[2] or "").encode()) < 1000] + sorted({p[2] for p in pages if p[2] and len(p[2].encode()) >= 1000}))
    # Each record is a gzip member, and the file begins with its description.
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/{names[0]['archive']}", compression=None) as file:
        text = gzip.decompress(file.read())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and b"\r\nX: y" not in text and text.endswith(b"\r\n\r\n")


def test_reads_other_archives():
    """Plain files, hex digests, records that are no HTTP response, unknown types."""
    body = b"HTTP/1.0 200 OK\nA: b\n\npayload"
    text = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\n"
    text += b"WARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (hashlib.sha1(b"payload").hexdigest().encode(), len(body)) + body + b"\r\n\r\n"
    text += b"WARC/1.0\nWARC-Type: metadata\nContent-Length: 3\n\nabc\r\n\r\n"
    text += b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Payload-Digest: md5:00\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    text += b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: 1\r\n\r\nx\r\n\r\n" % (b"0" * 40)
    for raw in (text, gzip.compress(text)):
        rows = list(warc.read_records(io.BytesIO(raw), 4))
        assert [(r[0]["warc-type"], *r[1:3], *r[4:]) for r in rows] == [
            ("response", 0, 4, False, None, b"payl"),
            ("response", 1, 7, True, True, b"oad"),
            ("metadata", 0, 3, True, None, b"abc"),
            ("revisit", 0, None, True, None, None),
            ("resource", 0, 1, True, False, b"x"),
        ]
    for broken in (text[:-8], b"no archive", b"WARC/1.0\r\nA: b"):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(broken)))
