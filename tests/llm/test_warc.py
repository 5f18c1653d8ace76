"""Round trips through both ARC versions, and broken archives."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from tidewheel.llm import warc
from tidewheel.llm.warc import arc_record, arc_version_block, read_arc, round_trip

SCHEMA = "page_id long, url string, html string, archive long, digest string"


def pages():
    big = "<p>é\r\nWARC/1.1\r\nhttp://x 0.0.0.0 2000 text/html 5\n</p>" * 30
    return [(5, "http://a/ b\n", big), (3, None, big), (9, "http://ä/", big), (1, "u", "tiny"), (2, "u", "tiny"), (4, "u", None), (6, "", ""), (None, "n", "n" * 200), (8, "n", "n" * 200), (7, "r", "r" * 150), (7, "r", "r" * 150), (10, "x", "\n" * 120)]


def expected(rows):
    out = Counter()
    first = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= 100:
            first.setdefault(h, []).append((p is None, p))
    seen = Counter()
    for p, _, h in rows:
        raw = (h or "").encode()
        kind, refers = "response", None
        if h in first:
            lead = min(first[h])
            if (p is None, p) != lead or seen[h, p]:
                kind, refers = "revisit", lead[1]
            seen[h, p] += 1
        out[p, len(raw), hashlib.sha256(raw).hexdigest(), kind, refers] += 1
    return out


@pytest.mark.parametrize("archive_bytes", [warc.ARCHIVE_BYTES, 300])
def test_round_trip(spark, archive_bytes):  # 300: many archives, of both versions
    df = spark.createDataFrame([(*r, 1, "d") for r in pages()], SCHEMA)
    got = round_trip(df, archive_bytes)
    assert Counter(tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == expected(pages())
    ids = [r["record_id"] for r in got.collect()]
    assert len(set(ids)) == len(ids) and all(i.startswith("<urn:uuid:") for i in ids)
    assert {r["date"] for r in got.collect()} == {"2000-01-01T00:00:00Z"}


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_headers_by_version(version):
    data = arc_version_block(version, "x.arc") + b"\n" + arc_record(version, "http://a/", 7, b"p\nq", "x.arc") + b"\n"
    info, r = read_arc(data)
    assert info.kind == "warcinfo" and info.url == "x.arc"
    assert (r.url, r.date, r.page_id, r.payload) == ("http://a/", "20000101000000", 7, b"p\nq")


def foreign(tmp_path):
    """An archive of version 2 as another tool might have written it: a member of gzip each record, bytes of any kind."""
    import gzip

    html = b"HTTP/1.0 200 OK\r\nX-Page-Id: none of yours\r\n\r\n" + bytes(range(256))
    records = [
        arc_version_block(2, "old.arc") + b"\n",
        b"http://caf\xe9/ 10.0.0.1 20010203040506 text/html 302 - http://to/ 0 old.arc %d\n" % len(html) + html + b"\n",
        b"dns:example.org 10.0.0.2 20010203040507 text/dns 001 - - 0 old.arc 9\n1.2.3.4\n\xff\n",
        b"http://caf\xe9/2 10.0.0.1 2001 text/html 200 - - 0 old.arc %d\n" % len(html) + html + b"\n",
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "old.arc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    return html


def test_foreign_archives(spark, tmp_path):
    html = foreign(tmp_path)
    warc.convert(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b")
    got = sorted(warc.read_records(spark, f"file://{tmp_path}/b").collect(), key=lambda r: r["date"])
    payload = html.split(b"\r\n\r\n", 1)[1]
    digest = hashlib.sha256(payload).hexdigest()
    assert [(r["record_type"], r["page_id"], r["payload_bytes"], r["date"], r["ip"]) for r in got] == [
        ("revisit", None, 256, "2001-01-01T00:00:00Z", "10.0.0.1"),
        ("response", None, 256, "2001-02-03T04:05:06Z", "10.0.0.1"),
        ("resource", None, 9, "2001-02-03T04:05:07Z", "10.0.0.2"),
    ]
    assert got[0]["payload_digest"] == got[1]["payload_digest"] == digest
    [content] = [r["content"] for r in warc._archives(spark, f"file://{tmp_path}/b").collect()]
    raw = warc._inflate(bytes(content))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and raw.count(payload) == 1
    assert b"X-ARC-Result-Code: 302\r\nX-ARC-Location: http://to/\r\n" in raw and b"Content-Type: text/dns" in raw


def test_directories_stay_few(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", "x" * 900) for i in range(40)], "page_id long, url string, html string").repartition(4)
    warc.write_arc(df, f"file://{tmp_path}/a", 3000)
    assert len([p for p in (tmp_path / "a").iterdir() if p.is_dir()]) <= 6
    assert len(list((tmp_path / "a").rglob("*.gz"))) >= 12


def test_broken_archives_are_errors():
    block = arc_version_block(1, "x")
    with pytest.raises(ValueError, match="declares"):
        list(read_arc(block + b"\nhttp://a/ 0.0.0.0 20000101000000 text/html 99\nshort"))
    with pytest.raises(ValueError, match="fields"):
        list(read_arc(block + b"\nhttp://a/ 0.0.0.0 3\nabc"))
