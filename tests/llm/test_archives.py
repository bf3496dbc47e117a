"""Archive conversion: both versions, lengths, revisits."""

import base64
import gzip
import hashlib

import pytest
from ledgerkeel.llm import archives as A



def record(header, content):
    return header + str(len(content)).encode() + b"\n" + content + b"\n"


def test_arc_headers_of_both_versions_and_declared_lengths():
    about = b"1 0 X\nURL IP-address Archive-date Content-type Archive-length\n"
    trap = b"HTTP/1.1 200 OK\r\n\r\nhttp://fake 0.0.0.0 20200101000000 text/html 3\nabc"
    data = record(b"filedesc://x 0.0.0.0 20200101000000 text/plain ", about)
    data += record(b"http://a/ 1.2.3.4 20210203040506 text/html ", trap)
    data += record(b"http://b/ 1.2.3.4 20210203040506 text/html ", b"")
    got = list(A.parse_arc(data))
    assert [(f[0], c) for f, c, _ in got] == [("http://a/", trap), ("http://b/", b"")]
    about = b"2 0 X\n" + A.ARC_FIELDS[2].encode() + b"\n"
    data = record(b"filedesc://x 0.0.0.0 20200101000000 text/plain 200 - - 0 x ", about)
    data += record(b"http://a/ 1.2.3.4 20210203040506 text/html 200 - - 0 x ", b"abc")
    assert [c for _, c, _ in A.parse_arc(data)] == [b"abc"]
    bad = list(A.parse_arc(data + b"http://a/ 1.2.3.4 20210203040506 text/html 3\nabc\n"))
    assert [e for _, _, e in bad] == [None, "5 header fields in version 2"]
    short = list(A.parse_arc(b"http://a/ 1.2.3.4 20210203040506 text/html 9\nabc\n"))
    assert [(c, e) for _, c, e in short] == [(b"abc\n", "shorter than declared")]
    lost = list(A.parse_arc(b"http://a/ 1.2.3.4 2021 text/html 3\nabc\nnothing like it\nmore\n"))
    assert [(c, e) for _, c, e in lost] == [(b"abc", "bad date"), (b"nothing like it\nmore\n", "no declared length")]


def test_warc_is_read_by_length():
    block = b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    got = list(A.parse_warc((head + block + b"\r\n\r\n") * 2))
    assert [b for _, b in got] == [block, block] and got[0][0]["warc-type"] == "response"
    with pytest.raises(ValueError):
        list(A.parse_warc(head + block + b"\r\n"))


def plain(pages):
    """Of equal payloads the first with the largest page id (null is smallest) is the response."""
    groups = {}
    for i, (page_id, _, html) in enumerate(pages):
        groups.setdefault((html or "").encode(), []).append((page_id is not None, page_id or 0, i))
    out = []
    for i, (page_id, _, html) in enumerate(pages):
        body = (html or "").encode()
        known, first, at = max(groups[body])
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        refers = first if known and i != at else None
        out.append((page_id, len(body), digest, "response" if i == at else "revisit", refers))
    return out


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_edge_rows(spark, rows):
    pages = [(1, "http://a/", "x"), (2, "http://a/b c\n", "x"), (3, None, "x"), (4, "", None), (5, "u", ""), (6, "é", "é\r\n\r\nWARC/1.1\r\n")]
    pages += [(None, "n", "x"), (None, "n", "alone"), (11, "n", "one named"), (None, "n", "one named"), (7, "u", "twice"), (7, "u", "twice"), (8, "u", "\n\n"), (9, "big", "z" * 3_000_000)]
    pages += [(100 + i, "hot", "copied page") for i in range(500)]
    df = spark.createDataFrame([(*p, 1, "q") for p in pages], "page_id long, url string, html string, archive int, digest string")
    assert rows(A.convert_pages(df), *COLUMNS) == sorted(plain(pages), key=repr)


def test_empty_table(spark):
    assert A.convert_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_converted_fields(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://b/", "x")], "page_id long, url string, html string")
    A.pages_to_arc(df, str(tmp_path / "arc"), 64)
    arc = A.read_arc(spark, str(tmp_path / "arc"))
    first = {r.page_id: r for r in arc.collect()}
    assert first[1].url == "http://a/" and first[1].record_id != first[2].record_id
    assert len(first[1].date) == 20 and first[1].date.endswith("Z")
    A.arc_to_warc(arc, str(tmp_path / "warc"), min_bytes=2)
    kinds = [r.record_type for r in A.read_warc(spark, str(tmp_path / "warc")).collect()]
    assert kinds == ["response", "response"]


def foreign(tmp_path, name, records, packed=False):
    data = record(b"filedesc://x 0.0.0.0 20200101000000 text/plain ", b"1 0 X\n" + A.ARC_FIELDS[1].encode() + b"\n")
    data += b"".join(record(head, content) for head, content in records)
    (tmp_path / name).write_bytes(gzip.compress(data) if packed else data)


def test_records_of_other_writers(spark, tmp_path):
    """Latin-1 URLs, name lookups, no page id, no Content-Length, broken files."""
    day = b" 1.2.3.4 20210203040506 "
    page = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nsame body"
    (tmp_path / "arc").mkdir()
    foreign(tmp_path / "arc", "a.arc", [(b"http://caf\xe9/" + day + b"text/html ", page), (b"http://two/" + day + b"text/html ", page), (b"http://three/" + day + b"text/html ", page)])
    foreign(tmp_path / "arc", "b.arc.gz", [(b"dns:host" + day + b"text/dns ", b"20210203040506\nhost. 60 IN A 1.2.3.4\n"), (b"http://old/" + day + b"text/html ", b"<html>no header</html>")], True)
    (tmp_path / "arc" / "c.arc.gz").write_bytes(b"\x1f\x8bbroken")
    arc = A.read_arc(spark, str(tmp_path / "arc"))
    errors = [r.error for r in arc.collect() if r.error]
    assert len(errors) == 1 and errors[0].startswith("not an archive")
    A.arc_to_warc(arc, str(tmp_path / "warc"))
    got = A.read_warc(spark, str(tmp_path / "warc")).collect()
    assert sorted(r.record_type for r in got) == ["resource", "resource", "response", "revisit", "revisit"]
    assert {r.payload_bytes for r in got if r.record_type == "revisit"} == {9} and len({r.record_id for r in got}) == 5
    fields = [f for p in (tmp_path / "warc").rglob("*.gz") for f, _ in A.parse_warc(A.unpacked(p.read_bytes()))]
    by_url = {f["warc-target-uri"]: f for f in fields}
    assert by_url["dns:host"]["content-type"] == "text/dns" and "http://café/" in by_url
    assert by_url["http://two/"]["content-type"] == "application/http; msgtype=response"


def test_archives_are_cut_by_bytes(spark, tmp_path):
    """Neither copies nor a hot page fill one archive; a larger record is alone in its own."""
    hot = spark.range(3_000).selectExpr("id AS page_id", "'http://hot/' AS url", "repeat('x', 1000) AS html")
    large = spark.range(1).selectExpr("id + 9000 AS page_id", "'http://large/' AS url", "repeat('y', 300000) AS html")
    A.pages_to_arc(hot.unionByName(large).coalesce(2), str(tmp_path / "arc"), 100_000)
    sizes = [len(A.unpacked(p.read_bytes())) for p in (tmp_path / "arc").rglob("*.gz")]
    assert len(sizes) > 40 and sum(s > 100_000 for s in sizes) == 1
    assert sorted(s > 300_000 for s in sizes)[-1] and A.read_arc(spark, str(tmp_path / "arc")).where("error IS NULL").count() == 3_001


def test_dates_do_not_hang_on_the_session(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x")], "page_id long, url string, html string")
    dates = set()
    for zone in ("UTC", "Pacific/Auckland"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            A.pages_to_arc(pages, str(tmp_path / zone.replace("/", "-")))
            dates.add(A.read_arc(spark, str(tmp_path / zone.replace("/", "-"))).first().date)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(dates) == 1
