"""Legacy archive converter: ARC records to WARC records.

An ARC file starts with a ``filedesc`` record that names its version. Version 1 header
lines have five fields (URL, IP, 14-digit date, type, length), version 2 lines ten (result
code, checksum, location, offset and file name besides). A record's content has exactly the
declared length; records are read by length, never by looking for text inside them. Each
becomes a WARC record: dates in ISO form, a record id from its contents, the media type,
SHA-1 digests in base32, and the type ``response`` or, where another record with the same
payload exists, ``revisit``.

Records of other schemes than HTTP, such as ``dns:``, become ``resource`` records with their own
media type. A record that cannot be read is kept as a row that says why; only good rows
are converted.

Archives are written by Spark as gzipped text with the record separators of the formats. Each
task cuts its rows into archives by a running sum of their bytes (``ARCHIVE_BYTES`` before
compression, or one larger record), so neither copies nor a hot page gather anywhere and nothing is
shuffled for it. Archives are read as binary files, so any store that Spark reaches will do; a
task holds one at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import BROADCAST_ROWS, bounded, written

ARCHIVE_BYTES = 8 << 20
CRLF = "\r\n"
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PAGE_FIELD, LENGTH_FIELD = "X-Page-Id", "X-Payload-Length"


def _header_url(url: Column) -> Column:
    """A URL as one header field: blanks and control characters percent-encoded, never empty."""
    safe = F.coalesce(url, F.lit(""))
    for char in (" ", "\t", "\n", "\x0b", "\x0c", "\r"):
        safe = F.replace(safe, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return F.when(safe == "", F.lit("about:blank")).otherwise(safe)


def _dealt(sizes: str, archive_bytes: int):
    """Add (archive, place): archives are cut where the bytes of a task's rows reach the limit.

    A row larger than the limit has an archive of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, filled, place = 0, 0, 0
        for batch in batches:
            archives, places = [], []
            for size in batch.column(batch.schema.get_field_index(sizes)).to_pylist():
                if place and filled + size > archive_bytes:
                    archive, filled, place = archive + 1, 0, 0
                filled, place = filled + size, place + 1
                archives.append(archive)
                places.append(place)
            parts = batch.column(batch.schema.get_field_index("part")).to_pylist()
            numbers = [part * _ARCHIVES_OF_A_TASK + own for part, own in zip(parts, archives, strict=True)]
            columns = [*batch.columns, pa.array(numbers, pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "archive", "place"])

    return run


_ARCHIVES_OF_A_TASK = 1 << 24


def _deal(rows: DataFrame, archive_bytes: int) -> DataFrame:
    """Rows with a column ``size``, dealt to archives within the task that has them."""
    placed = rows.withColumn("part", F.spark_partition_id().cast("long"))
    schema = T.StructType([*placed.schema.fields]).add("archive", "long").add("place", "long")
    return placed.mapInArrow(_dealt("size", archive_bytes), schema).drop("part", "size")


def pages_to_arc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write pages (page_id, url, html) as ARC files of both versions, a folder per archive.

    Content is an HTTP response whose header carries the page id (empty for null). Null html
    is an empty body, a null url ``about:blank``. No archive exceeds ``archive_bytes``, counted with
    500 bytes a record for its headers, unless a single record does.
    """
    page = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    body = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length("html"),
        F.lit(f"{CRLF}{PAGE_FIELD}: "),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(CRLF + CRLF),
        F.col("html"),
    )
    size = (F.octet_length("html") + F.octet_length("url") + 500).cast("long")
    records = page.select(_header_url(F.col("url")).alias("url"), body.alias("body"), F.coalesce(size, F.lit(500)).alias("size"))
    dealt = _deal(records, archive_bytes)
    # Days and seconds are put together as text: no session time zone takes part.
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.xxhash64("url"), F.lit(1_461)).cast("int"))
    second = F.pmod(F.xxhash64("url", F.lit(1)), F.lit(86_400))
    clock = [F.lpad(F.floor(part).cast("string"), 2, "0") for part in (second / 3_600, second % 3_600 / 60, second % 60)]
    date = F.concat(F.replace(day.cast("string"), F.lit("-"), F.lit("")), *clock)
    one = F.concat_ws(" ", "url", F.lit("0.0.0.0"), date, F.lit("text/html"), F.octet_length("body").cast("string"))
    two = F.concat_ws(
        " ", "url", F.lit("0.0.0.0"), date, F.lit("text/html"), F.lit("200"), F.md5("body"), F.lit("-"), F.lit("0"),
        F.concat(F.lit("a"), F.col("archive").cast("string"), F.lit(".arc")), F.octet_length("body").cast("string"),
    )
    even = F.col("archive") % 2 == 0
    about = F.when(even, F.lit(_about(1))).otherwise(F.lit(_about(2)))
    value = F.concat(
        F.when(F.col("place") == 1, about).otherwise(F.lit("")), F.when(even, one).otherwise(two), F.lit("\n"), F.col("body")
    )
    _write(dealt.withColumn("value", value), path, "\n")


def _about(version: int) -> str:
    """The record that opens an archive and names its version, with the newline that ends it."""
    content = f"{version} 0 Archive\n{ARC_FIELDS[version]}\n"
    rest = "" if version == 1 else " 200 - - 0 a"
    return f"filedesc://a 0.0.0.0 20200101000000 text/plain{rest} {len(content)}\n{content}\n"


def _write(dealt: DataFrame, path: str, line_end: str) -> None:
    (
        dealt.sortWithinPartitions("archive", "place")
        .select("archive", "value")
        .write.partitionBy("archive")
        .option("lineSep", line_end)
        .option("compression", "gzip")
        .text(path)
    )


def unpacked(data: bytes) -> bytes:
    """An archive's bytes, whether it is compressed (in one member or many) or not."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _text(data: bytes) -> str:
    """Header bytes as text: UTF-8, or else Latin-1, which reads anything."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def parse_arc(data: bytes) -> Iterator[tuple[list[str], bytes, str | None]]:
    """(header fields, content, error) of each record of one ARC file but its ``filedesc``.

    The version comes from the ``filedesc`` content. A record with a wrong number of fields, a bad
    date, or a content shorter than declared comes with an error and all bytes that belong to it.
    Without a length the next record cannot be found: the rest of the file is one bad record.
    """
    at, version = 0, 1
    while at < len(data):
        end = data.find(b"\n", at)
        fields = _text(data[at:end]).split(" ") if end >= 0 else []
        if not fields or not (fields[-1].isascii() and fields[-1].isdigit()):
            yield fields, data[at:], "no declared length"
            return
        length = int(fields[-1])
        content = data[end + 1 : end + 1 + length]
        at = end + 1 + length
        if data[at : at + 1] == b"\n":
            at += 1
        if fields[0].startswith("filedesc://"):
            named = content.split(b" ", 1)[0]
            version = int(named) if named in (b"1", b"2") else 1
            continue
        error = None
        if len(content) != length:
            error = "shorter than declared"
        elif len(fields) != (5 if version == 1 else 10):
            error = f"{len(fields)} header fields in version {version}"
        elif not (len(fields[2]) == 14 and fields[2].isascii() and fields[2].isdigit()):
            error = "bad date"
        yield fields, content, error


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload."""
    head, mark, payload = content.partition(b"\r\n\r\n")
    return (head + mark, payload) if mark else (b"", content)


def http_field(head: bytes, name: str) -> str | None:
    for line in head.decode("utf-8", "replace").split(CRLF)[1:]:
        key, _, value = line.partition(":")
        if key.strip().lower() == name.lower():
            return value.strip()
    return None


def _number(text: str | None) -> int | None:
    """A whole number that a header declares, or null."""
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}", text) else None


_ARC_COLUMNS = (
    "record_id string, url string, date string, media_type string, page_id long, digest string, payload_bytes long,"
    " head binary, payload binary, error string"
)


def _arc_row(name: str, fields: list[str], content: bytes, error: str | None) -> tuple:
    """An ARC record as a row; HTTP messages are split, anything else is payload as a whole."""
    url = fields[0] if fields else None
    head, payload = split_http(content) if error is None and content[:5] == b"HTTP/" else (b"", content)
    digest = digest32(payload)
    record = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {url} {digest}')}>"
    if error is not None:
        return record, url, None, None, None, digest, len(payload), head, payload, error
    day = fields[2]
    date = f"{day[:4]}-{day[4:6]}-{day[6:8]}T{day[8:10]}:{day[10:12]}:{day[12:14]}Z"
    page = _number(http_field(head, PAGE_FIELD))
    return record, url, date, fields[3], page, digest, len(payload), head, payload, None


def _arc_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [column.split()[0] for column in _ARC_COLUMNS.split(",")]
    for pdf in batches:
        for name, data in zip(pdf["name"], pdf["content"], strict=True):
            try:
                records = list(parse_arc(unpacked(data)))
            except (OSError, EOFError, zlib.error) as broken:
                records = [([], data, f"not an archive: {broken}")]
            # A record's place makes its id its own, also where records are equal.
            out = [_arc_row(f"{name}#{i}", *own) for i, own in enumerate(records)]
            yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64"})


def read_arc(spark, path: str) -> DataFrame:
    """One row per record of ARC files: its WARC identity and date, digest, header and payload.

    ``error`` is null for a good record; a bad one has its bytes as payload. ``media_type`` is the
    header's. Ids come from the archive's folder and name, the record's place, URL and payload.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    name = F.concat_ws("/", F.element_at(parts, -2), F.regexp_replace(F.element_at(parts, -1), "-c[0-9]+.*|-[0-9a-f]{8}-.*", ""))
    return files.select(name.alias("name"), "content").mapInPandas(_arc_rows, _ARC_COLUMNS)


def arc_to_warc(arc: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, min_bytes: int = 0) -> None:
    """Write the WARC form of the good ARC rows, a folder per archive.

    Of HTTP messages with equal payloads of at least ``min_bytes`` one is the response: that with the
    largest page id, of equal ones (or without any) that with the largest record id. Others
    revisit it and hold the HTTP header only; shorter payloads are all responses. Rows
    without an HTTP header are resources with their own media type.
    """
    good = arc.where("error IS NULL").select("record_id", "url", "date", "media_type", "page_id", "digest", "payload_bytes", "head", "payload")
    http = F.octet_length("head") > 0
    facts = written(good.select("digest", "payload_bytes", "page_id", "record_id", http.alias("http")), "warc-facts")
    facts = facts.where(F.col("http") & (F.col("payload_bytes") >= min_bytes))
    # A struct without page id is smaller than any with one.
    first = facts.groupBy("digest").agg(F.max(F.struct("page_id", "record_id")).alias("first"), F.count("*").alias("n"))
    first = written(first.where("n > 1").select("digest", F.col("first.record_id").alias("first_id")), "warc-firsts")
    joined = good.join(bounded(first, first.count(), BROADCAST_ROWS), "digest", "left")
    revisit = http & (F.col("payload_bytes") >= min_bytes) & (F.col("first_id") != F.col("record_id"))
    kind = F.when(~http, "resource").when(F.coalesce(revisit, F.lit(False)), "revisit").otherwise("response")
    typed = joined.withColumn("kind", kind)
    again = F.col("kind") == "revisit"
    block = F.when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    media = F.when(F.col("kind") == "resource", F.col("media_type")).otherwise("application/http; msgtype=response")
    lines = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("kind"),
        F.lit(f"{CRLF}WARC-Record-ID: "), F.col("record_id"),
        F.lit(f"{CRLF}WARC-Date: "), F.col("date"),
        F.lit(f"{CRLF}WARC-Target-URI: "), F.col("url"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit(f"{CRLF}{LENGTH_FIELD}: "), F.col("payload_bytes").cast("string"),
        F.when(again, F.concat(
            F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "),
            F.col("first_id"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: "), media, F.lit(f"{CRLF}Content-Length: "),
        F.octet_length(block), F.lit(CRLF + CRLF),
    )
    value = F.concat(lines.cast("binary"), block, F.lit(CRLF).cast("binary"))
    records = typed.select(value.cast("string").alias("value"))
    _write(_deal(records.withColumn("size", F.octet_length("value").cast("long")), archive_bytes), path, CRLF)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of one WARC file, by declared length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = _text(data[at:end]).split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError("A WARC record must start with its version.")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = int(fields["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError("A WARC record does not end where it declares.")
        at = end + 8 + length
        yield fields, block


def _warc_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for data in pdf["content"]:
            out = []
            for fields, block in parse_warc(unpacked(data)):
                kind = fields["warc-type"]
                head, payload = (b"", block) if kind == "resource" else split_http(block)
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if kind != "revisit" and digest32(payload) != digest:
                    raise ValueError(f"{fields['warc-record-id']} does not have the payload it declares.")
                # Revisits have no payload; its length stands in the record or its HTTP header, or nowhere.
                size = len(payload)
                if kind == "revisit":
                    size = _number(fields.get(LENGTH_FIELD.lower()) or http_field(head, "Content-Length"))
                page = _number(http_field(head, PAGE_FIELD))
                out.append((fields["warc-record-id"], page, size, digest, kind, fields.get("warc-refers-to")))
            names = ["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to_id"]
            yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64"})


def read_warc(spark, path: str) -> DataFrame:
    """Rows (record_id, page_id, payload_bytes, payload_digest, record_type, refers_to_id) of WARC files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInPandas(
        _warc_rows,
        "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_id string",
    )


def convert_pages(pages: DataFrame) -> DataFrame:
    """Write pages as ARC, convert to WARC, read that back; one row per page.

    Rows (page_id, payload_bytes, payload_digest, record_type, refers_to), where refers_to
    is the page id of the response a revisit names. Only page_id, url and html are used.
    """
    spark = pages.sparkSession
    arc_path, warc_path = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    pages_to_arc(pages, arc_path)
    arc_to_warc(read_arc(spark, arc_path), warc_path)
    records = written(read_warc(spark, warc_path), "warc-records")
    responses = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id"))
    responses = responses.agg(F.max("page_id").alias("refers_to"))
    found = records.join(responses, "refers_to_id", "left")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
