"""Legacy web archives: ARC files are parsed by their declared lengths and become WARC files.

Archives are written by Spark's text writer, one record a row, so they land on
any file system Spark can write, and are read with the binary reader.  A file
holds a bounded number of records, and is the unit of reading.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import scratch_path, stored, table

#: Records of one archive file; the reader holds one file in memory.
FILE_RECORDS = 1000
#: Payloads of at least so many bytes are deduplicated.
MIN_REVISIT_BYTES = 0
_IN_PARTITION = (1 << 33) - 1

#: The two record definitions, fixed by the format.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}


def _write_records(rows: DataFrame, record: Column, first: Column, path: str) -> None:
    """Write ``record`` values, each ended by a line feed; ``first`` leads every file."""
    leads = (F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)) % FILE_RECORDS) == 0
    (
        rows.select(record.alias("_record"))
        .select(F.when(leads, F.concat(first, F.lit("\n"), F.col("_record"))).otherwise(F.col("_record")).alias("value"))
        .write.option("maxRecordsPerFile", FILE_RECORDS)
        .option("compression", "gzip")
        .text(path)
    )


def _url_field(url: Column) -> Column:
    """Header fields are separated by blanks, so white space in a URL is escaped; a null URL is ``urn:none``."""
    clean = url
    for c, esc in (("%", "%25"), (" ", "%20"), ("\n", "%0A"), ("\r", "%0D"), ("\t", "%09")):
        clean = clean if c == "%" else F.replace(clean, F.lit(c), F.lit(esc))
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("urn:none")).otherwise(clean)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 1) -> None:
    """One ARC record per row: an HTTP response whose body is the UTF-8 text (null: empty).

    The date is synthesised from the id (seconds after 2000-01-01), as the table
    has none; null ids write an empty ``X-Row-Id``.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Row-Id: "),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    date = F.date_format(F.timestamp_seconds(F.lit(946684800) + F.pmod(F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)), F.lit(1_000_000_000))), "yyyyMMddHHmmss")
    length = (F.octet_length(head) + F.octet_length(body)).cast("string")
    middle = [F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("part.arc")] if version == 2 else []
    line = F.concat_ws(" ", _url_field(F.col(url_col)), F.lit("0.0.0.0"), date, F.lit("text/html"), *middle, length)
    version_block = f"{version} 0 tidefold\n{' '.join(ARC_FIELDS[version])}\n"
    middle_text = " 200 - - 0 part.arc" if version == 2 else ""
    first = f"filedesc://part.arc 0.0.0.0 20000101000000 text/plain{middle_text} {len(version_block)}\n{version_block}"
    _write_records(pages, F.concat(line, F.lit("\n"), head, body), F.lit(first), path)


def inflate(content: bytes) -> bytes:
    """All gzip members of a file, or the file itself if it is not compressed."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        d = zlib.decompressobj(31)
        out.append(d.decompress(content) + d.flush())
        content = d.unused_data.lstrip(b"\0")
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(header fields, content)`` of the records of one ARC file of version 1 or 2.

    The version block at the start names the fields; each record is a header
    line and as many bytes as its last field declares.  Blank lines between
    records are skipped.  A header of the wrong width or a short record raises.
    """
    fields, at = None, 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            end = len(data)
        line = data[at:end].rstrip(b"\r")
        if not line:
            at = end + 1
            continue
        parts = line.decode("utf-8", "replace").split(" ")
        if fields is None and not line.startswith(b"filedesc://"):
            raise ValueError("an ARC file begins with a filedesc record")
        if fields is not None and len(parts) != len(fields):
            raise ValueError(f"ARC header has {len(parts)} fields, not {len(fields)}")
        size = int(parts[-1])
        content = data[end + 1 : end + 1 + size]
        if size < 0 or len(content) != size:
            raise ValueError("ARC record is shorter than declared")
        if fields is None:
            version = int(content.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            named = content.split(b"\n")[1].decode().split()
            fields = tuple(named) if named else ARC_FIELDS[version]
        else:
            yield dict(zip(fields, parts)), content
        at = end + 1 + size


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and body."""
    end = block.find(b"\r\n\r\n")
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (b"", block)


def http_field(head: bytes, name: bytes) -> str:
    for line in head.split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip().decode("utf-8", "replace")
    return ""


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


_ARC_SCHEMA = "url string, ip string, date string, mime string, head string, payload string, row_id bigint, payload_bytes bigint, payload_digest string"


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of a folder of ARC files; ``payload=False`` leaves texts and heads null.

    ``row_id`` is the id that our own files carry; any other record gets a negative
    one from its file and place, so that each has a key.  A record that is not as
    long as declared raises; empty folders give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for i, (h, block) in enumerate(arc_records(inflate(content.as_buffer().to_pybytes()))):
                    head, body = split_http(block)
                    rid = http_field(head, b"x-row-id") or -1 - (xxhash.xxh3_64_intdigest(f"{name}#{i}") >> 1)
                    text, top = (body.decode("utf-8", "replace"), head.decode("utf-8", "replace")) if payload else (None, None)
                    rows.append((h["URL"], h["IP-address"], h["Archive-date"], h["Content-type"], top, text, int(rid), len(body), digest_of(body)))
                kinds = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.string()]
                cols = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds)]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _ARC_SCHEMA.split(", ")])

    return _files(spark, path).mapInArrow(run, _ARC_SCHEMA)


def revisit_decisions(records: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(row_id, refers_to)`` of the records that repeat a payload; the largest row id of it is the response.

    Digests and ids only; a digest of very many copies is reduced before the shuffle, and the
    repeated digests are a table of their own, so that the rows of one can be split in the join.
    """
    last = records.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("row_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    return (
        records.where(F.col("payload_bytes") >= min_bytes)
        .join(stored(last.where("n > 1").drop("n"), "last"), "payload_digest")
        .where(F.col("row_id") < F.col("refers_to"))
        .groupBy("row_id", "payload_digest")
        .agg(F.max("refers_to").alias("refers_to"))
    )


def _uuid(*parts: Column) -> Column:
    """A name-based identifier in the shape of a version 5 UUID."""
    h = F.sha1(F.concat_ws("\x1f", *parts).cast("binary"))
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
        F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"),
    )


def _record_id(row_id: Column, digest: Column) -> Column:
    return _uuid(F.coalesce(row_id.cast("string"), F.lit("-")), digest)


def write_warc(records: DataFrame, path: str) -> None:
    """WARC 1.1 files from ARC records with a ``refers_to`` column (null: response).

    Identifiers are synthesised from id and digest, dates from the archive date
    (an unreadable one becomes 1970).  A revisit keeps its HTTP head and no body.
    """
    date = F.date_format(F.coalesce(F.try_to_timestamp("date", F.lit("yyyyMMddHHmmss")), F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("refers_to").isNotNull()
    digest = F.col("payload_digest")
    length = F.octet_length("head") + F.when(revisit, F.lit(0)).otherwise(F.octet_length("payload"))
    crlf = F.lit("\r\n")
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), crlf,
        F.lit("WARC-Record-ID: "), _record_id(F.col("row_id"), digest), crlf,
        F.lit("WARC-Date: "), date, crlf,
        F.lit("WARC-Target-URI: "), F.col("url"), crlf,
        F.lit("WARC-IP-Address: "), F.col("ip"), crlf,
        F.lit("WARC-Payload-Digest: sha1:"), digest, crlf,
        F.when(
            revisit,
            F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
                _record_id(F.col("refers_to"), digest), crlf,
            ),
        ).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"),
        F.col("head"), F.when(revisit, F.lit("")).otherwise(F.col("payload")), F.lit("\r\n\r"),
    )
    info = "software: tidefold\r\nformat: WARC File Format 1.1\r\n"
    first = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:00000000-0000-5000-a000-000000000000>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}\r\n\r"
    _write_records(records, record, F.lit(first), path)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(named fields, block)`` of the records of one WARC file, by their declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("a WARC record was expected")
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.decode().lower()] = v.strip().decode("utf-8", "replace")
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size
        if len(block) != size or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("WARC record is not as long as declared")
        at += 4
        yield fields, block


_WARC_SCHEMA = "record_id string, record_type string, url string, date string, row_id bigint, payload string, payload_bytes bigint, payload_digest string, refers_to_id string"


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of a folder of WARC files but for ``warcinfo``.

    ``payload_bytes`` is measured on responses and taken from the HTTP head of
    revisits; a response whose body does not have the digest it declares raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for h, block in warc_records(inflate(content.as_buffer().to_pybytes())):
                    if h["warc-type"] == "warcinfo":
                        continue
                    head, body = split_http(block)
                    rid, digest = http_field(head, b"x-row-id"), h["warc-payload-digest"].removeprefix("sha1:")
                    response = h["warc-type"] == "response"
                    if response and digest_of(body) != digest:
                        raise ValueError("WARC payload does not have its digest")
                    size = len(body) if response else int(http_field(head, b"content-length"))
                    text = body.decode("utf-8", "replace") if payload and response else None
                    rows.append((h["warc-record-id"], h["warc-type"], h["warc-target-uri"], h["warc-date"], int(rid) if rid else None, text, size, digest, h.get("warc-refers-to")))
                kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
                cols = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds)]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _WARC_SCHEMA.split(", ")])

    return _files(spark, path).mapInArrow(run, _WARC_SCHEMA)


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """ARC files, ours or foreign, to WARC files: one pass for digests, one for the records.

    Of equal payloads the record with the largest id is the response; records
    without an id of their own come before all others.
    Decisions are joined on the row id, so neither copies nor long texts meet in one task.
    """
    again = stored(revisit_decisions(stored(read_arc(spark, arc_path, payload=False).select("row_id", "payload_digest", "payload_bytes"), "digests"), min_bytes), "revisits")
    write_warc(read_arc(spark, arc_path).join(again, ["row_id", "payload_digest"], "left"), warc_path)


def warc_index(spark: SparkSession, path: str) -> DataFrame:
    """``(row_id, payload_bytes, payload_digest, record_type, refers_to)`` of a folder of WARC files."""
    records = stored(read_warc(spark, path, payload=False), "warc-index")
    targets = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("row_id").alias("refers_to")).dropDuplicates(["refers_to_id"])
    revisits = records.where("record_type = 'revisit'").join(targets, "refers_to_id", "left")
    names = ["row_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("bigint")).select(*names).unionByName(revisits.select(*names))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 1) -> DataFrame:
    """Write ``pages`` as ARC, convert to WARC, and read the WARC files back: one row per input row.

    Null texts are empty payloads, null and blank URLs ``urn:none``.  The id is
    the key: repeated rows of the response's id are responses themselves.  Rows
    without an id revisit like others (among themselves ``refers_to`` is null, as
    the response has no id).  An empty table gives an empty result.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, html_col, version)
    convert_arc(spark, arc, warc)
    return warc_index(spark, warc).withColumnRenamed("row_id", id_col)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through both archives; nulls, repeated rows and empty tables: as ``archive_pages``."""
    return archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: DuckDB: base32 of the SHA-1 as four letters for each five hex digits.
OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(h, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY h) AS top
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""
