import base64
import hashlib

import pytest

from tidefold.llm import warc


def brute(rows):
    last = {}
    for d, h in rows:
        last[h or ""] = max(last.get(h or "", d), d)
    out = []
    for d, h in rows:
        p = (h or "").encode()
        dg = base64.b32encode(hashlib.sha1(p).digest()).decode()
        r = last[h or ""]
        out.append((d, len(p), dg, "response" if r == d else "revisit", None if r == d else r))
    return sorted(out)


NASTY = [
    (1, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (2, None),
    (3, ""),
    (4, "\nhttp://x 0.0.0.0 20000101000000 text/html 5\nabcde"),
    (5, "é" * 100_000 + "\n"),
    (6, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (7, "HTTP/1.1 200 OK\r\n\r\nbody"),
    (8, "﻿\x00 nul"),
]


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, tmp_path, monkeypatch, version):
    monkeypatch.setattr(warc, "FILE_RECORDS", 3)
    df = spark.createDataFrame([(d, "http://h/a b\nc" if d == 2 else None if d == 3 else f"http://h/{d}", h) for d, h in NASTY], "page_id long, url string, html string")
    df = df.selectExpr("*", "1 AS row_id", "2 AS payload").repartition(2)
    got = warc.archive_pages(df, version=version)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == brute(NASTY)
    arc, out = str(tmp_path / "arc"), str(tmp_path / "warc")
    warc.write_arc(df, arc, version=version)
    texts = {r.row_id: (r.payload, r.url) for r in warc.read_arc(spark, arc).collect()}
    assert texts[2] == ("", "http://h/a%20b%0Ac") and texts[3][1] == "urn:none" and texts[1][0] == NASTY[0][1] and texts[8][0] == NASTY[7][1]
    warc.convert_arc(spark, arc, out)
    back = {r.row_id: r for r in warc.read_warc(spark, out).collect()}
    assert back[5].payload == NASTY[4][1] and back[1].payload is None and back[6].payload == NASTY[0][1]
    assert back[5].date == "2000-01-01T00:00:05Z" and back[5].record_id.startswith("<urn:uuid:")
    assert back[1].refers_to_id == back[6].record_id


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (0, "v", "x"), (None, "u", "x")], "page_id long, url string, html string")
    assert warc.archive_pages(df.limit(0)).count() == 0
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archive_pages(df).collect())
    assert got == [("0", "revisit", 1), ("1", "response", None), ("1", "response", None), ("None", "revisit", 1)]


def test_broken_archives():
    with pytest.raises(ValueError):
        list(warc.arc_records(b"http://x 0 0 text/html 5\nabcde"))
    head = b"filedesc://a 0 0 text/plain 20\n1 0 x\nURL IP Length\n\n"
    with pytest.raises(ValueError):
        list(warc.arc_records(b"filedesc://a 0 0 text/plain 50\n1 0"))
    assert list(warc.arc_records(head)) == []
    with pytest.raises(ValueError):
        list(warc.warc_records(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc\r\n\r\n"))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = warc.op8_warc(spark, sf)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == brute(rows)


def test_foreign_archives_and_rows_without_ids(spark, tmp_path):
    """Records without an id of ours are keyed by file and place, and equal payloads are found among them."""
    block = lambda body: f"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n{body}"
    version = "1 0 Test\nURL IP-address Archive-date Content-type Archive-length\n"
    arc = f"filedesc://x.arc 0.0.0.0 20000101000000 text/plain {len(version)}\n{version}\n"
    for i, body in enumerate(("same", "other", "same", "same")):
        arc += f"http://h/{i} 1.2.3.4 20010203040506 text/html {len(block(body))}\n{block(body)}\n"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "part-0.arc").write_text(arc, newline="")
    warc.convert_arc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = warc.read_warc(spark, str(tmp_path / "warc")).collect()
    assert sorted((r.record_type, r.payload or "") for r in got) == [("response", "other"), ("response", "same"), ("revisit", ""), ("revisit", "")]
    ids = {r.record_id for r in got}
    assert len(ids) == 4 and {r.refers_to_id for r in got if r.record_type == "revisit"} <= ids
    rows = [(None, "u", "x"), (None, "u", "x"), (5, "u", "x"), (None, "u", "y"), (None, "u", "y")]
    out = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.payload_digest, r.record_type, str(r.page_id), str(r.refers_to)) for r in out if r.payload_digest == warc.digest_of(b"x")) == sorted(
        (warc.digest_of(b"x"), *t) for t in (("response", "5", "None"), ("revisit", "None", "5"), ("revisit", "None", "5"))
    )
    assert sorted(r.record_type for r in out if r.payload_digest == warc.digest_of(b"y")) == ["response", "revisit"]
