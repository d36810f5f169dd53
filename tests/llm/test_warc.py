"""The content-addressed archive: records, revisits, exact round trips and damaged files."""

import base64
import gzip
import hashlib
import io
import random

import pytest

from meterline.llm import warc

SCHEMA = "page_id long, url string, html string, rec string, content string, digest string, header string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x", "x") for i, u, h in rows], SCHEMA)


def expected(rows, min_bytes=0):
    out, first = [], {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        known = len(data) >= min_bytes and data in first
        first.setdefault(data, i)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if known else "response", first[data] if known else None))
    return sorted(out, key=repr)


def odd_rows():
    rng = random.Random(5)
    rows = [(rng.randrange(10**6) - 500, f"http://h/{k}", "".join(rng.choices(["<p>", "é", "中\r\n\r\n", "x"], k=rng.randrange(5)))) for k in range(300)]
    rows += [(None, None, None), (None, "u", ""), (3, "a\r\nX-Archive-Record: 7 revisit 1 1 A", "same"), (3, "b", "same"), (3, "b", "same"), (None, "c", "same")]
    return rows + [(9, "http://ü", "long " * 50_000), (10, "", "\r\n\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_listing_against_brute_force(spark, monkeypatch, tmp_path, min_bytes):
    monkeypatch.setattr(warc, "FILE_BYTES", 3_000)
    rows = odd_rows()
    got = warc.report(pages_of(spark, rows), str(tmp_path / "a"), min_bytes).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows, min_bytes)


def test_originals_come_back_byte_for_byte(spark, tmp_path):
    rows = odd_rows()
    records = warc.originals(pages_of(spark, rows))
    before = sorted((r["page_id"] is None, r["page_id"], bytes(r["header"]) + bytes(r["payload"]) + b"\r\n\r\n") for r in records.collect())
    archive = warc.write(records, str(tmp_path / "a"))
    after = sorted((r["page_id"] is None, r["page_id"], bytes(r["record"])) for r in warc.originals_of(archive).collect())
    assert after == before
    names = {r["name"] for r in archive.index.collect()}
    stored = b"".join(gzip.decompress((tmp_path / "a" / n).read_bytes()) for n in names)
    assert stored.count(b"long " * 50_000) == 1


def test_records_of_files_are_archived_again(spark, tmp_path):
    plain = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    reply = b"WARC/1.0\r\nContent-Type: application/http\r\nWARC-Type: revisit\r\nX-Archive-Record: 9 revisit 8 7 Q\r\ncontent-length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(plain + reply)
    (tmp_path / "in" / "b.warc.gz").write_bytes(gzip.compress(reply) + gzip.compress(plain))
    names = spark.createDataFrame([("a.warc",), ("b.warc.gz",)], "name string")
    read = warc.read_files(names, str(tmp_path / "in"))
    records = read.selectExpr("cast(null as long) AS page_id", "name AS url", "header", "payload")
    archive = warc.write(records, str(tmp_path / "out"))
    assert sorted(bytes(r["record"]) for r in warc.originals_of(archive).collect()) == sorted([plain, reply] * 2)
    assert sorted(r["record_type"] for r in warc.listing(archive).collect()) == ["response"] * 2 + ["revisit"] * 2


def test_a_changed_payload_is_noticed(spark, tmp_path):
    archive = warc.write(warc.originals(pages_of(spark, [(1, "u", "first"), (2, "u", "second")])), str(tmp_path))
    for row in archive.index.collect():
        path = tmp_path / row["name"]
        data = gzip.decompress(path.read_bytes()).replace(b"second", b"secont")
        path.write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.listing(archive).collect()
    with pytest.raises(Exception, match="does not match its digest"):
        warc.originals_of(archive).collect()


def test_cut_streams_raise():
    whole = b"WARC/1.0\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert list(warc.parse(io.BytesIO(whole + whole))) == [(whole[:31], b"abcd")] * 2
    for n in (12, 33):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(whole[:n])))


def test_no_pages(spark):
    assert warc.report(pages_of(spark, [])).count() == 0
