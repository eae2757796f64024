import base64
import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from stayline.llm import warc

KIND = "page_id long, url string, html string, path string, frame string"


def pages(spark, extra=()):
    rows = [(5, "http://a/x y\r\nz", "same"), (3, "http://b", "same"), (9, None, "same"), (9, None, "same"), (3, "http://b", "same"), (1, "u", None), (2, "u", ""), (4, "u", "ü\U0001f600\r\n\r\nWARC/1.1"), (6, "u", "long " * 200_000), (None, "u", "same"), (None, "u", "alone"), *extra]
    return spark.createDataFrame([(*r, "p", "f") for r in rows], KIND).repartition(3)


def brute(rows, least=0):
    out = []
    for r in rows:
        data = (r.html or "").encode()
        first = min((x.page_id for x in rows if (x.html or "").encode() == data and x.page_id is not None), default=None)
        again = len(data) >= least and r.page_id is not None and first < r.page_id
        out.append((r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    table = pages(spark)
    index = warc.write(table, least=least)
    got = warc.read(index).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == brute(table.collect(), least)
    want = {(r.html or "").encode() for r in table.collect()}
    assert {bytes(r.payload) for r in got if r.payload is not None} == want


def test_one_record_by_its_identifier(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 1000)
    rows = [(100 + i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(200)]
    index = warc.write(pages(spark, rows).coalesce(1))
    entry = index.where("record_id = '<urn:page:177>'").first()
    headers, block = warc.parsed(warc.frame(entry.path, entry.frame), entry.offset)
    assert headers["WARC-Target-URI"] == "http://h/77" and block.endswith(b"<p>77</p>" * 50)
    assert warc.read(index.where(F.col("record_id") == "<urn:page:177>")).first().payload == b"<p>77</p>" * 50
    assert len(warc.seek_table(entry.path)) > 1


def test_bundles_are_plain_zstandard_streams(spark):
    index = warc.write(pages(spark).coalesce(1))
    path = index.first().path.removeprefix("file:")
    with open("/" + path.lstrip("/"), "rb") as f:
        data = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    records, at = 0, 0
    while at < len(data):
        headers, block = warc.parsed(data, at)
        at = data.index(b"\r\n\r\n", at) + 4 + len(block) + 4
        records += 1
    assert records == 11


def test_empty(spark):
    index = warc.write(spark.createDataFrame([], KIND))
    assert index.collect() == [] and warc.read(index).collect() == []
