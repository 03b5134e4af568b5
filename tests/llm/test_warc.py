"""WARC archives: round trips over odd pages, and ranges cut anywhere."""

import gzip
import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import warc

SCHEMA = "page_id long, url string, html string"


def test_odd_pages_come_back(spark, tmp_path):
    rng = random.Random(1)
    long_one = "<p>ü</p>" * 300
    pages = [(1, "http://a/\r\nx", long_one), (2, None, long_one), (7, "u", long_one), (None, "u", long_one), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
             (8, "u", "x" * 999), (9, "u", "x" * 999), (10, "u", "y" * 1000), (11, "u", "y" * 1000), (11, "u", "y" * 1000), (12, "u", "".join(chr(rng.randint(32, 0xD7FF)) for _ in range(200_000))),
             (13, "u", "WARC/1.1\r\n\r\n" + gzip.compress(b"WARC/1.0\r\n" * 50).decode("latin-1"))]
    df = spark.createDataFrame(pages, SCHEMA).repartition(3)
    made = warc.write_archives(df, str(tmp_path / "a"), archive_bytes=5000)
    for size in (500, 5000, 1 << 20):
        rows = warc.read_archives(made, str(tmp_path / "a"), size, payloads=True).collect()
        want = []
        for i, _, html in pages:
            body = (html or "").encode()
            same = [j for j, _, h in pages if j is not None and (h or "").encode() == body]
            last = max(same) if len(body) >= 1000 and i is not None and i < max(same) else None
            want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if last else "response", last, None if last else body))
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in rows]
        assert sorted(map(str, got)) == sorted(map(str, want))


def members(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        body = bytes(rng.randbytes(rng.randint(0, 3000)) if i % 2 else b"<html>" + warc.MAGIC * rng.randint(0, 50))
        out.append(warc.record(i, "u", body, hashlib.sha1(body).hexdigest(), None))
    return out


@pytest.mark.parametrize("step", [97, 1000, 10**9])
def test_every_record_belongs_to_one_range(step):
    data = b"".join(members(60))
    source = pa.BufferReader(data)
    found = [warc.parsed(x)["page_id"] for at in range(0, len(data), step) for x in warc.records_in(source, len(data), at, min(len(data), at + step))]
    assert found == list(range(60))


def test_look_alikes_and_damage():
    good = members(4)
    noise = warc.MAGIC + b"\0" * 40
    data = noise + good[0] + noise + good[1]
    assert [warc.parsed(x)["page_id"] for x in warc.records_in(pa.BufferReader(data), len(data), 0, len(data))] == [0, 1]
    with pytest.raises(ValueError, match="cut off|can't be decoded"):
        list(warc.records_in(pa.BufferReader(good[3][:-9]), len(good[3]) - 9, 0, len(good[3]) - 9))


def test_no_pages(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.read_archives(warc.write_archives(empty, str(tmp_path / "b")), str(tmp_path / "b")).collect() == []


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(5)
    pages = spark.createDataFrame([(i, "u", rng.randbytes(2000).hex()) for i in range(300)], SCHEMA).coalesce(1)
    made = warc.write_archives(pages, str(tmp_path / "a"))
    assert made.count() == 1  # one file
    read = warc.read_archives(made, str(tmp_path / "a"), range_bytes=20_000)
    parts = read.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 300 and len(parts) >= 8


def test_clashing_columns_are_ignored(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 1200, "y", 5), (2, "u", "x" * 1200, None, None)], SCHEMA + ", digest string, size long").withColumn("path", F.lit("p")).withColumn("refers_to", F.lit(9))
    got = {r.page_id: r.refers_to for r in warc.read_archives(warc.write_archives(pages, str(tmp_path / "c")), str(tmp_path / "c")).collect()}
    assert got == {1: 2, 2: None}
