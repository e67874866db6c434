import base64
import gzip
import hashlib
import zlib

import duckdb
import pytest

from commitlens.llm import warc as W
from commitlens.session import work_dir
from llm.conftest import SF, rows_of


def brute(rows):
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    last = {}
    for i, _, t in rows:
        if i is not None:
            last[digest(t)] = max(last.get(digest(t), i), i)
    out = []
    for i, _, t in rows:
        d = digest(t)
        revisit = d in last and i != last[d]
        out.append((i, len((t or "").encode()), d, "revisit" if revisit else "response", last[d] if revisit else None))
    return sorted(out, key=str)


def write_read(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = work_dir(spark, "test-warc")
    W.write_monolithic(df, f"{out}/monolithic", **options)
    W.normalise(spark, f"{out}/monolithic", out)
    return out, W.read_records(spark, out)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = sorted(con.execute(W.OP5_SQL).fetchall())
    got = sorted(tuple(r) for r in W.op5_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == want


ROWS = [(1, "http://a/x", "same"), (2, None, "same"), (3, "http://b/\r\nX: y", "same"), (4, "u", None), (5, "u", ""), (None, "u", "same"), (None, "u", "alone"),
        (6, "u", "WARC/1.0\r\n\r\nfake\r\n\r\n"), (7, "ü", "é😀" * 50_000), (8, "u", "\r\n\r\n"), (9, "u", "\n"), (9, "u", "\n")]


def test_odd_rows(spark):
    out, records = write_read(spark, ROWS, records_per_archive=3)
    got = [(r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in W.resolved(records).collect()]
    assert sorted(got, key=str) == brute(ROWS)
    payloads = {r.page_id: bytes(r.payload) for r in records.where("record_type = 'response'").collect()}
    for i in (3, 5, 6, 7, 8, 9):
        assert payloads[str(i)].decode() == next(t or "" for j, _, t in ROWS if j == i)
    assert {r.url for r in records.where("page_id = '3'").collect()} == {"http://b/%0D%0AX:%20y"}


def test_archives_and_index(spark):
    """Monolithic files are one gzip stream; normalised ones have a member
    per record, at the places the index names, and are valid gzip files."""
    out, _ = write_read(spark, ROWS[:6])
    whole = b"".join(gzip.decompress(bytes(r.content)) for r in W._archives(spark, f"{out}/monolithic").collect() if r.content)
    archives = {r.path.split("archive=")[1].split("/")[0]: bytes(r.content) for r in W._archives(spark, f"{out}/archives").collect()}
    assert sum(len(gzip.decompress(a)) for a in archives.values()) == len(whole)
    index = spark.read.parquet(f"{out}/index").collect()
    assert len(index) == 6
    for e in index:
        record = zlib.decompress(archives[e.archive][e.offset:e.offset + e.length], 31)
        assert record.startswith(b"WARC/1.0\r\nWARC-Type: " + e.type.encode()) and e.record_id.encode() in record


def test_short_payloads_stay_responses(spark):
    _, records = write_read(spark, ROWS[:6], least_bytes=5)
    assert {r.record_type for r in records.collect()} == {"response"}


def test_normaliser_takes_any_members(spark):
    records = [W.record_of(i, "u", "text" * i).encode() + b"\r\n" for i in range(5)]
    for stream in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records[:2])) + b"\0" * 5 + gzip.compress(b"".join(records[2:])) + b"\0"):
        assert [r.rstrip(b"\r\n") for r in W.records_in(stream)] == [r.rstrip(b"\r\n") for r in records]
        archive, index = W.normalised(stream)
        assert [zlib.decompress(archive[e["offset"]:e["offset"] + e["length"]], 31).rstrip(b"\r\n") for e in index] == [r.rstrip(b"\r\n") for r in records]
    with pytest.raises(ValueError):
        list(W.records_in(gzip.compress(records[0][:-10])))
    with pytest.raises(ValueError):
        list(W.records_in(gzip.compress(records[0])[:-20]))


def test_empty_table(spark):
    _, records = write_read(spark, [])
    assert W.resolved(records).collect() == []
