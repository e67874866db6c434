"""WARC archives: writer, normaliser of monolithic gzip files, reader.

Many archives in the wild are one gzip stream over the whole file, so a record
can only be reached by inflating all before it. The normaliser inflates such a
stream once, piece by piece, writes every record as a gzip member of its own,
and writes a sidecar table with the offset and length of each member. The
reader takes the records by that index.

All files are written and read by Spark, so they can be in any store. A
monolithic archive is a gzip text file of records (the line end of the text
writer is the end of the record). A normalised archive is one binary row
written as text with a zero byte as its line end: zero padding after the last
member, which gzip readers accept. Archives hold ``records_per_archive`` records
at most, and each is one row of one task.

Records with equal payloads of ``least_bytes`` or more are stored once: that
with the largest id is the response, the others revisit it. Equal payloads are
found by digest: partial maxima per task, so a payload that a third of all
pages share costs one row per task.

Edge cases. Null payload: empty. Null url: no target URI; control characters in
it are percent-encoded. A null id is written as such; its record is a response
if no equal payload has an id. Rows that repeat the largest id are all
responses. An empty table gives empty archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm.common import broadcast_if_small, table, utf8
from commitlens.session import work_dir

RECORDS_PER_ARCHIVE = 1000
DATE = "1970-01-01T00:00:00Z"
#: Most rows (digest and id) that are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Most index entries (16 bytes each) that are broadcast to the archives, likewise.
BROADCAST_ENTRIES = 1_000_000
CONTROL = re.compile(r"[\x00-\x20\x7f]")
RECORD_ID = "urn:x-page:"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_of(page_id, url, payload: str, response_id=None, is_revisit: bool = False, date: str = DATE) -> str:
    """A record without its last line end (the writer adds it)."""
    raw = payload.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}\r\n\r\n"
    name = "null" if page_id is None else page_id
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <{RECORD_ID}{name}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest_of(raw)}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD_ID}{response_id}>"]
    block = http if is_revisit else http + payload
    head.append(f"Content-Length: {len(block.encode())}")
    return "\r\n".join(head) + "\r\n\r\n" + block + "\r\n"


def headers_of(record: bytes) -> tuple[dict[str, str], int]:
    """Header fields in lower case, and where the block begins."""
    end = record.index(b"\r\n\r\n")
    lines = record[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}, end + 4


def inflated(stream: bytes):
    """The inflated bytes of all members, in pieces."""
    rest = memoryview(stream)
    while len(rest):
        inflate = zlib.decompressobj(31)
        while len(rest) and not inflate.eof:
            piece, rest = rest[:1 << 16], rest[1 << 16:]
            yield inflate.decompress(piece)
        if not inflate.eof:
            raise ValueError("an archive ends inside a member")
        if inflate.unused_data:
            rest = memoryview(inflate.unused_data + bytes(rest))
        if len(rest) and not rest[0]:  # zero padding
            rest = memoryview(bytes(rest).lstrip(b"\0"))


def records_in(stream: bytes):
    """The records of an archive, however many gzip members it has, inflated
    once; no more than one record and one piece are held."""
    held = bytearray()
    for piece in inflated(stream):
        held += piece
        at = 0
        while True:
            while at < len(held) and held[at] in b"\r\n":
                at += 1
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            fields, body = headers_of(bytes(held[at:end + 4]))
            stop = at + body + int(fields["content-length"]) + 4
            if len(held) < stop:
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held.strip(b"\r\n"):
        raise ValueError("an archive ends inside a record")


def normalised(stream: bytes) -> tuple[bytes, list[dict]]:
    """The archive with one member per record, and its index."""
    out, index, at = [], [], 0
    for record in records_in(stream):
        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = deflate.compress(record) + deflate.flush()
        fields, _ = headers_of(record)
        index.append({"offset": at, "length": len(member), "record_id": fields["warc-record-id"], "type": fields["warc-type"]})
        out.append(member)
        at += len(member)
    return b"".join(out), index


def deduplicated(pages: DataFrame, id_col: str, text_col: str, least_bytes: int) -> DataFrame:
    """``pages`` with ``_response``: the id to revisit, null for responses."""
    payload = utf8(text_col)
    keyed = pages.withColumn("_key", F.when(F.length(payload) >= least_bytes, F.unhex(F.sha1(payload))))
    same = keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.max(id_col).alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = keyed.join(broadcast_if_small(same, same.count(), BROADCAST_ROWS), "_key", "left")
    own = F.col(f"`{id_col}`")
    return joined.withColumn("_response", F.when(own.isNull() | (own != F.col("_last")), F.col("_last"))).drop("_key", "_last")


def write_monolithic(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
                     least_bytes: int = 0, records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Write a record per row into gzip archives (one stream each)."""
    known = deduplicated(pages.select(id_col, url_col, text_col), id_col, text_col, least_bytes)

    def build(ids: pd.Series, urls: pd.Series, texts: pd.Series, responses: pd.Series) -> pd.Series:
        return pd.Series([record_of(i, u, t or "", r, r is not None) for i, u, t, r in zip(ids, urls, texts, responses)], dtype=object)

    as_text = lambda c: F.col(f"`{c}`").cast("string")
    records = known.select(F.pandas_udf(build, "string")(as_text(id_col), as_text(url_col), as_text(text_col), as_text("_response")))
    records.write.option("compression", "gzip").option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_archive).text(path)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def normalise(spark: SparkSession, path: str, out: str) -> None:
    """Rewrite the archives under ``path``: ``out``/archives has one folder
    per archive, ``out``/index the sidecar table."""
    def rewrite(batches):
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                archive, index = normalised(content)
                name = hashlib.sha1(name.rsplit("/", 1)[-1].encode()).hexdigest()
                yield pa.RecordBatch.from_pylist([{"archive": name, "content": archive, "index": index}], schema=kind)

    entry = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string())])
    kind = pa.schema([("archive", pa.string()), ("content", pa.binary()), ("index", pa.list_(entry))])
    done = _archives(spark, path).select("path", "content").mapInArrow(
        rewrite, "archive string, content binary, index array<struct<offset bigint, length bigint, record_id string, type string>>")
    done.write.parquet(f"{out}/normalised")
    done = spark.read.schema(done.schema).parquet(f"{out}/normalised")
    done.select("archive", F.col("content").cast("string")).write.option("lineSep", "\0").partitionBy("archive").text(f"{out}/archives")
    done.select("archive", F.inline("index")).write.parquet(f"{out}/index")


READ = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload binary"


def read_records(spark: SparkSession, out: str) -> DataFrame:
    """The records of normalised archives, each taken by its index entry."""
    entries = spark.read.schema("archive string, offset bigint, length bigint, record_id string, type string").parquet(f"{out}/index")
    index = entries.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("entries"))
    index = broadcast_if_small(index, entries.count(), BROADCAST_ENTRIES)
    archives = _archives(spark, f"{out}/archives").select(F.regexp_extract("path", "archive=([0-9a-f]+)", 1).alias("archive"), "content")
    page = lambda uri: None if uri is None or uri == f"<{RECORD_ID}null>" else uri[len(RECORD_ID) + 1:-1]

    def take(batches):
        for batch in batches:
            for entries, content in zip(batch["entries"].to_pylist(), batch["content"].to_pylist()):
                rows = []
                for e in entries:
                    record = zlib.decompress(content[e["offset"]:e["offset"] + e["length"]], 31)
                    fields, body = headers_of(record)
                    block = record[body:body + int(fields["content-length"])]
                    revisit = fields["warc-type"] == "revisit"
                    rows.append((page(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], page(fields.get("warc-refers-to")),
                                 fields["warc-payload-digest"].removeprefix("sha1:"), None if revisit else block[block.index(b"\r\n\r\n") + 4:]))
                names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"]
                kinds = [pa.string()] * 5 + [pa.binary()]
                for i in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i:i + 500]), kinds)], names)

    return archives.join(index, "archive").select("entries", "content").mapInArrow(take, READ)


def resolved(records: DataFrame) -> DataFrame:
    """One row per record with the size of its full payload: a revisit has
    that of its response."""
    sized = records.withColumn("payload_bytes", F.length("payload").cast("bigint")).drop("payload")
    whole = sized.where("record_type = 'response'")
    of_response = whole.select(F.col("page_id").alias("refers_to"), F.col("payload_digest"), F.col("payload_bytes").alias("_bytes")).dropDuplicates(["refers_to", "payload_digest"])
    return sized.join(of_response, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "_bytes")).drop("_bytes")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "warc")
    write_monolithic(table(spark, sf_dir, "pages"), f"{out}/monolithic")
    normalise(spark, f"{out}/monolithic", out)
    read = resolved(read_records(spark, out))
    return read.select(F.col("page_id").cast("bigint"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c:
        (['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'])[strpos('0123456789abcdef', c)]), '') AS bits,
        max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
      + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last OR last IS NULL THEN NULL ELSE last END AS refers_to
FROM b
"""
