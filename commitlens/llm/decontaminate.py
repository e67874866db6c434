"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ``window`` consecutive benchmark words (an item with
fewer words is one shorter pattern). Symbols are words, a block is the last
two words (one for one-word patterns). For each pattern length there is a
shift table from block to the distance of its last occurrence from the end of
any pattern: a block that is unknown moves the search by the whole length
less the block, so most words of a clean text are never looked at. A shift of
0 selects the bucket of patterns that end in the block, and the words are
compared directly.

The tables hold the benchmark only. Its words are counted first. Up to
``shard_words`` of them are one broadcast, and the documents are searched in their
scan. A larger benchmark is dealt to shards by item; a task builds the tables of
each shard and writes them, and the documents are searched once per shard, with
that shard alone in memory, each pass writing the hits it finds. Hits are merged by
the document's row. So what the driver and a task hold is one shard (or one longer
item), whatever the benchmark and the corpus.

Edge cases. Null or empty text: no words, nothing hit, not contaminated.
Items without words have no window; rows with equal item ids are one item; a
null item id marks hits but is not counted as an item. Repeated documents give repeated
results. Other columns of ``documents`` pass through.
"""

from __future__ import annotations

import pickle
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import ASCII_LOWER, materialise, table, utf8

WINDOW = 13
SHARD_WORDS = 4_000_000
#: As ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over code points, on UTF-8 bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(raw: bytes | None) -> list[bytes]:
    return WORD.findall(raw.translate(ASCII_LOWER)) if raw else []


def build_tables(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[tuple]:
    """(length, block, shift table, buckets) per pattern length; buckets: from
    block to {pattern: set of item ids}."""
    patterns: dict[int, dict[tuple, set]] = {}
    for item, raw in items:
        words = words_of(raw)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            patterns.setdefault(size, {}).setdefault(tuple(words[i:i + size]), set()).add(item)
    tables = []
    for size, own in sorted(patterns.items()):
        block = min(2, size)
        shift: dict[tuple, int] = {}
        buckets: dict[tuple, dict] = {}
        for pattern, ids in own.items():
            for end in range(block, size + 1):
                key = pattern[end - block:end]
                shift[key] = min(shift.get(key, size), size - end)
            buckets.setdefault(pattern[size - block:], {})[pattern] = frozenset(ids)
        tables.append((size, block, shift, buckets))
    return tables


def search(words: list[bytes], tables: list[tuple]) -> tuple[list[tuple[int, int]], set]:
    """Merged [start, end) word ranges inside occurrences, and the items."""
    ranges, items = [], set()
    n = len(words)
    for size, block, shift, buckets in tables:
        skip, end = size - block + 1, size
        while end <= n:
            key = tuple(words[end - block:end])
            step = shift.get(key, skip)
            if step == 0:
                found = buckets[key].get(tuple(words[end - size:end]))
                if found:
                    ranges.append((end - size, end))
                    items |= found
                step = 1
            end += step
    return merge_ranges(ranges), items


def merge_ranges(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _summary(n: int, ranges, items) -> tuple:
    hit = sum(b - a for a, b in ranges)
    listed = sorted(x for x in items if x is not None)
    return n, hit, len(listed), listed, [[a, b] for a, b in ranges], bool(hit and 20 * hit >= n)


KIND = "n_words bigint, n_hit bigint, n_items bigint, items array<string>, ranges array<array<bigint>>, contaminated boolean"
FIELDS = ["n_words", "n_hit", "n_items", "items", "ranges", "contaminated"]


def _search_column(shared, text_col: str):
    def scan(raws: pd.Series) -> pd.DataFrame:
        tables = shared.value
        rows = []
        for raw in raws:
            words = words_of(raw)
            rows.append(_summary(len(words), *search(words, tables)))
        return pd.DataFrame(rows, columns=FIELDS)

    return F.pandas_udf(scan, KIND)(utf8(text_col))


def _hits_column(shared):
    """The hits of a text by the tables of one shard."""
    def scan(raws: pd.Series) -> pd.DataFrame:
        found = [search(words_of(raw), shared.value) for raw in raws]
        return pd.DataFrame([([[a, b] for a, b in ranges], sorted(x for x in items if x is not None)) for ranges, items in found], columns=["ranges", "items"])

    return F.pandas_udf(scan, "ranges array<array<bigint>>, items array<string>")("raw")


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(i, t) of the distinct items, their texts as bytes."""
    return benchmark.select(F.col(f"`{id_col}`").cast("string").alias("i"), utf8(text_col).alias("t")).distinct()


def shard_count(items: DataFrame, shard_words: int) -> int:
    """Shards that the items' words need."""
    size = F.pandas_udf(lambda raws: raws.map(lambda r: len(words_of(r))).astype("int64"), "bigint")
    return max(1, -(-int(items.agg(F.sum(size("t"))).first()[0] or 0) // shard_words))


def written_tables(items: DataFrame, shards: int, window: int) -> DataFrame:
    """(shard, tables): the search tables of each shard, built in its task and written."""
    def build(own: pd.DataFrame) -> pd.DataFrame:
        pairs = [(i if isinstance(i, str) else None, bytes(t)) for i, t in zip(own["i"], own["t"])]
        return pd.DataFrame({"shard": [int(own["shard"].iloc[0])], "tables": [pickle.dumps(build_tables(pairs, window))]})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(shards)).cast("int"))
    return materialise(dealt.groupBy("shard").applyInPandas(build, "shard int, tables binary"), "benchmark-tables")


def _by_shards(docs: DataFrame, tables: DataFrame, text_col: str) -> DataFrame:
    """(row, contamination) of every row of ``docs``, the caller's columns in the
    struct ``row``: a pass over the documents per shard, each with its hits written."""
    sc = docs.sparkSession.sparkContext
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), utf8(text_col).alias("raw"))
    named = materialise(named.withColumn("at", F.monotonically_increasing_id()), "numbered")
    hits = None
    for shard in sorted(r["shard"] for r in tables.select("shard").collect()):
        shared = sc.broadcast(pickle.loads(bytes(tables.where(F.col("shard") == shard).first()["tables"])))
        own = materialise(named.select("at", _hits_column(shared).alias("h")).where("size(h.ranges) > 0"), "hits")
        hits = own if hits is None else hits.union(own)
        shared.destroy()
    none = named.select("at", F.lit(None).cast("struct<ranges:array<array<bigint>>,items:array<string>>").alias("h"))
    merged = (none.limit(0) if hits is None else hits).groupBy("at").agg(F.flatten(F.collect_list("h.ranges")).alias("ranges"), F.flatten(F.collect_list("h.items")).alias("items"))

    def merge(raws: pd.Series, ranges: pd.Series, items: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, r, i in zip(raws, ranges, items):
            own = [] if r is None else merge_ranges((int(a), int(b)) for a, b in r)
            rows.append(_summary(len(words_of(raw)), own, set() if i is None else set(i)))
        return pd.DataFrame(rows, columns=FIELDS)

    return named.join(merged, "at", "left").select("row", F.pandas_udf(merge, KIND)("raw", "ranges", "items").alias("contamination"))


def _searched(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
              window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(row, contamination) of every row of ``docs``; texts are never shuffled."""
    items = _items(benchmark, item_col, item_text_col)
    shards = shard_count(items, shard_words)
    if shards > 1:
        return _by_shards(docs, written_tables(items, shards, window), text_col)
    rows = [(r["i"], bytes(r["t"])) for r in items.collect()]  # at most shard_words words, or one longer item
    shared = docs.sparkSession.sparkContext.broadcast(build_tables(rows, window))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _search_column(shared, text_col).alias("contamination"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with the struct column ``contamination`` (an older one is replaced)."""
    return _searched(docs, benchmark, **options).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "contamination"], "contamination")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns unchanged."""
    clean = _searched(docs, benchmark, **options).where(~F.col("contamination")["contaminated"])
    return clean.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"),
                               table(spark, sf_dir, "benchmark"))
    c = "contamination"
    return found.select("doc_id", f"{c}.n_words", f"{c}.n_hit", f"{c}.n_items",
                        F.sha2(F.concat_ws(",", f"{c}.items"), 256).alias("items_sha256"), f"{c}.contaminated")


#: DuckDB: windows by list slices, joined to the documents' windows.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS pattern
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
x AS (
  SELECT k, size, s, array_to_string(w[s:s + size - 1], ' ') AS pattern
  FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS s
        FROM d, (SELECT DISTINCT size FROM p) WHERE len(w) >= size)),
h AS (SELECT x.k, x.s, x.size, p.item_id FROM x JOIN p USING (size, pattern)),
words AS (SELECT k, count(DISTINCT pos) AS n_hit FROM (SELECT k, unnest(range(s, s + size)) AS pos FROM h) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT k, item_id FROM h) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""
