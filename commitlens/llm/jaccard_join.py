"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document is its set of distinct word shingles (64-bit hashes). Sizes fall
into bands such that two similar sets are in the same or neighbouring bands.
Similar sets of a band differ in at most H shingles, so when the universe of
shingles is dealt into m > H segments, the two sets agree in some segment.
Each set is therefore indexed by the contents of its segments, for its own
band and for the next one (as the smaller partner).

Allocation by cost. A segment with few shingles has a content that many
unrelated sets share, so it is the dearest to index. Every set indexes, in
this order and only as far as needed until the guarantees add up to H + 1:

0. segments of two or more shingles (guarantee 1 each);
1. segments of one shingle (1 each);
2. the one-deletion neighbourhoods of the segments of two or more (which then
   count 2: a partner missing there differs in two shingles at least);
3. empty segments (1 each).

The levels are nested, so of two sets the one with the lower level finds the
other's index entries, and no pair is lost. Nothing is capped: entries shared
by at most ``small`` sets give pairs; a parity sketch drops those that differ too much (it bounds
their differences from below); of the others, one pair of each document is
verified on the whole sets, then all those between documents not yet connected; larger ones are cut into blocks, and each pair of blocks is verified as
a whole (a product of membership matrices) and returns a spanning forest of
its links, never all pairs. Components then follow from the links.

Exact copies are collapsed first: only the document with the smallest id of
each text goes through the join.

Edge cases. Null or empty text, or no words: the empty set, linked with
nothing. Fewer words than a shingle: the whole sequence is the one shingle.
Rows with a null id are not linked and get a null component. Repeated ids are
one node. An empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commitlens.llm.common import ASCII_LOWER, broadcast_if_small, materialise, table, utf8
from commitlens.llm.components import connected_components

SHINGLE, THRESHOLD = 4, 85
SMALL, BLOCK = 16, 512
#: Most rows of ids that are broadcast (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = raw.translate(ASCII_LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:n - width + 1 + k])
    return np.unique(out)


class Bands:
    """Size bands for a threshold in per cent."""

    def __init__(self, threshold: int):
        self.threshold, self.starts = threshold, [1]

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * 100 // self.threshold + 1)
        return bisect.bisect_right(self.starts, n) - 1

    def most_differences(self, band: int) -> int:
        """Between similar sets whose larger one is in the band."""
        self.of(self.starts[-1] if band + 1 >= len(self.starts) else 1)
        largest = self.starts[band + 1] - 1
        return (100 - self.threshold) * 2 * largest // (100 + self.threshold)

    def smallest(self, band: int) -> int:
        """Size of the smallest set with a partner in the band."""
        return -(-self.threshold * self.starts[band] // 100)


def segments_for(need: int, smallest: int) -> int:
    """Segments such that even the smallest sets of a band have ``need`` that
    are not empty, by expectation and a margin: one-deletion neighbourhoods,
    the dearest entries, are then rarely called for."""
    m = need
    while need > 4 and m * (1 - math.exp(-smallest / m)) < need + 1.5 * math.sqrt(m * math.exp(-smallest / m)):
        m += 1 + m // 100
    return m


def signatures(members: np.ndarray, band: int, differences: int, smallest: int) -> np.ndarray:
    """Index entries of a set for the pairs of a band, whose sets have
    ``smallest`` members or more."""
    need = differences + 1
    m = segments_for(need, smallest)
    salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    spread = mix(members ^ salt)
    segment = ((spread >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    sizes = np.bincount(segment.astype(np.int64), minlength=m)
    content = np.zeros(m, np.uint64)
    order = np.argsort(segment, kind="stable")
    full = np.flatnonzero(sizes)
    content[full] = np.add.reduceat(spread[order], np.concatenate(([0], np.cumsum(sizes[full])[:-1])))
    seat = mix(np.arange(m, dtype=np.uint64) + salt)  # keeps equal contents of two segments apart
    entries = [mix(content[sizes >= 2] ^ seat[sizes >= 2])]
    got = len(entries[0])
    if got < need:
        one = sizes == 1
        entries.append(mix(content[one] ^ seat[one]))
        got += int(one.sum())
    if got < need:
        own = segment.astype(np.int64)
        many = sizes[own] >= 2
        entries.append(mix((content[own] - spread)[many] ^ seat[own][many]))
        got += int((sizes >= 2).sum())
    if got < need:
        entries.append(mix(seat[sizes == 0]))
    return np.concatenate(entries).view(np.int64)


def all_signatures(members: np.ndarray, bands: Bands) -> np.ndarray:
    n = len(members)
    if not n:
        return np.empty(0, np.int64)
    band = bands.of(n)
    return np.concatenate([signatures(members, b, bands.most_differences(b), bands.smallest(b)) for b in (band, band + 1)])


def linked(inter, size_a, size_b, threshold: int = THRESHOLD):
    return 100 * inter >= threshold * (size_a + size_b - inter)


def forest(sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets, by position."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    owner, code = owner[shared], code[shared]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    inter = np.zeros((n, n), np.float32)
    first = 0
    while first < len(code):  # at most 4096 shingles a time
        last = int(np.searchsorted(code, code[first] + 4096))
        block = np.zeros((n, 4096), np.float32)
        block[owner[first:last], code[first:last] - code[first]] = 1
        inter += block @ block.T
        first = last
    a, b = np.nonzero(np.triu(linked(inter.astype(np.int64), sizes[:, None], sizes[None, :], threshold), 1))
    parent, out = list(range(n)), []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(a.tolist(), b.tolist()):
        x, y = root(i), root(j)
        if x != y:
            parent[y] = x
            out.append((i, j))
    return out


def parity_sketch(members: np.ndarray) -> np.ndarray:
    """One bit per bucket of hashes, 2 to 4 buckets per member: whether an
    odd number of members falls into it. Each bit in which two sets differ is
    a difference of the sets, so the sketch bounds them from below."""
    bits = 1 << max(6, (2 * len(members) - 1).bit_length())
    return np.packbits(np.bincount((members >> np.uint64(24)).astype(np.int64) & (bits - 1), minlength=bits) & 1)


def least_differences(x: np.ndarray, y: np.ndarray) -> int:
    """From two sketches; the longer one is folded to the other's buckets."""
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def set_size_column(text_col: str, size: int = SHINGLE):
    return F.pandas_udf(lambda raws: raws.map(lambda r: len(shingle_set(r, size))).astype("int64"), "bigint")(utf8(text_col))


def copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rep) of the documents with words whose text an earlier id has too."""
    keys = docs.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{text_col}`").rlike(r"[^ \t\n\x0B\f\r]")) \
        .select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(utf8(text_col), 256)).alias("key"))
    reps = keys.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keys.join(reps, "key").where("id <> rep").select("id", "rep").distinct()


def similarity_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                     threshold: int = THRESHOLD, without: DataFrame | None = None, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose components are those of all links between the
    documents, less the ids in ``without`` (column ``id``)."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), utf8(text_col).alias("raw")).where("id IS NOT NULL")
    if without is not None:
        own = own.join(broadcast_if_small(without.select("id"), without.count(), BROADCAST_IDS), "id", "left_anti")
    id_type = own.schema["id"].dataType.simpleString()
    bands = Bands(threshold)

    def index(batches):
        for batch in batches:
            entries = [all_signatures(shingle_set(r, size), bands) for r in batch["raw"]]
            ids = np.repeat(batch["id"].to_numpy(), [len(e) for e in entries])
            flat = np.concatenate([*entries, np.empty(0, np.int64)])
            for i in range(0, len(flat), 500_000):
                yield pd.DataFrame({"sig": flat[i:i + 500_000], "id": ids[i:i + 500_000]})

    entries = own.mapInPandas(index, f"sig bigint, id {id_type}")
    partitions = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = entries.repartition(partitions, "sig")
    shared = materialise(entries.withColumn("n", F.count("*").over(Window.partitionBy("sig"))).where("n > 1"), "entries")

    few = shared.where(F.col("n") <= small).groupBy("sig").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    pairs = few.select("ids").where(F.size("ids") > 1).distinct().select(F.explode(F.flatten(F.transform(
        "ids", lambda x, i: F.transform(F.slice("ids", i + 2, small), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")) \
        .select("p.*").distinct()
    pairs = materialise(pairs, "pairs")
    many = shared.where(F.col("n") > small).distinct()

    wanted = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(many.select("id")).distinct(), "wanted")
    def describe(raws: pd.Series) -> pd.DataFrame:
        members = [shingle_set(r, size) for r in raws]
        pack = zstandard.ZstdCompressor(level=3).compress
        return pd.DataFrame({"n": [len(m) for m in members], "packed": [pack(r) for r in raws], "sketch": [parity_sketch(m).tobytes() for m in members]})

    sets = materialise(own.join(broadcast_if_small(wanted, wanted.count(), BROADCAST_IDS), "id", "left_semi").select(
        "id", F.pandas_udf(describe, "n bigint, packed binary, sketch binary")("raw").alias("s")).select("id", "s.*"), "sets")

    def side(end, *columns):
        return sets.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])

    def prune(batches):
        for batch in batches:
            keep = [(100 + threshold) * least_differences(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= (100 - threshold) * (n + m)
                    for x, y, n, m in zip(batch["a_sketch"], batch["b_sketch"], batch["a_n"], batch["b_n"])]
            yield batch.loc[keep, ["a", "b"]]

    def members(packed) -> np.ndarray:  # a packed text is a third of its hashes
        return shingle_set(zstandard.ZstdDecompressor().decompress(packed), size)

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["a_packed"], batch["b_packed"]):
                x, y = members(x), members(y)
                keep.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), threshold))
            yield batch.loc[keep, ["a", "b"]]

    def verified(some: DataFrame) -> DataFrame:
        return some.join(side("a", "packed"), "a").join(side("b", "packed"), "b").mapInPandas(verify, link)

    link = f"a {id_type}, b {id_type}"
    close = pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b") \
        .where(100 * F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n")).mapInPandas(prune, link)
    close = materialise(close, "close")
    # one pair of each document first; then only pairs that this has not connected
    first = connected_components(verified(close.groupBy("b").agg(F.min("a").alias("a"))))
    group = lambda end: first.select(F.col("id").alias(end), F.col("component").alias(f"{end}_group"))
    rest = close.join(group("a"), "a", "left").join(group("b"), "b", "left") \
        .where(F.coalesce("a_group", "a") != F.coalesce("b_group", "b")).select("a", "b")
    found = first.select(F.col("id").alias("a"), F.col("component").alias("b")).union(verified(rest))

    def verify_block(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["id"].tolist()
        tree = forest([members(m) for m in group["packed"]], threshold)
        return pd.DataFrame([(ids[i], ids[j]) for i, j in tree], columns=["a", "b"])

    parts = F.ceil(F.col("n") / block)
    dealt = many.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id"), "parts")) \
        .select("sig", "id", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other")) \
        .select("sig", "id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    blocks = dealt.join(sets.select("id", "packed"), "id").groupBy("sig", "i", "j").applyInPandas(verify_block, link)
    return found.union(blocks)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                   threshold: int = THRESHOLD) -> DataFrame:
    """(id, component) of every document that is linked to another one."""
    same = materialise(copies(docs, id_col, text_col), "copies")
    groups = connected_components(similarity_links(docs, id_col, text_col, size, threshold, without=same))
    roots = same.join(groups.withColumnRenamed("id", "rep"), "rep", "left") \
        .select("id", F.coalesce("component", "rep").alias("component"))
    return groups.union(roots)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` less the documents that are linked to one with a smaller id
    through others; columns unchanged."""
    gone = materialise(similar_groups(docs, id_col, text_col, size, threshold).where("id <> component").select(F.col("id").alias("_gone")), "gone")
    return docs.join(broadcast_if_small(gone, gone.count(), BROADCAST_IDS), docs[id_col] == gone["_gone"], "left_anti")


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = similar_groups(docs)
    groups = groups.withColumnRenamed("id", "doc_id")
    sized = docs.select("doc_id", set_size_column("text").alias("n_shingles"))
    return sized.join(groups, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
