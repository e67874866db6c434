"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard
rotations, multiprobe buckets, verified candidates.

Hashing. A function turns the vector (padded to a power of two) by three rounds
of random signs and a fast Hadamard transform, and takes the corner of the
cross-polytope nearest to it: the coordinate of the greatest size, with its
sign. A table joins ``width`` functions into one bucket; a vector has its home
bucket in each table and probes those reached by the next best corners, best
first. The width grows with the logarithm of the number of vectors, so that
unrelated vectors rarely meet; the number of tables follows from it: that at
which pairs exactly at the threshold meet with the asked recall, found on
generated pairs (:func:`tables_needed`), not on the data.

What moves. Identical vectors become one class with a weight. Entries are
(bucket, id); buckets are counted with partial sums, and only entries of buckets
in which two unlike vectors meet take their vectors along.

Large groups. Where over ``HOT`` vectors have one home in the first table, the
mean direction of the bucket is the centre of a core: vectors within half the
threshold's angle of it are linked with each other, without looking at a pair.
A core is counted by sums and connected by a star. What else meets in a bucket of over ``BLOCK``
entries is compared in blocks: blocks of free vectors with each other, and with
those of cores; pairs of one core meet nowhere. Only counts and a spanning
forest leave a block, never its pairs.

Each link is counted in one place: the first table in which the two meet, there
the home bucket of both, else that one of them has and the other probes (of two
such, that of the smaller id). The places of a pair are computed from its vectors.

Results. Every returned link has a cosine of at least the threshold, in double
precision. The core margin is ``MARGIN`` radians, so rounding can't add a link.

Edge cases. Vectors that are null, empty, zero or hold null or non-finite
components link with nothing, nor do vectors of different lengths. Rows without
an id link with nothing and are returned each, with a null component, not kept.
Repeated rows of an id give one row; of an id with several vectors the greatest
(in array order) counts. An empty table gives no rows. Other columns play no
part in :func:`link_vectors`, whatever their names, and stay in :func:`keep_one`.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.llm.common import broadcast_if_small, materialise, table
from commitlens.llm.components import connected_components

THRESHOLD, RECALL, PROBES, SEED = 0.95, 0.995, 8, 20_011
#: Corners tried of each function; buckets in which fewer than one in SPARSE entries meets an unrelated vector.
CORNERS, SPARSE = 3, 32
#: Home entries that make a bucket of the first table hot, entries compared in one block, margin of a core in radians.
HOT, BLOCK, MARGIN = 256, 512, 1e-6
#: Lengths of vectors whose tables the driver plans; those of others are planned in the tasks.
COMMON = 16
#: Rows up to which a counted table of bucket keys, or of centres, is broadcast.
SMALL_KEYS, SMALL_CENTRES = 200_000, 4_096


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of each column (a power of two long)."""
    size, n = x.shape
    step = 1
    while step < size:
        x = x.reshape(-1, 2, step, n)
        y = np.empty_like(x)
        np.add(x[:, 0], x[:, 1], out=y[:, 0])
        np.subtract(x[:, 0], x[:, 1], out=y[:, 1])
        x, step = y, 2 * step
    return x.reshape(size, n) / math.sqrt(size)


class Hasher:
    """Buckets of vectors of one length: ``tables`` of ``width`` functions."""

    def __init__(self, dim: int, width: int, tables: int, probes: int = PROBES):
        self.dim, self.width, self.tables, self.probes = dim, width, tables, probes
        self.size = 1 << max(0, dim - 1).bit_length()
        rng = np.random.default_rng([SEED, dim])
        self.signs = rng.choice([-1.0, 1.0], size=(tables, width, 3, self.size))
        corners = min(CORNERS, self.size)
        self.ways = np.array(list(itertools.product(range(corners), repeat=width)))
        self.corners = corners

    def codes(self, x: np.ndarray, tables: int | None = None) -> np.ndarray:
        """(rows, tables, 1 + probes) bucket numbers, the home first; no two
        tables share a number. Where there are fewer buckets to probe, the home
        is repeated."""
        n, used = len(x), tables or self.tables
        padded = np.zeros((self.size, n))
        padded[:self.dim] = x.T
        out = np.empty((n, used, 1 + self.probes), np.int64)
        top, all_rows = min(1 + self.probes, len(self.ways)), np.arange(n)
        for t in range(used):
            loss, code = np.zeros((n, len(self.ways))), np.zeros((n, len(self.ways)), np.int64)
            for k in range(self.width):
                c = padded
                for s in self.signs[t, k]:
                    c = hadamard(c * s[:, None])
                size = np.abs(c)
                symbol, best = np.empty((n, self.corners), np.int64), np.empty((n, self.corners))
                for j in range(self.corners):  # the largest coordinates, one after the other
                    at = size.argmax(axis=0)
                    symbol[:, j], best[:, j] = 2 * at + (c[at, all_rows] < 0), size[at, all_rows]
                    size[at, all_rows] = -1
                way = self.ways[:, k]
                loss += ((best[:, :1] - best) ** 2)[:, way]
                code = code * (2 * self.size) + symbol[:, way]
            # the home has loss 0 and is first among equals
            pick = np.argsort(loss, axis=1, kind="stable")[:, :top]
            got = np.take_along_axis(code, pick, 1) * self.tables + t
            out[:, t, :top], out[:, t, top:] = got, got[:, :1]
        return out


def tables_needed(dim: int, width: int, threshold: float = THRESHOLD, recall: float = RECALL, probes: int = PROBES, pairs: int = 2_000) -> tuple[int, float]:
    """(tables, chance in one table) for pairs exactly at the threshold."""
    if dim == 1:
        return 1, 1.0
    rng = np.random.default_rng([SEED, dim, width])
    x = rng.normal(size=(pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(pairs, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    hasher = Hasher(dim, width, 2, probes)
    a, b = hasher.codes(x), hasher.codes(threshold * x + math.sqrt(max(0.0, 1 - threshold ** 2)) * z)
    met = (a == b[:, :, :1]).any(axis=2) | (b == a[:, :, :1]).any(axis=2)
    chance = min(float(met.mean()), 1 - 1e-9)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - max(chance, 1e-3)))), chance


def hasher_for(dim: int, vectors: int, threshold: float = THRESHOLD, recall: float = RECALL, probes: int = PROBES) -> Hasher:
    """The narrowest table in which unrelated vectors rarely meet, unless pairs
    at the threshold then meet in fewer than one in five tables."""
    symbols = 2 * (1 << max(0, dim - 1).bit_length())
    most = max(1, 52 // max(1, symbols.bit_length() - 1))  # the bucket number has 63 bits
    width = min(most, 8, max(1, math.ceil(math.log(SPARSE * max(2, vectors)) / math.log(symbols))))
    while True:
        tables, chance = tables_needed(dim, width, threshold, recall, probes)
        if chance >= 0.2 or width == 1:
            return Hasher(dim, width, tables, probes)
        width -= 1


class Hashers(dict):
    """A hasher for each length of vector a task sees; ``known`` has the width
    and the tables of the commonest lengths."""

    def __init__(self, given: tuple, known: dict[int, tuple[int, int]]):
        super().__init__()
        self.given, self.known = given, known

    def __reduce__(self):
        return Hashers, (self.given, self.known)

    def __missing__(self, dim: int) -> Hasher:
        self[dim] = Hasher(dim, *self.known[dim], self.given[-1]) if dim in self.known else hasher_for(dim, *self.given)
        return self[dim]


def hashers_of(classes: DataFrame, threshold: float, recall: float, probes: int) -> Hashers:
    lengths = classes.groupBy(F.size("vec").alias("dim")).count()
    given = (lengths.agg(F.sum("count")).first()[0] or 0, threshold, recall, probes)
    common = [r["dim"] for r in lengths.orderBy(F.desc("count"), "dim").limit(COMMON).collect()]
    return Hashers(given, {d: (h.width, h.tables) for d in common for h in [hasher_for(d, *given)]})


def matrices(column: pa.Array):
    """(length, rows, matrix in double precision) of the lists of a column, by length."""
    lengths = np.diff(column.offsets.to_numpy())
    values, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield int(dim), rows, values[starts[rows][:, None] + np.arange(dim)].astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Directions; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def column_of(batch, name: str) -> pa.Array:
    column = batch.column(name) if isinstance(batch, pa.RecordBatch) else batch[name].combine_chunks()
    return column


ENTRY = "dim int, bucket bigint, id bigint, home boolean, core bigint"


def entries(classes: DataFrame, hashers: Hashers, tables: int | None = None) -> DataFrame:
    """(dim, bucket, id, home, core): the home and the probes of each
    class in each table (or the first ``tables``)."""
    def hashed(batches):
        for batch in batches:
            ids, cores = batch.column("id"), batch.column("core")
            for dim, rows, x in matrices(batch.column("vec")):
                for i in range(0, len(rows), 1_000):
                    own = rows[i:i + 1_000]
                    codes = hashers[dim].codes(unit(x[i:i + 1_000]), tables)
                    n, used, k = codes.shape
                    probe = codes != codes[:, :, :1]
                    probe[:, :, 0] = True  # the home; repeats of it are no probes
                    at, place, j = np.nonzero(probe)
                    take = pa.array(own[at])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), dim, np.int32)), pa.array(codes[at, place, j]), ids.take(take), pa.array(j == 0), cores.take(take)],
                        ["dim", "bucket", "id", "home", "core"])

    return classes.select("id", "vec", "core").mapInArrow(hashed, ENTRY)


def cores_of(classes: DataFrame, hashers: Hashers, threshold: float, hot: int) -> DataFrame | None:
    """(id, core) of the classes in the core of a hot bucket, None without one."""
    first = entries(classes, hashers, 1).drop("core")
    busy = materialise(first.where("home").groupBy("dim", "bucket").count().where(F.col("count") > hot), "vectors-hot")
    n = busy.count()
    if not n:
        return None
    near = first.join(broadcast_if_small(busy.select("dim", "bucket"), n, SMALL_KEYS), ["dim", "bucket"]) \
        .join(classes.select("id", "vec"), "id")

    def sums(batches):
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            for dim, rows, x in matrices(batch.column("vec")):
                own, at = np.unique(buckets[rows], return_inverse=True)
                total = np.zeros((len(own), dim))
                np.add.at(total, at, unit(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), dim, np.int32)), pa.array(own), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                                 ["dim", "bucket", "total"])

    parts = near.where("home").select("bucket", "vec").mapInArrow(sums, "dim int, bucket bigint, total array<double>")
    centres = parts.select("dim", "bucket", F.posexplode("total").alias("k", "x")).groupBy("dim", "bucket", "k").agg(F.sum("x").alias("x")) \
        .groupBy("dim", "bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("centre"))
    limit = math.cos(math.acos(threshold) / 2 - MARGIN)

    def inside(batches):
        for batch in batches:
            buckets, ids, centres_ = batch.column("bucket"), batch.column("id"), batch.column("centre")
            for _, rows, x in matrices(batch.column("vec")):
                c = np.array(centres_.take(pa.array(rows)).to_pylist(), np.float64)
                good = np.abs(c).max(axis=1) > 0
                cos = np.full(len(rows), -1.0)
                cos[good] = (unit(x[good]) * unit(c[good])).sum(axis=1)
                keep = cos >= limit
                take = pa.array(rows[keep])
                yield pa.RecordBatch.from_arrays([ids.take(take), buckets.take(take), pa.array(cos[keep])], ["id", "core", "cos"])

    close = near.join(broadcast_if_small(centres, n, SMALL_CENTRES), ["dim", "bucket"]).select("id", "bucket", "vec", "centre") \
        .mapInArrow(inside, "id bigint, core bigint, cos double")
    return close.groupBy("id").agg(F.max_by("core", F.struct("cos", -F.col("core"))).alias("core"))


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the smallest row reachable."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def links_within(ids, x, weights, cores, homes, parts, one_part: bool, place: int, hasher: Hasher, threshold: float):
    """(rows, links, root rows) of the links of a block that are counted here."""
    n = len(ids)
    norms = np.sqrt((x * x).sum(axis=1))
    linked = (x @ x.T) / (norms[:, None] * norms[None, :]) >= threshold
    linked &= homes[:, None] | homes[None, :]
    linked &= (cores[:, None] != cores[None, :]) | (cores[:, None] < 0)
    if not one_part:
        linked &= parts[:, None] != parts[None, :]
    i, j = np.nonzero(np.triu(linked, 1))
    if not len(i):
        return None
    some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    codes = hasher.codes(unit(x[some]))
    a, b = at[:len(i)], at[len(i):]
    here = np.ones(len(i), bool)
    for t in range(place):
        here &= ~((codes[a, t] == codes[b, t, :1]).any(axis=1) | (codes[b, t] == codes[a, t, :1]).any(axis=1))
    both, swap = homes[i] & homes[j], (ids[i] < ids[j]) != homes[i]  # swap: the smaller id is the one that probes
    mutual = (codes[a, place] == codes[b, place, :1]).any(axis=1) & (codes[b, place] == codes[a, place, :1]).any(axis=1)
    here &= both | ~(mutual & swap)
    i, j = i[here], j[here]
    if not len(i):
        return None
    own = np.zeros((n, n), bool)
    own[i, j] = own[j, i] = True
    rows = np.unique(np.concatenate([i, j]))
    order = np.argsort(ids[rows], kind="stable")  # the smallest id is the root
    rows = rows[order]
    own = own[np.ix_(rows, rows)]
    return rows, own @ weights[rows], rows[forest(own)]


BLOCK_KEY = ["dim", "bucket", "block"]


def compare(blocks: DataFrame, hashers: Hashers, threshold: float) -> DataFrame:
    """(id, links, root) of the members of each block that have links there."""
    columns = [*BLOCK_KEY, "one_part", "part", "id", "weight", "core", "home", "vec"]

    def done(rows: pa.Table):
        dims, buckets = rows["dim"].to_numpy(), rows["bucket"].to_numpy()
        keys = np.stack([dims, buckets, rows["block"].to_numpy()])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        ids, weights, homes = (rows[c].to_numpy() for c in ("id", "weight", "home"))
        cored, parts, one = rows["core"].is_valid().to_numpy(), rows["part"].to_numpy(), rows["one_part"].to_numpy()
        core_values = rows["core"].fill_null(0).to_numpy()
        vec = column_of(rows, "vec")
        values, starts = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
        out = ([], [], [])
        for a, b in itertools.pairwise([0, *cuts.tolist(), len(ids)]):
            dim = int(dims[a])
            x = values[starts[a]:starts[b]].reshape(b - a, dim).astype(np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            _, cores = np.unique(core_values[a:b], return_inverse=True)
            found = links_within(ids[a:b], x, weights[a:b], np.where(cored[a:b], cores, -1), homes[a:b], parts[a:b], bool(one[a]),
                                 int(buckets[a]) % hashers[dim].tables, hashers[dim], threshold)
            if found:
                out[0].append(ids[a:b][found[0]])
                out[1].append(found[1])
                out[2].append(ids[a:b][found[2]])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["id", "links", "root"])

    def stream(batches):
        held = []  # the rows of the last block so far, which may go on
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            key = [rows[c][len(rows) - 1].as_py() for c in BLOCK_KEY]
            first = [rows[c][0].as_py() for c in BLOCK_KEY]
            if key == first:
                continue
            same = np.ones(len(rows), bool)
            for c, k in zip(BLOCK_KEY, key):
                same &= rows[c].to_numpy() == k
            cut = int(np.flatnonzero(~same)[-1]) + 1
            yield from done(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    return blocks.select(*columns).repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY).mapInArrow(stream, "id bigint, links bigint, root bigint")


def blocks_of(live: DataFrame, block: int) -> DataFrame:
    """Entries by block: a bucket of up to ``block`` entries is one; in a larger
    one, parts of free vectors meet each other and those of cores, and parts of
    cores each other only if there are several cores."""
    n = lambda c: F.ceil(F.col(c) / block).cast("int")
    one = F.col("free") + F.col("cored") <= block
    own = F.pmod(F.xxhash64("id"), F.greatest(F.when(F.col("core").isNull(), n("free")).otherwise(n("cored")), F.lit(1))).cast("int")
    split = live.withColumn("one_part", one).withColumn("free_parts", n("free")).withColumn("core_parts", n("cored")) \
        .withColumn("part", F.when(one, 0).when(F.col("core").isNull(), own).otherwise(F.col("free_parts") + own))
    others = F.when(one, F.array(F.lit(0))).when(F.col("core").isNull() | F.col("several"), F.sequence(F.lit(0), F.col("free_parts") + F.col("core_parts") - 1)) \
        .when(F.col("free_parts") > 0, F.sequence(F.lit(0), F.col("free_parts") - 1)).otherwise(F.array().cast("array<int>"))
    met = split.withColumn("other", F.explode(others))
    low, high = F.least("part", "other").cast("bigint"), F.greatest("part", "other").cast("bigint")
    return met.withColumn("block", F.shiftleft(low, 32) + high).withColumn("one_part", F.col("part") == F.col("other")) \
        .withColumn("one_part", F.col("block") == F.shiftleft(low, 32) + low)


def link_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL,
                 probes: int = PROBES, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(``id_col``, n_links, component_id): other vectors linked with each
    directly, and the smallest id reachable."""
    element = df.schema[vec_col].dataType.elementType
    kind = "array<float>" if isinstance(element, T.FloatType) else "array<double>"
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").cast(kind).alias("vec"))
    one = materialise(rows.where("id IS NOT NULL").groupBy("id").agg(F.max("vec").alias("vec")), "vectors")
    usable = one.where("size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vec, x -> x <> 0)")
    classes = materialise(usable.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("weight")).withColumn("core", F.lit(None).cast("bigint")), "vector-classes")
    hashers = hashers_of(classes, threshold, recall, probes)
    own = cores_of(classes, hashers, threshold, hot)
    if own is not None:
        classes = materialise(classes.drop("core").join(own, "id", "left"), "vector-cores")

    found = entries(classes, hashers)
    key = ["dim", "bucket"]
    counts = found.groupBy(*key).agg(F.count("*").alias("n"), F.count("core").alias("cored"), F.min("core").alias("low"), F.max("core").alias("high"), F.max("home").alias("at_home"))
    live_keys = materialise(counts.where("at_home AND n > 1 AND (cored < n OR low < high)")
                            .select(*key, (F.col("n") - F.col("cored")).alias("free"), "cored", F.coalesce(F.col("low") < F.col("high"), F.lit(False)).alias("several")), "vector-buckets")
    live = found.join(broadcast_if_small(live_keys, live_keys.count(), SMALL_KEYS), key)
    blocks = blocks_of(live.join(classes.select("id", "vec", "weight"), "id"), block)
    links = materialise(compare(blocks, hashers, threshold), "vector-links")

    cores = classes.where("core IS NOT NULL").select("core", F.size("vec").alias("dim"), "id", "weight")
    core_sums = cores.groupBy("dim", "core").agg(F.sum("weight").alias("all"), F.min("id").alias("root"))
    in_core = cores.join(core_sums, ["dim", "core"]).select("id", (F.col("all") - F.col("weight")).alias("links"), "root")
    per_class = links.union(in_core).groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(links.union(in_core).select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = classes.select("id", "vec", "weight").join(per_class, "id", "left").join(component, "id", "left") \
        .select(F.col("id").alias("class"), "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "id").alias("component"), "weight")
    # only classes of several vectors have to be looked up by their vector
    alone = classes.where("weight = 1").select(F.col("class").alias("id"), "links", "component")
    shared = classes.where("weight > 1").select("vec", "links", "component")
    copies = usable.join(shared, "vec").select("id", "links", "component")
    known = one.select("id").join(alone.union(copies), "id", "left") \
        .select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    nameless = rows.where("id IS NULL").select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("component_id"))
    return known.union(nameless)


def keep_one(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **settings) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its component, all columns."""
    done = link_vectors(df, id_col, vec_col, **settings).toDF("id", "n_links", "component")
    kept = done.where("id = component").select("id")
    return df.join(kept, df[f"`{id_col}`"].cast("bigint") == kept["id"], "left_semi")


def op13_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    done = link_vectors(table(spark, sf_dir, "embeddings"))
    return done.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: DuckDB: all pairs.
OP13_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, max(CAST(embedding AS DOUBLE[])) AS e FROM embeddings WHERE vec_id IS NOT NULL GROUP BY vec_id),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT id, b FROM reach JOIN links ON c = a)
SELECT id AS vec_id, CAST((SELECT count(*) FROM links WHERE a = id) AS BIGINT) AS n_links, min(c) AS component_id, min(c) = id AS kept FROM reach GROUP BY id"""
