"""A commit store that change batches rewrite only where they touch it.

Every table is cut into ranges of a hash of its key, so a key is in one range
and a hot repository or author pair spreads over all of them. A version of a
table is a manifest, one row per range, naming the version whose folder holds
the range:

    <dir>/<table>/data/version=V/range=R/...   written once, never overwritten
    <dir>/<table>/manifest/version=V/          the folder of each range
    <dir>/versions/version=V/                  written last: the version is whole

A batch reads the ranges its keys fall into, writes their new contents into the
folder of the next version and points the manifest there; all other ranges stay
the files they are. Derived tables follow by their deltas: the rows that a batch
changed, before and after, are written once and added to the counters of the
ranges they fall into. ``repos_loaded`` is a count of commits per repository and
the top contributors are kept with a reserve, so neither is recomputed from the
commits. A batch that fails leaves the last whole version as it was, and its
half-written folder is replaced by the next try.

The driver holds one number per range (``ranges`` of the store, at most a few
thousand), never a key or a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from commitlens import schemas as S
from commitlens.operators import changes as CH
from commitlens.operators import derive as D
from commitlens.session import read_if_exists, stored

#: Ranges of a store unless given, contributors of a repository that are reported and kept.
RANGES, TOP, RESERVE = 64, S.TOP_CONTRIBUTORS, 2 * S.TOP_CONTRIBUTORS

COUNT = T.StructField("commit_count", T.LongType())
REPO, AUTHOR = T.StructField("repo_name", T.StringType()), T.StructField("author_name", T.StringType())
BY_REPO = T.StructType([REPO] + [f for f in S.COMMITS.fields if f.name in ("commit_hash", "author_name", "subject", "num_files_changed")])
#: Table: (schema, key columns).
TABLES = {
    "commits": (S.COMMITS, ["commit_hash"]),
    "commits_by_repo": (BY_REPO, ["repo_name", "commit_hash"]),
    "author_counts": (T.StructType([REPO, AUTHOR, COUNT]), ["repo_name", "author_name"]),
    "repo_commits": (T.StructType([REPO, COUNT]), ["repo_name"]),
    "top_contributors": (T.StructType([REPO, AUTHOR, COUNT, T.StructField("floor_count", T.LongType()), T.StructField("floor_author", T.StringType())]), ["repo_name"]),
}


class RangedTable:
    """One table of the store. ``keys`` decide the range of a row."""

    def __init__(self, spark: SparkSession, base: str, name: str, ranges: int):
        self.spark, self.path, self.ranges = spark, f"{base.rstrip('/')}/{name}", ranges
        self.schema, self.keys = TABLES[name]

    def range_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.ranges)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The ranges that the keys of ``rows`` fall into."""
        return sorted(r[0] for r in rows.select(self.range_of()).distinct().collect())

    def manifest(self, version: int) -> dict[int, int]:
        rows = self.spark.read.schema("range int, folder bigint").parquet(f"{self.path}/manifest/version={version}")
        return {r["range"]: r["folder"] for r in rows.collect()}

    def read(self, version: int, ranges: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its ranges: other ranges are not listed."""
        held = self.manifest(version)
        paths = [f"{self.path}/data/version={held[r]}/range={r}" for r in (held if ranges is None else ranges) if r in held]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def write(self, rows: DataFrame, version: int, ranges: Sequence[int] | None = None) -> None:
        """Write the new contents of ``ranges`` (all without) as part of a version.
        A range that is too large for one task is written by several."""
        data = f"{self.path}/data/version={version}"
        names = self.schema.fieldNames()
        placed = rows.select(*names).withColumn("range", self.range_of())
        placed.hint("rebalance", "range").sortWithinPartitions("range", *self.keys).write.partitionBy("range").mode("overwrite") \
            .option(f"parquet.bloom.filter.enabled#{self.keys[-1]}", "true").parquet(data)
        written = [r[0] for r in self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("range", T.IntegerType())]))
                   .parquet(data).select("range").distinct().collect()]
        held = {} if ranges is None else self.manifest(version - 1)
        for r in ranges or ():
            held.pop(r, None)  # a range that is empty now has no folder
        held.update({r: version for r in written})
        self.spark.createDataFrame(sorted(held.items()), "range int, folder bigint").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")


class CommitStore:
    """The commit tables under a folder, by version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        marks = read_if_exists(spark, f"{self.path}/versions")
        if marks is None:
            raise FileNotFoundError(f"no store under {path}")
        last = marks.orderBy(F.desc("version")).first()
        self.version, self.ranges = int(last["version"]), int(last["ranges"])
        self.tables = {name: RangedTable(spark, self.path, name, self.ranges) for name in TABLES}

    @classmethod
    def create(cls, spark: SparkSession, path: str, commits: DataFrame, ranges: int = RANGES) -> CommitStore:
        """A store of a snapshot (one row per hash)."""
        path = path.rstrip("/")
        if read_if_exists(spark, f"{path}/versions") is not None:
            raise FileExistsError(f"there is a store under {path}")
        tables = {name: RangedTable(spark, path, name, ranges) for name in TABLES}
        tables["commits"].write(commits, 0)
        commits = tables["commits"].read(0)

        def counters() -> None:
            tables["author_counts"].write(D.author_counts(commits), 0)
            counts = tables["author_counts"].read(0)
            _together(lambda: tables["repo_commits"].write(counts.groupBy("repo_name").agg(F.sum("commit_count").cast("bigint").alias("commit_count")), 0),
                      lambda: tables["top_contributors"].write(with_floor(counts), 0))

        _together(lambda: tables["commits_by_repo"].write(D.commits_by_repo(commits), 0), counters)
        _mark(spark, path, 0, ranges)
        return cls(spark, path)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.tables[name].read(self.version if version is None else version)

    def repos_loaded(self, sticky: bool = False) -> DataFrame:
        """Repositories that have commits (``sticky``: or ever had)."""
        rows = self.read("repo_commits")
        return (rows if sticky else rows.where("commit_count > 0")).select("repo_name")

    def top_contributors(self, n: int | None = None) -> DataFrame:
        """The first ``n`` (at most ``TOP``) contributors of every repository:
        greatest count first, then by name."""
        n = TOP if n is None else n
        if not 1 <= n <= TOP:
            raise ValueError(f"n must be 1 to {TOP}")
        order = Window.partitionBy("repo_name").orderBy(F.desc("commit_count"), "author_name")
        rows = self.read("top_contributors").select("repo_name", "author_name", "commit_count")
        return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The commits whose ``commit_hash`` is asked for: only the ranges of the
        keys are read, and files whose bloom filter has none of a few keys are skipped."""
        table = self.tables["commits"]
        wanted = keys.select("commit_hash").where("commit_hash IS NOT NULL").distinct()
        rows = table.read(self.version, table.touched(wanted))
        few = [r[0] for r in wanted.limit(FEW_KEYS + 1).collect()]
        return rows.where(F.col("commit_hash").isin(few)) if len(few) <= FEW_KEYS else rows.join(wanted, "commit_hash", "left_semi")

    def apply(self, batch: DataFrame, create_mode: str = "if_absent") -> DataFrame:
        """Apply a change batch (see :func:`changes.apply_changes`) as the next
        version; returns the status of each change."""
        spark, new = self.spark, self.version + 1
        batch = stored(batch, "changes")
        commits = self.tables["commits"]
        log_path = f"{self.path}/log/version={new}"
        keys = batch.select(CH._strip("commit_hash").alias("commit_hash")).where("commit_hash IS NOT NULL")
        ranges = commits.touched(keys)
        base = commits.read(self.version, ranges)
        n = batch.count()
        CH.sequence_changes(base, batch, create_mode, n=n).write.mode("overwrite").parquet(log_path)
        log = spark.read.parquet(log_path)
        commits.write(CH.finalize_sequence(base, log, n)[0], new, ranges)

        # the rows that changed, before (-1) and after (+1): all that derived tables need
        changed = log.where(F.col("status").isin("created", "updated", "deleted")).select("commit_hash").distinct()
        columns = BY_REPO.fieldNames()
        side = lambda rows, sign: rows.select(*columns).join(CH._small(changed, n, CH.BROADCAST_KEYS), "commit_hash", "left_semi") \
            .select(*columns, F.lit(sign).cast("bigint").alias("sign"))
        side(base, -1).union(side(commits.read(new, ranges), 1)).write.mode("overwrite").parquet(f"{self.path}/moves/version={new}")
        moves = spark.read.parquet(f"{self.path}/moves/version={new}")
        _together(lambda: self._move_rows(moves, new), lambda: self._move_counts(moves, new))
        _mark(spark, self.path, new, self.ranges)
        self.version = new
        return log.select("seq", "op", "commit_hash", "status")

    def _move_rows(self, moves: DataFrame, new: int) -> None:
        table = self.tables["commits_by_repo"]
        ranges = table.touched(moves)
        kept = table.read(new - 1, ranges).join(moves.select(*table.keys), table.keys, "left_anti")
        table.write(kept.unionByName(moves.where("sign > 0").select(*kept.columns)), new, ranges)

    def _move_counts(self, moves: DataFrame, new: int) -> None:
        """Counters by their deltas; a counter at zero goes, but a repository stays."""
        deltas = moves.groupBy("repo_name", "author_name").agg(F.sum("sign").alias("commit_count")).where("commit_count <> 0")
        deltas.write.mode("overwrite").parquet(f"{self.path}/deltas/version={new}")
        deltas = self.spark.read.parquet(f"{self.path}/deltas/version={new}")
        authors, repos, top = (self.tables[t] for t in ("author_counts", "repo_commits", "top_contributors"))
        ranges = authors.touched(deltas)
        by_repo = deltas.groupBy("repo_name").agg(F.sum("commit_count").alias("commit_count"))
        own = repos.touched(by_repo)
        _together(lambda: authors.write(CH.merge_counter_deltas(authors.read(new - 1, ranges), deltas).where("commit_count <> 0"), new, ranges),
                  lambda: repos.write(CH.merge_counter_deltas(repos.read(new - 1, own), by_repo, ["repo_name"]), new, own))
        counts = authors.read(new, ranges).join(CH._small(deltas.select(*authors.keys), deltas.count(), CH.BROADCAST_KEYS), authors.keys, "left_semi")
        kept = update_top(top.read(new - 1, own), deltas, counts)
        # too few left above the floor: those repositories are filled anew from their counters
        kept.write.mode("overwrite").parquet(f"{self.path}/top/version={new}")
        kept = self.spark.read.parquet(f"{self.path}/top/version={new}")
        short = kept.where("refill").select("repo_name").distinct()
        whole = kept.where("NOT refill").drop("refill")
        if not short.isEmpty():
            whole = whole.unionByName(with_floor(authors.read(new).join(short, "repo_name", "left_semi")))
        top.write(whole, new, own)


#: Keys of a lookup that are pushed to the scan as a list, where bloom filters and statistics can skip files.
FEW_KEYS = 100


def _together(*jobs: Callable[[], None]) -> None:
    """Run jobs that write different tables at once; they share the cluster."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


def _mark(spark: SparkSession, path: str, version: int, ranges: int) -> None:
    spark.createDataFrame([(ranges,)], "ranges int").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/version={version}")


def _first(rows: DataFrame) -> DataFrame:
    """The first ``TOP + RESERVE`` of each repository, by rows that carry the
    floor so far. The first one that is cut off is the new floor."""
    by_repo = Window.partitionBy("repo_name")
    ranked = rows.withColumn("_place", F.row_number().over(by_repo.orderBy(F.desc("commit_count"), "author_name"))).where(F.col("_place") <= TOP + RESERVE + 1)
    cut = F.max(F.when(F.col("_place") > TOP + RESERVE, F.struct("commit_count", "author_name"))).over(by_repo)
    floored = ranked.withColumn("_cut", cut).withColumn("floor_count", F.coalesce("_cut.commit_count", "floor_count")) \
        .withColumn("floor_author", F.coalesce("_cut.author_name", "floor_author")).where(F.col("_place") <= TOP + RESERVE)
    return floored.select("repo_name", "author_name", "commit_count", "floor_count", "floor_author")


def with_floor(counts: DataFrame) -> DataFrame:
    """The first contributors of each repository with a reserve and the floor:
    the first contributor that is not kept (NULL if all are)."""
    return _first(counts.select("repo_name", "author_name", "commit_count", F.lit(None).cast("bigint").alias("floor_count"), F.lit(None).cast("string").alias("floor_author")))


def update_top(old: DataFrame, deltas: DataFrame, counts: DataFrame) -> DataFrame:
    """The kept contributors of the repositories in ``old`` and ``deltas`` after
    a batch; ``counts`` has the new counters of the pairs in ``deltas``.

    Contributors that are neither kept nor touched stand at the floor or below,
    so the kept and touched ones above it are in order without them. ``refill``:
    fewer than ``TOP`` are left above a floor."""
    pairs = ["repo_name", "author_name"]
    floors = old.groupBy("repo_name").agg(F.first("floor_count").alias("floor_count"), F.first("floor_author").alias("floor_author"))
    rows = old.select(*pairs, "commit_count").join(deltas.select(*pairs), pairs, "left_anti").unionByName(counts.select(*pairs, "commit_count"))
    above = F.col("floor_count").isNull() | (F.col("commit_count") > F.col("floor_count")) | \
        ((F.col("commit_count") == F.col("floor_count")) & (F.col("author_name") < F.col("floor_author")))
    n = F.count("*").over(Window.partitionBy("repo_name"))
    kept = _first(rows.join(floors, "repo_name", "left").where(above)).withColumn("refill", (n < TOP) & F.col("floor_count").isNotNull())
    # a repository of which nobody is left above its floor
    gone = floors.where("floor_count IS NOT NULL").join(kept.select("repo_name").distinct(), "repo_name", "left_anti") \
        .select("repo_name", F.lit(None).cast("string").alias("author_name"), F.lit(None).cast("bigint").alias("commit_count"), "floor_count", "floor_author", F.lit(True).alias("refill"))
    return kept.unionByName(gone)
