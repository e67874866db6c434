"""Load jobs: raw records to canonical and derived tables on storage.

``refresh`` rebuilds every table from the given input (repeatable: loading
the same input twice gives the same tables). ``accumulate`` adds the input
to a prior load: counters are summed, sets are unioned and commits are upserted
by hash. The record tables (``repos``, ``licenses``, ``languages``) have the whole
record as their key: a record that is there already is not added again. So loading
the same input twice doubles every counter and leaves every other table as it is.

Tables are written as parquet under ``out_dir/<table>``; each load writes to
a new folder and never overwrites a folder it reads in the same plan.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from commitlens.operators import changes as CH
from commitlens.operators import derive as D
from commitlens.session import read_if_exists, stored, work_dir
from commitlens.sources import normalise as NM

COUNTERS = {
    "rejects": (["source", "outcome"], "line_count"),
    "author_counts": (["repo_name", "author_name"], "commit_count"),
    "tier_counts": (["watch_tier"], "repo_count"),
    "license_counts": (["license_name"], "repo_count"),
    "language_bytes": (["name"], "total_bytes"),
}


def load_summary(records: DataFrame) -> DataFrame:
    """Accepted-record count and distinct repositories of a load, one row.
    The distinct count is planned as a partial aggregate on repo first, so
    each task sends one row per repo it saw."""
    return records.agg(
        F.count(F.lit(1)).cast("bigint").alias("record_count"),
        F.countDistinct("repo_name").cast("bigint").alias("repo_count"),
    )


def greatest_records(commits: DataFrame) -> DataFrame:
    """The greatest record by all its fields of every repository and hash."""
    fields = [c for c in commits.columns if c not in ("commit_hash", "repo_name")]
    return D.latest_by_key(commits, ["repo_name", "commit_hash"], fields)


def _greatest_by_hash(records: DataFrame, written: bool) -> DataFrame:
    """The greatest of the :func:`greatest_records` of every hash. Of written
    ones (whose hashes are not NULL) those hashes are counted first that
    several repositories have: the others' records are not shuffled."""
    pick = lambda rows: D.latest_by_key(rows, ["commit_hash"], [c for c in records.columns if c != "commit_hash"]).select(*records.columns)
    if not written:
        return pick(records)
    several = records.groupBy("commit_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("commit_hash")
    n = several.count()
    if n == 0 or n > CH.BROADCAST_KEYS:
        return pick(records) if n else records
    several = F.broadcast(several)
    single = records.join(several, "commit_hash", "left_anti").select(*records.columns)
    return single.unionByName(pick(records.join(several, "commit_hash", "left_semi")))


def derive_tables(
    commits: DataFrame | None = None,
    repos: DataFrame | None = None,
    licenses: DataFrame | None = None,
    languages: DataFrame | None = None,
    kept: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every canonical and derived table of one load, from normalised input.

    Commit records may repeat a hash; the snapshot keeps the last one by
    ``seq``. Without a ``seq`` column there is no last one, so the greatest
    record by all its fields is kept: one row per key in either case.
    Counters count every record. ``kept``: the :func:`greatest_records` of
    ``commits`` if they are written already."""
    out: dict[str, DataFrame] = {}
    if commits is not None:
        if "seq" in commits.columns:
            out["commits"] = D.commits_latest_by_hash(commits, "seq")
            out["commits_by_repo"] = D.commits_by_repo(commits, "seq")
        else:
            records = greatest_records(commits) if kept is None else kept
            out["commits"] = _greatest_by_hash(records, kept is not None).select(*commits.columns)
            out["commits_by_repo"] = D.commits_by_repo(records)
        out["author_counts"] = D.author_counts(commits)
        out["repos_loaded"] = D.loaded_repos(commits if kept is None else kept)
    if repos is not None:
        out["repos"] = repos
        out["repos_by_tier"] = D.repos_by_tier(repos)
        out["tier_counts"] = D.tier_counts(repos)
    if licenses is not None:
        out["licenses"] = licenses.where(F.col("repo_name").isNotNull() & (F.col("repo_name") != ""))
        out["license_counts"] = D.license_counts(licenses)
    if languages is not None:
        out["languages"] = languages
        out["language_bytes"] = D.language_bytes(languages)
    return out


def _layout(name: str, df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Physical layout per table, as (frame to write, partition columns):
    the tier table is partitioned by tier and sorted by (watch_count DESC,
    repo) inside files; the per-repo copy is range-partitioned on (repo,
    hash) so a hot repository spreads over many files while each file stays
    sorted (min/max skipping for one-repo reads); the snapshot is
    range-partitioned and sorted on hash (min/max skipping for reads by
    hash)."""
    if name == "repos_by_tier":
        return df.sortWithinPartitions("watch_tier", F.col("watch_count").desc(), "repo_name"), ["watch_tier"]
    if name == "commits_by_repo":
        return df.repartitionByRange("repo_name", "commit_hash").sortWithinPartitions("repo_name", "commit_hash"), []
    if name == "commits":
        # disjoint sorted hash ranges per file: a point read by hash is
        # answered from one file, the others skipped by min/max statistics
        return df.repartitionByRange("commit_hash").sortWithinPartitions("commit_hash"), []
    return df, []


def write_tables(
    tables: dict[str, DataFrame], out_dir: str, parallel_jobs: int = 4, metrics: dict | None = None
) -> dict[str, str]:
    """Write every table under ``out_dir``. The tables are independent, so
    their write jobs are submitted from a few driver threads at once and
    share the cluster instead of running one after another.

    If ``metrics`` is a dict it receives ``{table: rows_written}``, observed
    on the writes themselves (``DataFrame.observe``): the load summary costs
    no second pass over the data."""
    paths = {name: f"{out_dir}/{name}" for name in tables}
    observations = {}

    def write(name: str) -> None:
        df, partition_cols = _layout(name, tables[name])
        if metrics is not None:
            # observed above the layout, so a range partitioner's sampling
            # pass is not counted
            observations[name] = Observation(f"load_{name}")
            df = df.observe(observations[name], F.count(F.lit(1)).alias("rows"))
        df.write.partitionBy(*partition_cols).mode("overwrite").parquet(paths[name])

    with ThreadPoolExecutor(max_workers=max(1, parallel_jobs)) as pool:
        for done in [pool.submit(write, name) for name in tables]:
            done.result()
    if metrics is not None:
        metrics.update({name: int(obs.get["rows"]) for name, obs in observations.items()})
    return paths


#: Every table a load or a change job can write.
TABLES = ["commits", "commits_by_repo", "author_counts", "repos_loaded", "repos", "repos_by_tier", "tier_counts",
          "licenses", "license_counts", "languages", "language_bytes", "rejects"]


def accumulate(spark: SparkSession, prior_dir: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Combine new tables with a prior load: counters summed, sets unioned,
    records upserted (new wins). Tables that only one of the two has are
    carried over as they are, so a load of some kinds keeps the others."""
    out = {}
    for name in TABLES:
        new, prior = tables.get(name), read_if_exists(spark, f"{prior_dir.rstrip('/')}/{name}")
        if new is None or prior is None:
            if new is not None or prior is not None:
                out[name] = prior if new is None else new
        elif name in COUNTERS:
            keys, value = COUNTERS[name]
            both = prior.select(*keys, value).unionByName(new.select(*keys, value))
            out[name] = both.groupBy(*keys).agg(F.sum(value).cast("bigint").alias(value))
        elif name == "repos_loaded":
            out[name] = prior.unionByName(new).distinct()
        elif name == "commits":
            out[name] = prior.join(new.select("commit_hash"), "commit_hash", "left_anti").unionByName(new)
        elif name == "commits_by_repo":
            out[name] = prior.join(new.select("repo_name", "commit_hash"), ["repo_name", "commit_hash"],
                                   "left_anti").unionByName(new)
        elif name == "repos_by_tier":
            out[name] = prior.unionByName(new.select(*prior.columns)).distinct()
        else:  # the record is the key: what is there stays, new records are added once
            out[name] = prior.unionByName(new.select(*prior.columns).subtract(prior))
    if not out:
        raise ValueError(f"nothing to load, and no table under {prior_dir}")
    return out


def load_all(
    spark: SparkSession,
    out_dir: str,
    raw_commits: DataFrame | None = None,
    raw_repos: DataFrame | None = None,
    raw_licenses: DataFrame | None = None,
    raw_languages: DataFrame | None = None,
    mode: str = "refresh",
    prior_dir: str | None = None,
    metrics: dict | None = None,
    rejects: DataFrame | None = None,
) -> dict[str, str]:
    """Normalise the given raw inputs, derive every table and write them
    (``rejects``: line counts of the sources, written and accumulated too).
    Returns table name -> path; ``metrics`` (a dict) receives the rows
    written per table."""
    if mode not in ("refresh", "accumulate"):
        raise ValueError("mode must be 'refresh' or 'accumulate'")
    commits = None if raw_commits is None else NM.normalise_commits(raw_commits, keep=["seq"])
    # without seq, records are put in order by all their fields: once, for all tables
    kept = None if commits is None or "seq" in commits.columns else stored(greatest_records(commits), "records")
    tables = derive_tables(
        commits=commits,
        kept=kept,
        repos=None if raw_repos is None else NM.normalise_repos(raw_repos),
        licenses=None if raw_licenses is None else NM.normalise_licenses(raw_licenses),
        languages=None if raw_languages is None else NM.unnest_languages(raw_languages),
    )
    if rejects is not None:
        tables["rejects"] = rejects
    if mode == "accumulate":
        if prior_dir is None:
            raise ValueError("accumulate needs prior_dir")
        tables = accumulate(spark, prior_dir, tables)
    return write_tables(tables, out_dir, metrics=metrics)


def reload_license_counts(spark: SparkSession, raw_licenses: DataFrame, mode: str) -> DataFrame:
    """Load the license input, load it again with ``mode``, and read the
    license counters of the second load."""
    base = work_dir(spark, "load")
    first = load_all(spark, f"{base}/load1", raw_licenses=raw_licenses, mode="refresh")
    second = load_all(
        spark, f"{base}/load2", raw_licenses=raw_licenses, mode=mode,
        prior_dir=f"{base}/load1" if mode == "accumulate" else None,
    )
    assert first and second
    return spark.read.parquet(second["license_counts"])


def load_and_count(spark: SparkSession, **raw: DataFrame) -> DataFrame:
    """Run a refresh load of the given raw inputs into a new work folder and
    return (table_name, row_count) for every table written, read back from
    storage."""
    out = work_dir(spark, "load-all")
    paths = load_all(spark, out, **raw)
    counts = None
    for name in sorted(paths):
        c = spark.read.parquet(paths[name]).agg(F.count(F.lit(1)).cast("bigint").alias("row_count"))
        c = c.select(F.lit(name).alias("table_name"), "row_count")
        counts = c if counts is None else counts.unionByName(c)
    return counts


# Source files of a load folder and what each holds (fixed names).
SOURCE_FILES = {
    "commits": "Sample_Commits.json",
    "repos": "Sample_Repos.json",
    "licenses": "Licenses.json",
    "languages": "Languages.json",
}


def load_from_files(
    spark: SparkSession, in_dir: str, out_dir: str, mode: str = "refresh", prior_dir: str | None = None,
    metrics: dict | None = None, sources: list[str] | None = None,
    transform: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> dict[str, str]:
    """Load the NDJSON source files of ``in_dir`` into the canonical and
    derived tables under ``out_dir``, plus a ``rejects`` table (source,
    outcome, line_count) accounting for every line read.

    ``sources`` names the kinds to load, and each must be there; by default
    those that are there are loaded, and one at least must be. Spark resolves
    the paths, on any store. ``transform`` maps a kind to a function on its
    parsed records (a row it drops is skipped). Each source is parsed once:
    its accepted records are written to the work folder with the outcomes
    counted on that write, and every table derives from them. Commit records
    carry their file order, so a hash that repeats keeps its last line."""
    from commitlens import schemas as S
    from commitlens.sources import ndjson as J

    specs = {
        "commits": (S.RAW_COMMIT, ["commit", "repo_name"]),
        "repos": (S.RAW_REPO, ["repo_name"]),
        "licenses": (S.RAW_LICENSE, []),
        "languages": (S.RAW_LANGUAGE, []),
    }
    if unknown := set(sources or ()) - set(specs):
        raise ValueError(f"no such source: {sorted(unknown)}")
    base = work_dir(spark, "load-files")
    raw: dict[str, DataFrame] = {}
    counts = []
    for name in sources or specs:
        schema, required = specs[name]
        try:
            classified = J.read_ndjson(spark, f"{in_dir.rstrip('/')}/{SOURCE_FILES[name]}", schema, required)
        except AnalysisException as e:
            if sources or e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        seen = Observation(f"lines_{name}")
        recs = J.accepted(classified.observe(seen, *J.outcome_counts()))
        if name == "commits":
            recs = recs.withColumnRenamed("line_order", "seq")
        if transform and name in transform:
            recs = transform[name](recs)
        recs.write.parquet(f"{base}/{name}")
        raw[name] = spark.read.schema(recs.schema).parquet(f"{base}/{name}")
        counts += [(name, outcome, int(n)) for outcome, n in seen.get.items()]
    if not raw:
        raise FileNotFoundError(f"no source file under {in_dir}")
    return load_all(
        spark, out_dir,
        raw_commits=raw.get("commits"), raw_repos=raw.get("repos"),
        raw_licenses=raw.get("licenses"), raw_languages=raw.get("languages"),
        mode=mode, prior_dir=prior_dir, metrics=metrics,
        rejects=spark.createDataFrame(counts, "source string, outcome string, line_count bigint"),
    )


def read_changes(spark: SparkSession, changes_path: str) -> tuple[DataFrame, DataFrame]:
    """(changes, line counts by outcome) of an NDJSON change file, which is
    parsed once: the accepted changes are written with their outcomes observed."""
    from commitlens import schemas as S
    from commitlens.sources import ndjson as J

    seen = Observation("change_lines")
    classified = J.read_ndjson(spark, changes_path, S.CHANGES, ["op"]).drop("line_order")
    path = f"{work_dir(spark, 'changes')}/accepted"
    J.accepted(classified.observe(seen, *J.outcome_counts())).write.parquet(path)
    counts = [(outcome, int(n)) for outcome, n in seen.get.items()]
    return spark.read.schema(S.CHANGES).parquet(path), spark.createDataFrame(counts, "outcome string, line_count bigint")


def apply_change_file(
    spark: SparkSession,
    tables_dir: str,
    changes_path: str,
    out_dir: str,
    create_mode: str = "if_absent",
    metrics: dict | None = None,
    sticky_repos: bool = False,
) -> dict[str, str]:
    """Apply an NDJSON change batch (fields of ``schemas.CHANGES``; ``seq``
    orders the changes) to the tables under ``tables_dir`` and write a new
    table folder ``out_dir``: the new ``commits`` snapshot, its recomputed
    ``commits_by_repo``, ``author_counts`` and ``repos_loaded``, all other
    tables as they were, the per-change ``change_status`` (and the fuller
    ``change_log``) and the ``change_rejects`` line counts. A change without
    ``seq``, or sharing it with another, is ``invalid`` and not applied.
    ``sticky_repos`` keeps repositories in ``repos_loaded`` that lost all
    their commits. The old folder is only read, never overwritten."""
    from commitlens.operators import changes as CH

    tables_dir = tables_dir.rstrip("/")
    base = spark.read.parquet(f"{tables_dir}/commits")
    batch, rejects = read_changes(spark, changes_path)
    n = batch.count()
    # The sequenced changes are written once (they are the size of the
    # batch); the snapshot is finished from that table, and the derived
    # tables from the written snapshot, so no step recomputes an earlier one
    # and each written table cuts the lineage.
    ops = CH.sequence_changes(base, batch, create_mode, n=n)
    paths = write_tables({"change_log": ops, "change_rejects": rejects}, out_dir, metrics=metrics)
    log = spark.read.parquet(paths["change_log"])
    snapshot_df, _ = CH.finalize_sequence(base, log, n)
    paths.update(write_tables(
        {"commits": snapshot_df, "change_status": log.select("seq", "op", "commit_hash", "status")},
        out_dir, metrics=metrics,
    ))
    snapshot = spark.read.parquet(paths["commits"])
    prior = read_if_exists(spark, f"{tables_dir}/repos_loaded") if sticky_repos else None
    derived = {
        "commits_by_repo": D.commits_by_repo(snapshot),
        "author_counts": D.author_counts(snapshot),
        "repos_loaded": D.loaded_repos(snapshot, prior=prior),
    }
    for name in TABLES:
        if name not in derived and name != "commits" and (old := read_if_exists(spark, f"{tables_dir}/{name}")) is not None:
            derived[name] = old
    paths.update(write_tables(derived, out_dir, metrics=metrics))
    return paths
