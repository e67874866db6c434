"""Derived tables: deduplicated snapshots and pre-aggregated counters.

Every aggregate here is a plain ``groupBy().agg()``: Spark runs a partial
aggregate in each task before the shuffle, so a key holding a third of all
rows leaves each task as one row and the final aggregate sees one row per
task for it. No operator collects the rows of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.functions import tier_label


def latest_by_key(df: DataFrame, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """One row per key: the row with the greatest ``order`` value(s) (last
    write wins). NULL is the smallest; of rows that tie the greatest by its
    other columns stays, so a key never loses its record. ``max`` is a partial
    aggregate, so a hot key is reduced map-side instead of being sorted in one
    task as a window would."""
    keys = list(keys)
    order_cols = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(F.max(F.struct(*order_cols, *[c for c in rest if c not in order_cols])).alias("_latest"))
    return latest.select(*keys, *[F.col("_latest")[c].alias(c) for c in rest])


def commits_latest_by_hash(commits: DataFrame, order: str | Sequence[str] = "seq") -> DataFrame:
    """``commits_by_hash``: one row per commit hash, later records replace
    earlier ones."""
    out = latest_by_key(commits, ["commit_hash"], order)
    drop = [order] if isinstance(order, str) else list(order)
    return out.drop(*[c for c in drop if c in out.columns])


def commits_by_repo(commits: DataFrame, order: str | Sequence[str] | None = None) -> DataFrame:
    """``commits_by_repo``: (repo, hash) unique with author, subject and file
    count. On a snapshot (hash already unique) this is a projection with no
    shuffle; on raw records pass ``order`` for last-write-wins per pair."""
    cols = ["repo_name", "commit_hash", "author_name", "subject", "num_files_changed"]
    if order is None:
        return commits.select(*cols)
    order_cols = [order] if isinstance(order, str) else list(order)
    return latest_by_key(commits.select(*cols, *order_cols), ["repo_name", "commit_hash"], order).select(
        *cols
    )


def author_counts(
    commits: DataFrame, count_mode: str = "records", order: str | Sequence[str] | None = None
) -> DataFrame:
    """Commit count per (repo, author).

    ``count_mode="records"``: +1 per record given, so a repeated hash counts
    again (the load-time counter semantics). ``"distinct"``: count the
    snapshot instead, i.e. one record per hash, the last by ``order``."""
    if count_mode not in ("records", "distinct"):
        raise ValueError("count_mode must be 'records' or 'distinct'")
    if count_mode == "distinct":
        if order is None:
            raise ValueError("count_mode='distinct' needs the order column(s)")
        order_cols = [order] if isinstance(order, str) else list(order)
        slim = commits.select("commit_hash", "repo_name", "author_name", *order_cols)
        commits = latest_by_key(slim, ["commit_hash"], order)
    return commits.groupBy("repo_name", "author_name").agg(
        F.count(F.lit(1)).cast("bigint").alias("commit_count")
    )


def license_counts(licenses: DataFrame) -> DataFrame:
    """Repository count per license."""
    return licenses.groupBy(F.col("license").alias("license_name")).agg(
        F.count(F.lit(1)).cast("bigint").alias("repo_count")
    )


def language_bytes(languages: DataFrame) -> DataFrame:
    """Total bytes per language; a language seen only with 0 bytes is kept."""
    return languages.groupBy("name").agg(F.sum("bytes").cast("bigint").alias("total_bytes"))


def loaded_repos(commits: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Distinct repositories that have commits. With ``prior`` (an earlier
    ``repos_loaded``) the set is sticky: repositories whose commits were all
    deleted stay listed, as in the source stores where it never shrinks."""
    repos = commits.select("repo_name")
    if prior is not None:
        repos = repos.unionByName(prior.select("repo_name"))
    return repos.distinct()


def with_tier(repos: DataFrame) -> DataFrame:
    return repos.withColumn("watch_tier", tier_label("watch_count"))


def repos_by_tier(repos: DataFrame) -> DataFrame:
    """``repos_by_watch_tier``: distinct (tier, watch_count, repo)."""
    return with_tier(repos).select("watch_tier", "watch_count", "repo_name").distinct()


def tier_counts(repos: DataFrame) -> DataFrame:
    """``repo_counts_by_tier``: +1 per repo record (duplicates count), only
    tiers that occur (see ``tier_histogram`` for the zero-filled form)."""
    return with_tier(repos).groupBy("watch_tier").agg(
        F.count(F.lit(1)).cast("bigint").alias("repo_count")
    )


def with_name_length(repos: DataFrame) -> DataFrame:
    """Repos with a stored ``name_length`` (code points)."""
    return repos.withColumn("name_length", F.length("repo_name").cast("bigint"))
