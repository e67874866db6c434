"""Repository-name statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens import schemas as S
from commitlens.operators.derive import with_name_length
from commitlens.operators.ranking import top_k


def _lengths(repos: DataFrame) -> DataFrame:
    return repos if "name_length" in repos.columns else with_name_length(repos)


def name_stats(repos: DataFrame) -> DataFrame:
    """Average, minimum and maximum name length and the repo count, as one
    row; no row at all when there are no repos (a global aggregate over
    nothing yields no group)."""
    stats = _lengths(repos).agg(
        F.avg("name_length").alias("avg_length"),
        F.min("name_length").cast("bigint").alias("min_length"),
        F.max("name_length").cast("bigint").alias("max_length"),
        F.count(F.lit(1)).cast("bigint").alias("total"),
    )
    return stats.where(F.col("total") > F.lit(0))


def longest_names(repos: DataFrame, n: int = S.TOP_NAMES) -> DataFrame:
    """Longest names, length DESC then name ASC."""
    return top_k(_lengths(repos).select("repo_name", "name_length"), "name_length", "repo_name", n)


def shortest_names(repos: DataFrame, n: int = S.TOP_NAMES) -> DataFrame:
    """Shortest names, length ASC then name ASC."""
    return top_k(
        _lengths(repos).select("repo_name", "name_length"), "name_length", "repo_name", n, descending=False
    )


def length_counts(repos: DataFrame) -> DataFrame:
    """Repositories per name length: a table of as many rows as there are
    lengths, kept up to date by adding deltas (``merge_counter_deltas``)."""
    return _lengths(repos).groupBy("name_length").agg(F.count(F.lit(1)).cast("bigint").alias("repo_count"))


def stats_of_lengths(counts: DataFrame) -> DataFrame:
    """:func:`name_stats` from the length counts, which deletes can lower: a
    length whose count is zero is gone."""
    live = counts.where("repo_count > 0")
    total = F.sum("repo_count")
    stats = live.agg(
        (F.sum(F.col("name_length") * F.col("repo_count")).cast("double") / total).alias("avg_length"),
        F.min("name_length").cast("bigint").alias("min_length"),
        F.max("name_length").cast("bigint").alias("max_length"),
        F.coalesce(total, F.lit(0)).cast("bigint").alias("total"),
    )
    return stats.where(F.col("total") > F.lit(0))


def longest_by_counts(repos: DataFrame, counts: DataFrame, n: int = S.TOP_NAMES) -> DataFrame:
    """:func:`longest_names`, reading only names of the lengths that the counts
    show to be needed (a filter on ``name_length`` that reaches the scan)."""
    need, bound = n, None
    for r in counts.where("repo_count > 0").orderBy(F.desc("name_length")).limit(n).collect():  # at most n rows
        bound, need = r["name_length"], need - r["repo_count"]
        if need <= 0:
            break
    rows = _lengths(repos)
    return longest_names(rows if bound is None else rows.where(F.col("name_length") >= F.lit(bound)), n)
