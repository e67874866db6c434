"""The feature reports, each a composition of operators over canonical or
derived tables. Every function returns DataFrames (nothing is printed or
collected); limits are the report sizes, applied after full aggregation.

Tie rules (``ties``): "asc" orders equal values by name ascending (the
clustered-table behaviour), "desc" by name descending (the sorted-set
behaviour). ``positive_only`` hides counters at zero or below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens import schemas as S
from commitlens.operators import derive as D
from commitlens.operators import histograms as H
from commitlens.operators import names as N
from commitlens.operators import ranking as R
from commitlens.operators import text as TX


def commit_activity(
    author_counts: DataFrame,
    repo: str,
    n: int = S.TOP_CONTRIBUTORS,
    ties: str = "asc",
    positive_only: bool = True,
) -> DataFrame:
    """Top contributors of one repository: author, commit count, rank and a
    bar of width 40. The repository predicate reaches the scan."""
    in_repo = author_counts.where(F.col("repo_name") == F.lit(repo)).select("author_name", "commit_count")
    top = R.top_k(in_repo, "commit_count", "author_name", n, ties=ties, positive_only=positive_only)
    return R.with_report_columns(top, "commit_count", S.BAR_WIDTH_CONTRIBUTORS)


def commit_activity_all(author_counts: DataFrame, n: int = S.TOP_CONTRIBUTORS, ties: str = "asc") -> DataFrame:
    """Top contributors of every repository at once (per-repo rank and bar)."""
    top = R.top_k(author_counts, "commit_count", "author_name", n, ties=ties, partition_by="repo_name")
    return R.with_report_columns(top, "commit_count", S.BAR_WIDTH_CONTRIBUTORS, partition_by="repo_name")


def license_report(
    license_counts: DataFrame, n: int = S.TOP_LICENSES, ties: str = "asc", positive_only: bool = True
) -> DataFrame:
    """Most used licenses with rank, bar (width 30) and share of the listed
    rows' total."""
    top = R.top_k(license_counts, "repo_count", "license_name", n, ties=ties, positive_only=positive_only)
    return R.with_report_columns(top, "repo_count", S.BAR_WIDTH_LICENSES, share=True)


def language_report(language_bytes: DataFrame, n: int = S.TOP_LANGUAGES, ties: str = "desc") -> DataFrame:
    """Languages by total bytes with rank."""
    return R.top_k(language_bytes, "total_bytes", "name", n, ties=ties)


def word_report(commits: DataFrame, n: int = S.TOP_WORDS, text_col: str = "subject") -> DataFrame:
    """Most common subject words with rank and bar (width 35)."""
    return TX.top_words(commits, text_col, n)


def watch_report_tiers(repos: DataFrame, n: int = S.TOP_WATCHED) -> tuple[DataFrame, DataFrame]:
    """Dense tier histogram (zero-filled, fixed order) and the most watched
    distinct repositories."""
    return H.tier_histogram(repos), H.most_watched_overall(repos, n)


def watch_report_buckets(repos: DataFrame, n: int = S.TOP_WATCHED) -> tuple[DataFrame, DataFrame]:
    """Sparse bucket histogram ('other' for out-of-range counts) and the most
    watched repository records."""
    return H.bucket_histogram(repos), H.most_watched(repos, n)


def name_report(repos: DataFrame, n: int = S.TOP_NAMES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Name-length statistics (no row without repos), longest and shortest
    names."""
    return N.name_stats(repos), N.longest_names(repos, n), N.shortest_names(repos, n)


def loaded_repositories(commits: DataFrame) -> DataFrame:
    """Repositories that have commits, sorted."""
    return D.loaded_repos(commits).orderBy("repo_name")
