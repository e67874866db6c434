"""Record lookups: by key batch, by repository, by author pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens import schemas as S
from commitlens.functions import preview
from commitlens.operators.derive import commits_by_repo


def lookup(commits: DataFrame, keys: DataFrame, key: str = "commit_hash") -> DataFrame:
    """Every requested key with ``found`` and the record's fields (NULL when
    absent). Keys are deduplicated first, and the records cut down to them by
    a semi join whose key side Spark broadcasts when it is small: then the
    records are filtered where they are read and only the hits move."""
    wanted = keys.select(key).distinct()
    found = lookup_existing(commits, wanted, key).withColumn("found", F.lit(True))
    out = wanted.join(found, key, "left")
    return out.withColumn("found", F.coalesce(F.col("found"), F.lit(False)))


def read_record(commits: DataFrame, commit_hash: str) -> DataFrame:
    """The record with this hash (no row when absent). The key predicate is
    pushed to the scan."""
    return commits.where(F.col("commit_hash") == F.lit(commit_hash))


def lookup_existing(commits: DataFrame, keys: DataFrame, key: str = "commit_hash") -> DataFrame:
    """Only the records whose key is requested (semi join)."""
    return commits.join(keys.select(key), key, "left_semi")


def list_by_repo(commits: DataFrame, repo: str, n: int = S.LIST_LIMIT) -> DataFrame:
    """First n commits of one repository by hash: hash, author, subject and
    file count, plus display previews of hash and subject. The repository
    predicate is pushed to the scan."""
    if n < 1:
        raise ValueError("limit must be positive")
    rows = commits_by_repo(commits).where(F.col("repo_name") == F.lit(repo))
    top = rows.orderBy("commit_hash").limit(n)
    return top.select(
        "commit_hash",
        "author_name",
        "subject",
        "num_files_changed",
        preview("commit_hash", 10).alias("short_hash"),
        preview("subject", 50).alias("subject_preview"),
    )


def search_author(commits: DataFrame, pattern: str, n: int = S.LIST_LIMIT) -> DataFrame:
    """Commits whose author matches a regular expression anywhere in the
    name, case-insensitively (Unicode-aware), first n by hash."""
    if n < 1:
        raise ValueError("limit must be positive")
    hits = commits.where(F.col("author_name").rlike("(?iu)" + pattern))
    return hits.orderBy("commit_hash").limit(n)
