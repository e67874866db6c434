"""Watch-count histograms and most-watched lists.

Two bucketings with different edge rules are kept apart on purpose:

* sparse buckets: half-open ranges between fixed boundaries; counts outside
  them (negatives, and >= the last boundary) fall into ``other``; only
  non-empty buckets are listed;
* dense tiers: inclusive ranges, the last open-ended, negatives fall to the
  first tier; every tier is listed in fixed order, zero-filled.

The bucket/tier of a row is a ``when`` chain (code-generated); the counts are
one partial + final aggregate with at most seven groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens import schemas as S
from commitlens.functions import bucket_bound, bucket_label, tier_position
from commitlens.operators.derive import repos_by_tier, tier_counts
from commitlens.operators.ranking import top_k, with_report_columns


def zero_fill(counts: DataFrame, domain: DataFrame, key: str, value: str) -> DataFrame:
    """Every key of ``domain`` with its value from ``counts`` or 0.

    Spark chooses the join; for a few labels it broadcasts the counts."""
    joined = domain.join(counts, key, "left")
    return joined.select(
        *domain.columns, F.coalesce(F.col(value), F.lit(0)).cast("bigint").alias(value)
    )


def tier_domain(spark: SparkSession) -> DataFrame:
    """The fixed tier labels with their display position (6 rows)."""
    schema = T.StructType(
        [T.StructField("watch_tier", T.StringType()), T.StructField("tier_order", T.LongType())]
    )
    return spark.createDataFrame([(t, i) for i, t in enumerate(S.TIER_ORDER, start=1)], schema)


def tier_histogram(repos: DataFrame, width: int = S.BAR_WIDTH_HISTOGRAM) -> DataFrame:
    """Dense tier histogram: every tier in order, repo records counted
    (duplicates count), zero-filled, with a bar length."""
    spark = repos.sparkSession
    filled = zero_fill(tier_counts(repos), tier_domain(spark), "watch_tier", "repo_count")
    return with_report_columns(filled, "repo_count", width)


def bucket_histogram(repos: DataFrame, width: int = S.BAR_WIDTH_HISTOGRAM) -> DataFrame:
    """Sparse bucket histogram: only non-empty buckets, ordered by lower
    boundary with ``other`` last (``bucket_order``), with a bar length."""
    bounded = repos.select(bucket_bound("watch_count").alias("bound"))
    counts = bounded.groupBy("bound").agg(F.count(F.lit(1)).cast("bigint").alias("repo_count"))
    ordered = counts.select(
        bucket_label("bound").alias("watch_range"),
        "repo_count",
        # at most 7 rows: the fixed buckets plus "other"
        F.row_number().over(_bucket_window()).cast("bigint").alias("bucket_order"),
    )
    return with_report_columns(ordered, "repo_count", width)


def _bucket_window():
    from pyspark.sql import Window

    return Window.orderBy(F.col("bound").asc_nulls_last())


def most_watched(repos: DataFrame, n: int = S.TOP_WATCHED) -> DataFrame:
    """Most watched repositories over all records (duplicates kept), watch
    count DESC then name ASC."""
    return top_k(repos.select("repo_name", "watch_count"), "watch_count", "repo_name", n)


def most_watched_in_tier(repos: DataFrame, tier: str, n: int = S.TOP_WATCHED) -> DataFrame:
    """Most watched inside one tier, over distinct (tier, count, repo)."""
    in_tier = repos_by_tier(repos).where(F.col("watch_tier") == F.lit(tier))
    return top_k(in_tier, "watch_count", "repo_name", n)


def most_watched_overall(repos: DataFrame, n: int = S.TOP_WATCHED) -> DataFrame:
    """Most watched over distinct (tier, count, repo). Tiers are disjoint
    ordered ranges, so walking them from the top with early exit is the
    global order on (watch_count DESC, repo ASC): one top-k, no walk."""
    return top_k(repos_by_tier(repos), "watch_count", "repo_name", n)


def walk_tiers(by_tier: DataFrame, counts: DataFrame, n: int = S.TOP_WATCHED) -> tuple[DataFrame, list[str]]:
    """Most watched overall from the written tier table (partitioned by tier) and
    the tier counts, and the tiers that were read: tiers are disjoint ordered
    ranges, so they are read from the top, one partition each, until ``n`` are
    found. Tiers that the counts show to be empty are not read. The driver holds
    at most ``n`` rows."""
    if n < 1:
        raise ValueError("n must be positive")
    held = {r["watch_tier"] for r in counts.where("repo_count > 0").collect()}  # one row per tier at most
    rows, read = [], []
    for tier in reversed(S.TIER_ORDER):
        if tier in held and len(rows) < n:
            read.append(tier)
            own = by_tier.where(F.col("watch_tier") == F.lit(tier)).select("watch_tier", "watch_count", "repo_name")
            rows += own.orderBy(F.desc("watch_count"), "repo_name").limit(n - len(rows)).collect()
    ranked = [(r["watch_tier"], r["watch_count"], r["repo_name"], k) for k, r in enumerate(rows, start=1)]
    return by_tier.sparkSession.createDataFrame(ranked, "watch_tier string, watch_count bigint, repo_name string, rank bigint"), read


def most_watched_per_tier(repos: DataFrame, n: int = S.TOP_WATCHED) -> DataFrame:
    """The top n of every tier at once, with the tier's display position."""
    ranked = top_k(repos_by_tier(repos), "watch_count", "repo_name", n, partition_by="watch_tier")
    return ranked.withColumn("tier_order", tier_position("watch_tier"))
