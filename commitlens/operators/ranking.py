"""Ranked reports: top-k with an explicit tie rule, per-group top-k, and the
report columns (rank, bar length, share).

Global top-k is ``orderBy(...).limit(n)``, which Spark plans as
``TakeOrderedAndProject``: each task keeps its own n best rows and only those
reach the final merge. Per-group top-k is ``row_number() <= n`` over a
partitioned window, which Spark plans with a partial ``WindowGroupLimit``
before the shuffle, so a hot group sends at most n rows per task.
Report columns are computed after the limit, on at most n rows (per group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.functions import bar_length, share_percent


def _check_n(n: int) -> None:
    if not isinstance(n, int) or n < 1:
        raise ValueError(f"top_n must be a positive integer, got {n!r}")


def order_columns(value: str, name: str | Sequence[str], ties: str = "asc", descending: bool = True) -> list[Column]:
    """Sort keys: value (DESC by default), then the name(s) by the tie rule."""
    if ties not in ("asc", "desc"):
        raise ValueError("ties must be 'asc' or 'desc'")
    names = [name] if isinstance(name, str) else list(name)
    first = F.col(value).desc() if descending else F.col(value).asc()
    tie = [F.col(c).asc() if ties == "asc" else F.col(c).desc() for c in names]
    return [first, *tie]


def top_k(
    df: DataFrame,
    value: str,
    name: str | Sequence[str],
    n: int,
    ties: str = "asc",
    positive_only: bool = False,
    partition_by: str | Sequence[str] | None = None,
    descending: bool = True,
    rank_col: str = "rank",
) -> DataFrame:
    """The n best rows by ``value`` (per ``partition_by`` group if given),
    with a 1-based ``rank``. ``ties`` orders equal values by name ascending or
    descending; ``positive_only`` drops rows whose value is not > 0 first."""
    _check_n(n)
    if positive_only:
        df = df.where(F.col(value) > F.lit(0))
    order = order_columns(value, name, ties, descending)
    if partition_by is None:
        limited = df.orderBy(*order).limit(n)
        # at most n rows reach this window
        w = Window.orderBy(*order)
        return limited.withColumn(rank_col, F.row_number().over(w).cast("bigint"))
    groups = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    w = Window.partitionBy(*groups).orderBy(*order)
    ranked = df.withColumn(rank_col, F.row_number().over(w).cast("bigint"))
    return ranked.where(F.col(rank_col) <= F.lit(n))


def with_report_columns(
    df: DataFrame,
    value: str,
    width: int,
    partition_by: str | Sequence[str] | None = None,
    share: bool = False,
) -> DataFrame:
    """Add ``bar_length`` (value scaled to the largest reported value times
    ``width``) and optionally ``share_of_top`` (percent of the reported rows'
    total). Apply to an already limited frame."""
    groups = [] if partition_by is None else ([partition_by] if isinstance(partition_by, str) else list(partition_by))
    w = Window.partitionBy(*groups)
    out = df.withColumn("_max", F.max(value).over(w))
    if share:
        out = out.withColumn("_total", F.sum(value).over(w))
    out = out.withColumn("bar_length", bar_length(value, "_max", width))
    if share:
        out = out.withColumn("share_of_top", share_percent(value, "_total"))
    return out.drop("_max", "_total")
