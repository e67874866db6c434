"""Physical-plan checks: no Python evaluation anywhere, top-k as a
TakeOrderedAndProject, per-group limits before the shuffle, pushed filters."""

import pytest

from commitlens.plans.queries import QUERIES
from commitlens.operators import lookup as L
from commitlens.sources import bindings as B
from conftest import SF_SMALL

# what these return is read from tables that they wrote before
NON_BATCH = {"refresh_then_reload", "accumulate_reload", "stream_author_counts", "stream_language_bytes", "stream_upsert", "stream_all_tables",
             "change_touched_ranges", "change_incremental_tables", "top_contributors_maintained", "lookup_in_ranges", "accumulate_same_records", "most_watched_walk"}


def queries():
    return QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(queries()) - NON_BATCH))
def test_no_python_in_plan(spark, name):
    p = plan(queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


@pytest.mark.parametrize("name", ["top_words", "top_contributors_redis", "most_watched_overall",
                                  "longest_names", "top_languages"])
def test_top_k_is_take_ordered(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "TakeOrderedAndProject" in plan(queries()[name](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_per_group_top_k_limits_before_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(queries()["top_contributors_per_repo"](spark, SF_SMALL))
        assert "WindowGroupLimit" in p
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_repo_filter_pushed_to_scan(spark):
    df = L.list_by_repo(B.commits_table(spark, SF_SMALL), "2-HIGH")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,2-HIGH)]" in p


def test_word_count_partial_aggregate(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(queries()["top_words"](spark, SF_SMALL))
        assert "partial_count" in p and "ReadSchema: struct<text:string>" in p
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_count_only_consumers_do_not_build_file_arrays(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(queries()["author_counts"](spark, SF_SMALL))
        assert "collect_list" not in p
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _no_aqe(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")


def _aqe(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_last_write_wins_reduces_before_shuffle(spark):
    _no_aqe(spark)
    try:
        p = plan(queries()["commits_latest_by_hash"](spark, SF_SMALL))
        # the plan prints top-down: the partial aggregate sits below the
        # exchange, so a hot hash leaves each task as one row
        assert "partial_max(" in p and p.rfind("Exchange hashpartitioning") < p.rfind("partial_max(")
    finally:
        _aqe(spark)


def test_zero_fill_broadcasts_only_the_bounded_counts(spark):
    _no_aqe(spark)
    try:
        p = plan(queries()["watch_tiers_dense"](spark, SF_SMALL))
        assert "BroadcastHashJoin" in p and "LeftOuter, BuildRight" in p
    finally:
        _aqe(spark)


def test_sequential_batch_never_windows_a_whole_key(spark):
    from commitlens.operators import changes as CH

    _no_aqe(spark)
    try:
        res = CH.apply_changes(B.commits_table(spark, SF_SMALL), B.mixed_changes(spark, SF_SMALL))
        p = plan(res.status)
        # the per-change window is partitioned by (key, chunk), not by key alone
        assert "windowspecdefinition(commit_hash#" in p and "_chunk#" in p
        assert "partial_max_by" in p
    finally:
        _aqe(spark)
