import pytest
from pyspark.sql import functions as F

from commitlens.operators import derive as D
from commitlens.operators import histograms as H
from commitlens.operators import names as N
from commitlens.operators import ranking as R
from commitlens.operators import text as TX
from conftest import rows


def repos_df(spark, pairs):
    return spark.createDataFrame(pairs, "repo_name string, watch_count bigint")


VALUES = [0, 1, 9, 10, 99, 100, 999, 1000, 9999, 10000, 999999, 1000000, -1]


def test_tier_and_bucket_edges(spark):
    df = repos_df(spark, [(f"r{v}", v) for v in VALUES])
    tiers = dict(rows(D.with_tier(df), "repo_name", "watch_tier"))
    assert tiers["r0"] == "0 watchers" and tiers["r-1"] == "0 watchers"
    assert tiers["r9"] == "1 to 9" and tiers["r10"] == "10 to 99"
    assert tiers["r9999"] == "1,000 to 9,999" and tiers["r1000000"] == "10,000+"
    hist = {r.watch_range: r.repo_count for r in H.bucket_histogram(df).collect()}
    assert hist == {"0 watchers": 1, "1 to 9": 2, "10 to 99": 2, "100 to 999": 2,
                    "1,000 to 9,999": 2, "10,000+": 2, "other": 2}
    order = [r.watch_range for r in H.bucket_histogram(df).orderBy("bucket_order").collect()]
    assert order[-1] == "other" and order[0] == "0 watchers"


def test_dense_histogram_zero_fills(spark):
    df = repos_df(spark, [("a", 5), ("a", 5), ("b", 50)])
    out = H.tier_histogram(df).orderBy("tier_order").collect()
    assert [(r.watch_tier, r.repo_count) for r in out] == [
        ("0 watchers", 0), ("1 to 9", 2), ("10 to 99", 1), ("100 to 999", 0),
        ("1,000 to 9,999", 0), ("10,000+", 0)]
    assert [r.bar_length for r in out] == [0, 35, 17, 0, 0, 0]
    # duplicates count in the histogram, collapse in the tier list
    assert D.repos_by_tier(df).count() == 2


def test_tier_walk_equals_global_top_k(spark):
    df = repos_df(spark, [(f"r{i}", v) for i, v in enumerate([5, 5, 50, -3, 0, 12000, 700, 700, 3])])
    tiers = D.repos_by_tier(df)
    # the walk: tiers high to low, each in (count DESC, repo ASC), early exit
    from commitlens.schemas import TIER_ORDER
    for n in (1, 3, 9, 20):
        walked = []
        for t in reversed(TIER_ORDER):
            if len(walked) >= n:
                break
            part = tiers.where(F.col("watch_tier") == t).orderBy(F.desc("watch_count"), "repo_name")
            walked += [(r.repo_name, r.watch_count) for r in part.limit(n - len(walked)).collect()]
        top = H.most_watched_overall(df, n).orderBy("rank").collect()
        assert [(r.repo_name, r.watch_count) for r in top] == walked[:n]


def test_ties_and_positive_only(spark):
    df = spark.createDataFrame([("a", 2), ("b", 2), ("c", 0), ("d", -1)], "name string, cnt bigint")
    asc = [r.name for r in R.top_k(df, "cnt", "name", 4).orderBy("rank").collect()]
    desc = [r.name for r in R.top_k(df, "cnt", "name", 4, ties="desc").orderBy("rank").collect()]
    assert asc == ["a", "b", "c", "d"] and desc == ["b", "a", "c", "d"]
    assert [r.name for r in R.top_k(df, "cnt", "name", 4, positive_only=True).collect()] in (["a", "b"], ["b", "a"])
    with pytest.raises(ValueError):
        R.top_k(df, "cnt", "name", 0)


def test_report_columns(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1)], "name string, cnt bigint")
    out = {r.name: r for r in R.with_report_columns(df, "cnt", 30, share=True).collect()}
    assert out["a"].bar_length == 30 and out["b"].bar_length == 10
    assert out["a"].share_of_top == 75.0 and out["b"].share_of_top == 25.0


def test_words(spark):
    df = spark.createDataFrame([("Fix the  BUG fix",), ("fix, fix",), ("ab\rc x",), ("a\U0001F600b",),
                                ("abc\n",), ("ab\ncd",), ("ok ok",)], "subject string")
    got = dict(rows(TX.word_counts(df), "word", "word_count"))
    assert got["fix"] == 3 and got["bug"] == 1 and got["fix,"] == 1
    assert got["ab\rc"] == 1 and got["a\U0001F600b"] == 1 and got["abc\n"] == 1
    assert "ab\ncd" not in got and "ok" not in got and "the" not in got and "" not in got
    top = TX.top_words(df, n=1).collect()
    assert top[0].word == "fix" and top[0].rank == 1 and top[0].bar_length == 35


def test_name_stats_empty_and_lengths(spark):
    empty = repos_df(spark, []).withColumn("name_length", F.lit(1).cast("bigint")).limit(0)
    assert N.name_stats(empty).count() == 0
    df = repos_df(spark, [("a\U0001F600b", 1), ("abcd", 2), ("x", 3)])
    st = N.name_stats(df).collect()[0]
    assert (st.min_length, st.max_length, st.total) == (1, 4, 3)
    assert [r.repo_name for r in N.longest_names(df, 2).orderBy("rank").collect()] == ["abcd", "a\U0001F600b"]
    assert [r.repo_name for r in N.shortest_names(df, 1).collect()] == ["x"]


def test_author_search_is_unicode_case_insensitive_regex(spark):
    from commitlens import schemas as S
    from commitlens.operators import lookup as L

    recs = [(h, "r", a, "", a, "s", "", "", [], 0) for h, a in
            [("h1", "Élodie"), ("h2", "élodie"), ("h3", "Bob"), ("h4", "bobby"), ("h5", "Eve")]]
    commits = spark.createDataFrame(recs, S.COMMITS)
    assert [r.commit_hash for r in L.search_author(commits, "ÉLO").collect()] == ["h1", "h2"]
    # the text is a pattern, matched anywhere in the name; first n by hash
    assert [r.commit_hash for r in L.search_author(commits, "^bob", n=1).collect()] == ["h3"]
    with pytest.raises(ValueError):
        L.search_author(commits, "x", n=0)


def test_average_is_a_raw_double(spark):
    df = repos_df(spark, [("ab", 1), ("abcd", 1), ("a", 1), ("abcdefg", 1)])
    st = N.name_stats(df).collect()[0]
    assert st.avg_length == 3.5 and isinstance(st.avg_length, float)
