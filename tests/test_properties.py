"""Operators against brute-force Python versions of the same rules."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from commitlens import schemas as S
from commitlens.operators import derive as D
from commitlens.operators import histograms as H
from commitlens.operators import ranking as R

SETTINGS = settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
NAMES = st.sampled_from(["a", "b", "c", "d", "e", "É", "aa"])


def py_top_k(rows, n, ties, positive_only):
    rows = [r for r in rows if not positive_only or r[1] > 0]
    # name order first (stable sort), then value descending
    rows = sorted(rows, key=lambda r: r[0], reverse=(ties == "desc"))
    rows = sorted(rows, key=lambda r: -r[1])
    return [(r[0], r[1], i + 1) for i, r in enumerate(rows[:n])]


@SETTINGS
@given(st.dictionaries(NAMES, st.integers(-3, 5), max_size=7), st.integers(1, 8),
       st.sampled_from(["asc", "desc"]), st.booleans())
def test_top_k_matches_sort(spark, counts, n, ties, positive_only):
    rows = sorted(counts.items())
    df = spark.createDataFrame(rows or [("x", 0)], "name string, cnt bigint")
    if not rows:
        df = df.limit(0)
    got = [(r.name, r.cnt, r["rank"]) for r in
           R.top_k(df, "cnt", "name", n, ties=ties, positive_only=positive_only).orderBy("rank").collect()]
    assert got == py_top_k(rows, n, ties, positive_only)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["g1", "g2"]), NAMES, st.integers(0, 4)), max_size=15), st.integers(1, 3))
def test_per_group_top_k_matches_sort(spark, triples, n):
    counts = {}
    for g, name, v in triples:
        counts[(g, name)] = v
    rows = [(g, name, v) for (g, name), v in sorted(counts.items())]
    df = spark.createDataFrame(rows or [("g", "x", 0)], "g string, name string, cnt bigint")
    if not rows:
        df = df.limit(0)
    got = sorted((r.g, r.name, r.cnt, r["rank"]) for r in R.top_k(df, "cnt", "name", n, partition_by="g").collect())
    want = []
    for g in sorted({r[0] for r in rows}):
        want += [(g, name, v, k) for name, v, k in py_top_k([(r[1], r[2]) for r in rows if r[0] == g], n, "asc", False)]
    assert got == sorted(want)


def py_tier(v):
    for low, high, label in S.WATCH_TIERS:
        if v >= low and (high is None or v <= high):
            return label
    return S.TIER_FALLBACK


def py_bucket(v):
    b = S.BUCKET_BOUNDARIES
    for low, high in zip(b[:-1], b[1:]):
        if low <= v < high:
            return S.BUCKET_LABELS[low]
    return S.BUCKET_DEFAULT


@SETTINGS
@given(st.lists(st.integers(-50, 2_000_000), min_size=1, max_size=30))
def test_tier_and_bucket_labels(spark, values):
    df = spark.createDataFrame([(f"r{i}", v) for i, v in enumerate(values)], "repo_name string, watch_count bigint")
    tiers = {r.repo_name: r.watch_tier for r in D.with_tier(df).collect()}
    assert tiers == {f"r{i}": py_tier(v) for i, v in enumerate(values)}
    hist = {r.watch_range: r.repo_count for r in H.bucket_histogram(df).collect()}
    want = {}
    for v in values:
        want[py_bucket(v)] = want.get(py_bucket(v), 0) + 1
    assert hist == want
    dense = {r.watch_tier: r.repo_count for r in H.tier_histogram(df).collect()}
    assert dense == {t: sum(1 for v in values if py_tier(v) == t) for t in S.TIER_ORDER}


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["k1", "k2", "k3"]), st.text("xyz", max_size=3)), min_size=1, max_size=20))
def test_latest_by_key_is_last_write(spark, writes):
    rows = [(i, k, v) for i, (k, v) in enumerate(writes)]
    df = spark.createDataFrame(rows, "seq bigint, k string, v string")
    got = {r.k: r.v for r in D.latest_by_key(df, ["k"], "seq").collect()}
    want = {}
    for _, k, v in rows:
        want[k] = v
    assert got == want
