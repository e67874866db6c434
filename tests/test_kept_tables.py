"""Indexes and tables that are kept instead of recomputed, against the plain operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from commitlens import schemas as S
from commitlens.operators import author_index as AI
from commitlens.operators import changes as CH
from commitlens.operators import derive as D
from commitlens.operators import histograms as H
from commitlens.operators import lookup as L
from commitlens.operators import names as N
from commitlens.plans import bucketed as BK
from commitlens.plans import load as LD
from commitlens.sources import ndjson as J
from commitlens.sources import normalise as NM
from commitlens.streaming import counters as ST
from commitlens.streaming import tables as STT
from conftest import rows
from test_changes import changes_df


def commits_of(spark, authors):
    return spark.createDataFrame([(f"h{i:03}", "r", a, "", "c", "s", "", "", [], 0) for i, a in enumerate(authors)], S.COMMITS)


# --- author search -------------------------------------------------------
def test_needed_runs_are_in_every_match():
    cases = {"smith": ["smith"], "jo+hn": [], "John Sm.th": ["john sm"], "a.b": [], "(abc)+defg": ["defg"], "abcd?": ["abc"], "abc|def": [], "[abc]defgh": ["defgh"], "abc{2}de": [],
             r"x\.yz": ["x.yz"], r"abc\d+def": ["abc", "def"], "(?i)abc": [], r"\Qabc\E": [], "müller": ["ller"], "": [], "abcd*ef": ["abc"], "ab(cde|f)ghi": ["ghi"], "^start$": ["start"]}
    for pattern, want in cases.items():
        assert AI.needed_runs(pattern) == want, pattern


def test_indexed_search_equals_the_scan(spark, tmp_path):
    rng = random.Random(4)
    authors = [None, "", "ab", "Smith", "SMITH jr", "smıth", "ſmith", "Kelvin", "Kelvin", "İzmir", "a.b", "John [bot]", "müller", "MÜLLER", "x\ny", "naïve", "a|b", "日本語"]
    authors += ["".join(rng.choice("abcABC kKsSiI.-") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    commits = commits_of(spark, authors)
    AI.write_index(commits, f"{tmp_path}/i")
    patterns = ["smith", "kel", "KELVIN", "izm", "a.b", r"a\.b", "john", r"\[bot\]", "müller", "MÜL", "x", "", "(ab|c)k", "[a-c]{3}", "abc|cab", "^a", "k$", "ab+c", r"\bsmith\b", "s.ith", "bac", "日本"]
    patterns += [re.escape(rng.choice([a for a in authors if a])[:4]) for _ in range(10)]
    for p in patterns:
        for n in (3, 1000):
            assert rows(AI.search_author(commits, f"{tmp_path}/i", p, n), "commit_hash") == rows(L.search_author(commits, p, n), "commit_hash"), p
    with pytest.raises(ValueError):
        AI.search_author(commits, f"{tmp_path}/i", "x", 0)


# --- tiers and names -----------------------------------------------------
def test_tier_walk_reads_the_tiers_it_needs(spark, tmp_path):
    rng = random.Random(2)
    repos = [(f"r{i}", str(rng.choice([0, 3, 5, 40, 500, 20_000, -2, 9]))) for i in range(60)] + [("r1", "40")] * 3
    raw = spark.createDataFrame(repos, "repo_name string, watch_count string")
    paths = LD.load_all(spark, f"{tmp_path}/t", raw_repos=raw)
    by_tier, counts = spark.read.parquet(paths["repos_by_tier"]), spark.read.parquet(paths["tier_counts"])
    everything = H.most_watched_overall(NM.normalise_repos(raw), 1000)
    top = sum(int(w) >= 10_000 for _, w in repos)
    for n in (1, top, top + 1, 25, 1000):
        got, read = H.walk_tiers(by_tier, counts, n)
        assert rows(got, "rank", "repo_name", "watch_count", "watch_tier") == rows(everything.where(F.col("rank") <= n), "rank", "repo_name", "watch_count", "watch_tier")
        assert read == (["10,000+"] if n <= top else ["10,000+", "100 to 999"] if n == top + 1 else read)
    assert "1,000 to 9,999" not in H.walk_tiers(by_tier, counts, 1000)[1]  # empty: not read
    plan = by_tier.where("watch_tier = '10,000+'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(watch_tier" in plan and "PushedFilters: []" in plan
    none = H.walk_tiers(by_tier.limit(0), counts.limit(0), 5)
    assert none[0].collect() == [] and none[1] == []


def test_name_statistics_by_deltas(spark):
    rng = random.Random(3)
    names = ["n" * rng.randint(1, 12) + str(i) for i in range(80)]
    repos = spark.createDataFrame([(n, 0) for n in names], "repo_name string, watch_count bigint")
    counts = N.length_counts(repos)
    live = set(names)
    for _ in range(3):
        gone = set(rng.sample(sorted(live), 25)) | {max(live, key=len)}
        new = {"m" * rng.randint(1, 14) + str(rng.random()) for _ in range(5)}
        live = (live - gone) | new
        moves = spark.createDataFrame([(len(x), -1) for x in gone] + [(len(x), 1) for x in new], "name_length bigint, repo_count bigint")
        counts = spark.createDataFrame(CH.merge_counter_deltas(counts, moves, ["name_length"], "repo_count").collect(), "name_length bigint, repo_count bigint")
        now = spark.createDataFrame([(x, 0) for x in sorted(live)], "repo_name string, watch_count bigint")
        assert rows(N.stats_of_lengths(counts)) == rows(N.name_stats(now))
        assert rows(N.longest_by_counts(now, counts, 4)) == rows(N.longest_names(now, 4))
    assert N.stats_of_lengths(counts.limit(0)).collect() == [] and N.longest_by_counts(repos.limit(0), counts.limit(0)).collect() == []


# --- bucketed snapshot ---------------------------------------------------
def test_large_batch_leaves_the_bucketed_snapshot_where_it_is(spark, tmp_path):
    commits = commits_of(spark, [f"a{i % 9}" for i in range(200)])
    BK.write_bucketed(commits, f"{tmp_path}/b", 8)
    base = BK.read_bucketed(spark, f"{tmp_path}/b", 8)  # as another session would
    batch = changes_df(spark, [dict(op="delete", commit_hash=f"h{i:03}") for i in range(0, 200, 3)] + [dict(op="create", commit_hash="new", repo_name="r", author_name="z")])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ops = CH.sequence_changes(base, batch, n=None)
        ops = spark.createDataFrame(ops.collect(), ops.schema)
        snapshot = CH.finalize_sequence(base, ops)[0]
        plan = snapshot._jdf.queryExecution().executedPlan().toString().split("\n")
        scan = next(i for i, line in enumerate(plan) if "FileScan" in line and "Bucketed: true" in line)
        depth = plan[scan].index("FileScan")
        above = []  # the operators on the way from the scan to the root
        for line in reversed(plan[:scan]):
            own = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if own < depth:
                above.append(line)
                depth = own
        assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above)
        assert rows(snapshot, "commit_hash", "author_name") == rows(CH.apply_changes(commits, batch).snapshot, "commit_hash", "author_name")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


# --- one stream, several tables -------------------------------------------
def write_lines(path, name, records):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(records) + "\n")


def line(h, repo, author, seq=None, subject="s"):
    return '{"commit":"%s","repo_name":"%s","author":{"name":"%s"},"subject":"%s"%s}' % (h, repo, author, subject, "" if seq is None else ',"seq":%d' % seq)


def test_a_crash_between_two_tables_is_replayed(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    src = tmp_path / "src"
    everything = []
    for k in range(5):
        own = [line(f"h{rng.randrange(30)}", f"r{rng.randrange(3)}", f"a{rng.randrange(5)}", rng.choice([None, rng.randrange(10_000)])) for _ in range(20)] + ["not json"]
        write_lines(src, f"{k}.json", own)
        everything += own
    stream = STT.CommitStream(spark, f"{tmp_path}/out", compact_every=2)
    sink, part = stream.sinks["author_counts"]

    def failing(batch, batch_id, write=sink.write):
        if batch_id == 2:
            raise RuntimeError("lost")
        write(batch, batch_id)

    with monkeypatch.context() as m:
        m.setattr(sink, "write", failing)
        with pytest.raises(Exception, match="lost"):
            stream.run(f"{src}", f"{tmp_path}/cp")
    assert stream.done() == 1
    first_two = [x for k in (0, 1) for x in (src / f"{k}.json").read_text().splitlines()]
    # the commits of the failed micro-batch are written, but no table shows them
    seen = stream.read("author_counts").agg(F.sum("commit_count")).first()[0]
    assert seen == sum("commit" in x for x in first_two) and stream.read("commits").count() == len({x.split('"')[3] for x in first_two if "commit" in x})
    stream.run(f"{src}", f"{tmp_path}/cp")
    lines = spark.createDataFrame([(x,) for x in everything], "value string")
    recs = NM.normalise_commits(J.accepted(J.classify_ndjson(lines, S.RAW_COMMIT, ["commit", "repo_name"])))
    assert rows(stream.read("author_counts")) == rows(D.author_counts(recs))
    assert rows(stream.read("repos_loaded")) == rows(D.loaded_repos(recs))
    assert rows(stream.read("commits"), "commit_hash") == rows(recs.select("commit_hash").distinct())
    by_repo = stream.read("commits_by_repo")
    assert by_repo.count() == recs.select("repo_name", "commit_hash").distinct().count()
    # each commit is the version that the table by repository has of it
    assert stream.read("commits").join(by_repo, ["repo_name", "commit_hash", "author_name", "subject"], "left_anti").count() == 0


def test_compacted_folders_are_removed(spark, tmp_path):
    src = tmp_path / "src"
    for k in range(9):
        write_lines(src, f"{k}.json", [line(f"h{k}", "r", "a", k), line("h0", "r", f"b{k}", 100 + k)])
    got = ST.stream_upsert(spark, f"{src}", f"{tmp_path}/out", f"{tmp_path}/cp", compact_every=2)
    assert got.count() == 9 and got.where("commit_hash = 'h0'").first().author_name == "b8"
    log = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out/log").glob("batch_id=*"))
    assert log == [6, 7, 8] and sorted(p.name for p in (tmp_path / "out/snapshot").glob("upto=*")) == ["upto=5", "upto=7"]
    write_lines(src, "z.json", [line("h0", "r", "last", 500)])
    again = ST.stream_upsert(spark, f"{src}", f"{tmp_path}/out", f"{tmp_path}/cp", compact_every=2)
    assert again.where("commit_hash = 'h0'").first().author_name == "last" and again.count() == 9


# --- loads ----------------------------------------------------------------
def test_null_missing_and_repeated_order_values(spark, tmp_path):
    """A load keeps a whole record of every hash, whatever its order values."""
    rng = random.Random(6)
    records = [(rng.choice([None, None, 1, 2, 3]), f"h{rng.randrange(12)}", f"r{rng.randrange(2)}", f"s{i}") for i in range(60)]
    raw = spark.createDataFrame([(s, h, r, (f"a{i}", None), None, None, x, None, None) for i, (s, h, r, x) in enumerate(records)],
                                "seq bigint, commit string, repo_name string, author struct<name string, email string>, committer struct<name string>, "
                                "difference array<struct<new_path string>>, subject string, message string, tree string")
    got = {r.commit_hash: r for r in spark.read.parquet(LD.load_all(spark, f"{tmp_path}/l", raw_commits=raw)["commits"]).collect()}
    assert set(got) == {h for _, h, _, _ in records}
    for h, r in got.items():
        best = max(-1 if s is None else s for s, k, _, _ in records if k == h)
        assert r.subject in {x for s, k, _, x in records if k == h and (-1 if s is None else s) == best} and r.repo_name and r.author_name
    pairs = spark.read.parquet(f"{tmp_path}/l/commits_by_repo")
    assert pairs.where("subject IS NULL").count() == 0 and pairs.count() == len({(r, h) for _, h, r, _ in records})


def test_lines_are_parsed_once(spark):
    """The plan holds one parse of every line; the others are for odd lines."""
    lines = spark.createDataFrame([("x", 1)], "value string, k int")
    classified = J.classify_ndjson(lines, S.RAW_COMMIT, ["commit", "repo_name"])
    plan = NM.normalise_commits(J.accepted(classified))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("from_json") <= 13
    keep = NM.normalise_commits(J.accepted(classified, keep_line=True), nulls="keep")._jdf.queryExecution().optimizedPlan().toString()
    assert keep.count("parseJson") == 2 and keep.count("from_json") <= 13


def test_integers_are_cut_towards_zero(spark):
    cases = {"7.99999999": 7, "-7.9999999": -7, "0.9999999999999999999": 1, "1e2": 100, "1.5e1": 15, "-0.5": 0, "true": 1, "false": 0, "1e400": 0, "12345678901234567890": 0, "9007199254740993.0": 9007199254740992}
    lines = spark.createDataFrame([('{"repo_name":"%s","watch_count":%s}' % (k, k),) for k in cases], "value string")
    got = dict(rows(NM.normalise_repos(J.accepted(J.classify_ndjson(lines, S.RAW_REPO, ["repo_name"]))), "repo_name", "watch_count"))
    assert got == cases
