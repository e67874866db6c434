"""The ranged commit store: what a batch rewrites, and that every version equals a recompute."""

import os
import random

import pytest
from pyspark.sql import functions as F

from commitlens import schemas as S
from commitlens.operators import changes as CH
from commitlens.operators import derive as D
from commitlens.plans import store as ST
from conftest import rows
from test_changes import changes_df


def commits_df(spark, n, repos=7, authors=30, seed=1):
    rng = random.Random(seed)
    data = [(f"h{i}", f"r{rng.randrange(repos)}", f"a{min(rng.randrange(authors), rng.randrange(authors))}", "", "c", f"s{i}", "", "", [], i) for i in range(n)]
    return spark.createDataFrame(data, S.COMMITS)


def folders(path, table, version):
    base = f"{path}/{table}/data/version={version}"
    return sorted(x for x in os.listdir(base) if x.startswith("range=")) if os.path.isdir(base) else []


def check(store, commits):
    """Every table equals a recompute from the snapshot."""
    assert rows(store.read("commits"), "commit_hash", "repo_name", "author_name", "subject") == rows(commits, "commit_hash", "repo_name", "author_name", "subject")
    assert rows(store.read("commits_by_repo")) == rows(D.commits_by_repo(commits).select(*ST.BY_REPO.fieldNames()))
    counts = D.author_counts(commits)
    assert rows(store.read("author_counts")) == rows(counts)
    assert rows(store.repos_loaded()) == rows(D.loaded_repos(commits))
    best = sorted((r["repo_name"], -r["commit_count"], r["author_name"]) for r in counts.collect())
    want = []
    for repo in sorted({b[0] for b in best}):
        want += [(repo, a, -c, k + 1) for k, (_, c, a) in enumerate([b for b in best if b[0] == repo][:ST.TOP])]
    assert rows(store.top_contributors()) == sorted(want)


def test_one_change_rewrites_one_range(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = ST.CommitStore.create(spark, path, commits_df(spark, 500), ranges=16)
    local = f"{tmp_path}/store"
    assert len(folders(local, "commits", 0)) == 16
    before = {f for _, _, fs in os.walk(f"{local}/commits/data/version=0") for f in fs}
    status = store.apply(changes_df(spark, [dict(op="update", commit_hash="h7", field="subject", value="new")]))
    assert [r.status for r in status.collect()] == ["updated"] and store.version == 1
    assert len(folders(local, "commits", 1)) == 1 and len(folders(local, "commits_by_repo", 1)) == 1
    assert not folders(local, "author_counts", 1) and not folders(local, "repo_commits", 1)  # the subject is not counted
    assert {f for _, _, fs in os.walk(f"{local}/commits/data/version=0") for f in fs} == before
    assert store.read("commits").where("subject = 'new'").count() == 1 and store.read("commits").count() == 500
    assert store.read("commits", 0).where("subject = 'new'").count() == 0  # the older version is still there
    store.apply(changes_df(spark, [dict(op="delete", commit_hash="h9")]))
    assert [len(folders(local, t, 2)) for t in ("commits", "author_counts", "repo_commits")] == [1, 1, 1]
    assert ST.CommitStore(spark, path).version == 2


def test_batches_equal_a_recompute(spark, tmp_path, monkeypatch):
    """Random batches; a small top so that deletes use up the reserve and repositories are filled anew."""
    monkeypatch.setattr(ST, "TOP", 3)
    monkeypatch.setattr(ST, "RESERVE", 1)
    rng = random.Random(7)
    commits = commits_df(spark, 160, repos=3, authors=12)
    store = ST.CommitStore.create(spark, f"{tmp_path}/s", commits, ranges=5)
    for step in range(4):
        items = []
        for _ in range(40):
            h = f"h{rng.randrange(200)}"
            items.append(rng.choice([dict(op="delete", commit_hash=h), dict(op="delete", commit_hash=h), dict(op="create", commit_hash=h, repo_name=f"r{rng.randrange(4)}", author_name=f"a{rng.randrange(12)}"),
                                     dict(op="update", commit_hash=h, field="author_name", value=f"a{rng.randrange(12)}"), dict(op="update", commit_hash=h, field="repo_name", value=f"r{rng.randrange(4)}"),
                                     dict(op="bogus", commit_hash=h), dict(op="update", commit_hash=" " + h, field="subject", value="x")]))
        batch = changes_df(spark, items)
        res = CH.apply_changes(commits, batch)
        want = rows(res.status)
        commits = spark.createDataFrame(res.snapshot.collect(), S.COMMITS)
        assert rows(store.apply(batch)) == want
        check(store, commits)


def test_everything_deleted_and_created_again(spark, tmp_path):
    commits = commits_df(spark, 20, repos=2, authors=3)
    store = ST.CommitStore.create(spark, f"{tmp_path}/s", commits, ranges=4)
    store.apply(changes_df(spark, [dict(op="delete", commit_hash=f"h{i}") for i in range(20)]))
    assert store.read("commits").isEmpty() and store.repos_loaded().isEmpty() and store.top_contributors().isEmpty()
    assert rows(store.repos_loaded(sticky=True)) == [("r0",), ("r1",)]
    store.apply(changes_df(spark, [dict(op="create", commit_hash="n", repo_name="r1", author_name="z")]))
    check(store, store.read("commits"))
    store.apply(changes_df(spark, []))
    assert store.version == 3 and store.read("commits").count() == 1


def test_half_written_version_is_replaced(spark, tmp_path, monkeypatch):
    store = ST.CommitStore.create(spark, f"{tmp_path}/s", commits_df(spark, 50), ranges=4)
    batch = changes_df(spark, [dict(op="delete", commit_hash="h1"), dict(op="create", commit_hash="x", repo_name="r", author_name="q")])
    with monkeypatch.context() as m:
        m.setattr(ST.CommitStore, "_move_counts", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.apply(batch)
    again = ST.CommitStore(spark, f"{tmp_path}/s")
    assert again.version == 0 and again.read("commits").count() == 50
    again.apply(batch)
    check(again, again.read("commits"))
    assert again.read("commits").where("commit_hash IN ('h1', 'x')").count() == 1


def test_only_touched_ranges_are_read(spark, tmp_path):
    store = ST.CommitStore.create(spark, f"{tmp_path}/s", commits_df(spark, 300), ranges=8)
    keys = spark.createDataFrame([("h5",), ("h5",), (None,), ("absent",)], "commit_hash string")
    found = store.lookup(keys)
    assert [r["commit_hash"] for r in found.collect()] == ["h5"]
    assert 1 <= len(found.inputFiles()) <= 2
    many = spark.range(200).select(F.concat(F.lit("h"), "id").alias("commit_hash"))
    assert store.lookup(many).count() == 200


def test_bloom_filter_skips_absent_keys(spark, tmp_path):
    """An absent key inside the range of a file's keys: no row group is read."""
    store = ST.CommitStore.create(spark, f"{tmp_path}/s", commits_df(spark, 400), ranges=1)

    def rows_scanned(key):
        df = store.lookup(spark.createDataFrame([(key,)], "commit_hash string"))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().head()
        return leaf.metrics().apply("numOutputRows").value()

    assert rows_scanned("h17") > 0 and rows_scanned("h17x") == 0


def test_command_line(spark, tmp_path, capsys):
    from commitlens.__main__ import main

    commits_df(spark, 40).write.parquet(f"{tmp_path}/tables/commits")
    (tmp_path / "changes.json").write_text('{"seq":1,"op":"update","commit_hash":"h3","field":"subject","value":"edited"}\n{"op":\n')
    assert main(["store", "--tables", f"{tmp_path}/tables", "--out", f"{tmp_path}/store", "--ranges", "4"]) == 0
    assert main(["apply", "--tables", f"{tmp_path}/store", "--changes", f"{tmp_path}/changes.json"]) == 0
    out = capsys.readouterr().out
    assert "version 1" in out and "updated" in out and "malformed" in out
    assert main(["read", "--tables", f"{tmp_path}/store", "--hash", "h3"]) == 0
    assert "edited" in capsys.readouterr().out
    assert main(["report", "activity", "--tables", f"{tmp_path}/store", "--repo", "r1"]) == 0
    assert "commit_count" in capsys.readouterr().out
