"""Streams, sessions and plans: re-runs, compaction, settings, small batches."""

import json

import pytest

from commitlens import schemas as S
from commitlens import session as SE
from commitlens.operators import changes as CH
from commitlens.operators import lookup as L
from commitlens.plans import load as LD
from commitlens.streaming import counters as ST
from conftest import rows


def write_lines(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))


def commit(h, subject, **more):
    return {"commit": h, "repo_name": "r", "author": {"name": "A"}, "subject": subject, **more}


def test_streams_run_again_and_compact(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    args = (spark, str(src), out, cp, 1, 2)
    for day in range(5):
        write_lines(src, f"{day}.json", [commit("a", f"a{day}"), commit(f"x{day}", "one"), commit("a", f"a{day} again")])
        got = {r.commit_hash: r.subject for r in ST.stream_upsert(*args).collect()}
        assert got == {"a": f"a{day} again", **{f"x{d}": "one" for d in range(day + 1)}}
    again = {r.commit_hash: r.subject for r in ST.stream_upsert(*args).collect()}
    assert again == got
    log = ST.BatchLog(spark, out, ST._last_versions, 2)
    assert log._mark() == 3
    third = spark.read.parquet(f"{out}/log/batch_id=3")
    log.write(spark.createDataFrame(third.collect(), third.schema), 3)  # a replayed micro-batch
    assert {r.commit_hash: r.subject for r in log.read().collect()} == got


def test_upsert_with_and_without_seq(spark, tmp_path):
    src = tmp_path / "in"
    write_lines(src, "0.json", [commit("a", "new", seq=9), commit("b", "plain")])
    write_lines(src, "1.json", [commit("a", "old", seq=3), commit("a", "none"), commit("b", "later")])
    got = ST.stream_upsert(spark, str(src), str(tmp_path / "o"), str(tmp_path / "c"), 10)
    assert {r.commit_hash: r.subject for r in got.collect()} == {"a": "new", "b": "later"}


def test_compacted_counters(spark, tmp_path):
    src = tmp_path / "in"
    for day in range(4):
        write_lines(src, f"{day}.json", [commit(f"{day}{i}", "s") for i in range(day + 1)])
    args = (spark, str(src), S.RAW_COMMIT, ["commit"], lambda r: r.groupBy("repo_name").count(), ["repo_name"], str(tmp_path / "o"), str(tmp_path / "c"))
    for _ in range(2):
        assert rows(ST.stream_counts(*args, max_files_per_trigger=1, compact_every=2)) == [("r", 10)]


def test_session_settings(spark, monkeypatch):
    assert SE.is_local("local") and SE.is_local("local[8]") and not SE.is_local("local-cluster[2,1,1024]") and not SE.is_local("yarn")

    class Context:
        master = "yarn"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        SE.checkpoint_root(Session())
    seen = {}

    class Builder:
        def appName(self, _):
            return self

        def config(self, map):
            seen.update(map)
            return self

        def getOrCreate(self):
            return spark

    class Conf:
        def getAll(self):
            return [("spark.master", "yarn"), ("spark.sql.shuffle.partitions", "4000")]

    monkeypatch.setattr(SE, "SparkConf", Conf)
    monkeypatch.setattr(SE.SparkSession, "builder", Builder())
    SE.build_session(total_cores=8000)
    assert "spark.master" not in seen and "spark.sql.shuffle.partitions" not in seen
    assert seen["spark.sql.files.maxPartitionBytes"] == str(256 << 20)


def test_missing_sources(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        LD.load_from_files(spark, str(tmp_path), str(tmp_path / "o"))
    (tmp_path / "Licenses.json").write_text('{"repo_name":"r","license":"mit"}\n{"repo_name":"s","license":"mit"}\n')
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        LD.load_from_files(spark, str(tmp_path), str(tmp_path / "o"), sources=["licenses", "repos"])
    paths = LD.load_from_files(spark, f"file://{tmp_path}", str(tmp_path / "o"), transform={"licenses": lambda d: d.where("repo_name = 's'")})
    assert rows(spark.read.parquet(paths["license_counts"])) == [("mit", 1)]
    assert ("licenses", "accepted", 2) in rows(spark.read.parquet(paths["rejects"]), "source", "outcome", "line_count")


def test_change_job_keeps_all_tables(spark, tmp_path):
    base = [dict(commit_hash=h, repo_name=r, author_name="A", author_email="", committer_name="A", subject="s", message="", tree="", files_changed=[],
                 num_files_changed=0) for h, r in [("1", "r"), ("2", "q")]]
    old = f"{tmp_path}/old"
    commits = spark.createDataFrame(base, S.COMMITS)
    LD.write_tables({"commits": commits, "repos_loaded": commits.select("repo_name").distinct(), "license_counts": spark.createDataFrame([("mit", 2)], "license_name string, repo_count bigint")}, old)
    (tmp_path / "c.json").write_text('{"seq":1,"op":"delete","commit_hash":"2"}\n{"op":"delete","commit_hash":"1"}\n')
    paths = LD.apply_change_file(spark, old, f"{tmp_path}/c.json", f"{tmp_path}/new", sticky_repos=True)
    assert rows(spark.read.parquet(paths["repos_loaded"])) == [("q",), ("r",)]
    assert rows(spark.read.parquet(paths["license_counts"])) == [("mit", 2)]
    assert rows(spark.read.parquet(paths["change_status"]), "commit_hash", "status") == [("1", "invalid"), ("2", "deleted")]
    assert rows(spark.read.parquet(paths["commits"]), "commit_hash") == [("1",)]


@pytest.mark.parametrize("what", ["lookup", "creates", "updates", "deletes", "changes"])
def test_small_batches_do_not_move_the_snapshot(spark, tmp_path, what):
    wide = spark.range(20_000).selectExpr("cast(id as string) commit_hash", "'r' repo_name", "'A' author_name", "'' author_email", "'A' committer_name",
                                          "repeat(cast(id as string), 30) subject", "'' message", "'' tree", "array('p') files_changed", "1L num_files_changed")
    path = f"{tmp_path}/snapshot"
    wide.write.parquet(path)
    base = spark.read.parquet(path)
    made = spark.createDataFrame([(1, what[:-1] if what != "changes" else "delete", "7", "subject", "x", "r", "A", "s", "m")], S.CHANGES)
    made.write.parquet(f"{tmp_path}/batch")
    batch = spark.read.parquet(f"{tmp_path}/batch")  # a size that Spark knows
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(100_000))
    try:
        df = {"lookup": lambda: L.lookup(base, batch.select("commit_hash")), "creates": lambda: CH.apply_creates(base, batch).snapshot,
              "updates": lambda: CH.apply_updates(base, batch).snapshot, "deletes": lambda: CH.apply_deletes(base, batch).snapshot,
              "changes": lambda: CH.apply_changes(base, batch).snapshot}[what]()
        assert df.count() in (1, 19_999, 20_000)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan.split("Initial Plan")[0]
        # no exchange carries the records of the snapshot
        assert not [x for x in final.splitlines() if "Exchange hashpartitioning" in x and "_old_" in x], plan
        for i, x in enumerate(final.splitlines()):
            if "FileScan" in x and "subject" in x and "snapshot" in x:
                above = [y for y in final.splitlines()[:i] if len(y) - len(y.lstrip(" :+-")) < len(x) - len(x.lstrip(" :+-"))]
                assert "Exchange" not in "".join(above[-3:]), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
