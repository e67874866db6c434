"""Streams whose files would fill disks: what is staged and shuffled goes, and only what is needed is kept and moved."""

import gzip
import json
import os

import pytest

from commitlens import schemas as S
from commitlens.operators import derive as D
from commitlens.plans.queries import QUERIES
from commitlens.session import checkpoint_root
from commitlens.sources import bindings as B
from commitlens.sources import normalise as NM
from commitlens.streaming import counters as ST
from commitlens.streaming import tables as STT
from conftest import rows


def commit(h, subject, **more):
    return {"commit": h, "repo_name": "r", "author": {"name": "A"}, "subject": subject, **more}


def write_lines(folder, name, records, open=gzip.open):
    folder.mkdir(exist_ok=True)
    with open(folder / name, "wt") as f:
        f.write("".join(json.dumps(r) + "\n" for r in records))


def files_of(spark, purpose):
    base = f"{checkpoint_root(spark).removeprefix('file:')}/commitlens"
    return {f"{d}/{x}" for d, _, names in os.walk(base) for x in names if f"/{purpose}-" in d and x.startswith("part-")}


def shuffle_files(spark):
    """The shuffle data there are, with their bytes."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = disk.getAllFiles()
    files = [found.apply(i) for i in range(found.size())]
    return {x.getName(): x.length() for x in files if x.getName().startswith("shuffle_") and x.getName().endswith(".data")}


@pytest.fixture(scope="module")
def lineitem(spark, tmp_path_factory):
    """Line items, some of them twice, some parts with many of them."""
    out = tmp_path_factory.mktemp("sf")
    items = [(o, (o * o + n) % 40, o % 7, n, "ANR"[(o + n) % 3], "OF"[n % 2]) for o in range(200) for n in range(1, 1 + o % 5)]
    spark.createDataFrame(items + items[::9], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, l_linestatus string") \
        .repartition(6).write.parquet(f"{out}/lineitem.parquet")
    return str(out)


@pytest.mark.parametrize("name, purpose", [("stream_upsert", "stream-upsert"), ("stream_upsert_files", "stream-upsert"), ("stream_all_tables", "stream-tables")])
def test_staged_lines_records_and_shuffles_go(spark, lineitem, name, purpose):
    before, shuffled = files_of(spark, purpose), shuffle_files(spark)
    got = QUERIES[name](spark, lineitem)
    left = {x.removeprefix(checkpoint_root(spark)).split("/", 3)[3] for x in files_of(spark, purpose) - before}
    assert left and not [x for x in left if x.startswith(("source/", "sink/records/"))]
    # what is left are single numbers: the last mark
    assert sum(n for x, n in shuffle_files(spark).items() if x not in shuffled) < 1000
    latest = D.commits_latest_by_hash(NM.normalise_commits(B.commit_versions(spark, lineitem), keep=["seq"]), "seq")
    if name == "stream_all_tables":
        assert rows(got.where("table_name = 'commits'"), "repo_name", "key", "value") == rows(latest, "repo_name", "commit_hash", "author_name")
    else:
        assert rows(got.drop("files_changed")) == rows(latest.select(*[c for c in got.columns if c != "files_changed"]))


def test_staged_lines_are_compressed(spark, lineitem, monkeypatch):
    seen = {}

    def upsert(spark, source, *_):
        seen.update({x: os.path.getsize(f"{source.removeprefix('file:')}/{x}") for x in os.listdir(source.removeprefix("file:")) if x.startswith("part-")})
        return spark.createDataFrame([], "seq bigint")

    monkeypatch.setattr(ST, "stream_upsert", upsert)
    lines = spark.range(5000).selectExpr("to_json(struct(id, 'the same text again' AS subject)) AS value").coalesce(2)
    ST.stream_upsert_from(spark, lines, maxRecordsPerFile=1000)
    assert len(seen) == 6 and sum(seen.values()) < 5000 * 52 / 4


def test_last_line_wins_in_compressed_files_that_are_dealt_out(spark, tmp_path):
    src = tmp_path / "in"
    for k in range(3):
        write_lines(src, f"{k}.json.gz", [commit(f"h{(i * 7) % 50}", f"{k} {i}") for i in range(400)])
    write_lines(src, "3.json", [commit("h1", "plain"), commit("h2", "with", seq=1), commit("h2", "without")], open)
    want = {f"h{h}": max(f"2 {i:03}" for i in range(400) if (i * 7) % 50 == h) for h in range(50)} | {"h1": "plain", "h2": "with"}
    want = {h: " ".join(x.lstrip("0") or "0" for x in s.split()) for h, s in want.items()}
    for files in (1, 10):
        got = ST.stream_upsert(spark, str(src), f"{tmp_path}/o{files}", f"{tmp_path}/c{files}", files)
        assert {r.commit_hash: r.subject for r in got.collect()} == want


def test_a_table_in_one_folder_is_not_reduced_again(spark, tmp_path):
    src = tmp_path / "in"
    write_lines(src, "0.json.gz", [commit("a", "1"), commit("a", "2"), commit("b", "3")])
    args = (spark, str(src), f"{tmp_path}/o", f"{tmp_path}/c")
    once = ST.stream_upsert(*args)
    assert "Aggregate" not in once._jdf.queryExecution().optimizedPlan().toString()
    assert rows(once, "commit_hash", "subject") == [("a", "2"), ("b", "3")]
    write_lines(src, "1.json.gz", [commit("b", "4")])
    assert rows(ST.stream_upsert(*args), "commit_hash", "subject") == [("a", "2"), ("b", "4")]


def test_only_asked_for_columns_are_moved(spark, tmp_path):
    src = tmp_path / "in"
    for k in range(3):
        write_lines(src, f"{k}.json.gz", [commit("a", f"{k}"), commit(f"x{k}", "s", repo_name=f"r{k}")])
    stream = STT.CommitStream(spark, f"{tmp_path}/out")
    stream.run(str(src), f"{tmp_path}/cp")
    for name in ("commits", "commits_by_repo"):
        some = stream.read(name, ["commit_hash", "author_name"])
        assert "subject" not in some._jdf.queryExecution().executedPlan().toString()
        assert rows(some) == rows(stream.read(name), "commit_hash", "author_name") and some.count() == 4
    assert stream.read("commits").columns == S.COMMIT_COLUMNS


def test_folders_of_before_are_read(spark, tmp_path):
    """A log and a snapshot that keep file and place in the order, and seq beside it."""
    src, out = tmp_path / "in", f"{tmp_path}/o"
    write_lines(src, "0.json.gz", [commit("a", "0", seq=5), commit("b", "0")])
    args = (spark, str(src), out, f"{tmp_path}/c", 1, 2)
    assert ST.stream_upsert(*args).count() == 2
    now = spark.read.parquet(f"{out}/log/batch_id=0")
    old = now.selectExpr("_order.seq AS seq", "* EXCEPT (_order)", "struct(_order.seq, _order.batch, 'f' AS file, 0L AS block, 1L AS place) AS _order")
    records = old.collect()
    spark.createDataFrame(records, old.schema).write.mode("overwrite").parquet(f"{out}/log/batch_id=0")
    for k, more in enumerate(([commit("a", "1", seq=3), commit("b", "1")], [commit("b", "2", seq=1), commit("c", "2")]), 1):
        write_lines(src, f"{k}.json.gz", more)
        got = ST.stream_upsert(*args)
        assert {(r.commit_hash, r.seq, r.subject) for r in got.collect()} == [{("a", 5, "0"), ("b", None, "1")}, {("a", 5, "0"), ("b", 1, "2"), ("c", None, "2")}][k - 1]
    snapshot = spark.read.parquet(f"{out}/snapshot/upto=1")
    snapshot = spark.createDataFrame(snapshot.collect(), snapshot.schema)
    snapshot.drop("seq").selectExpr("_order.seq AS seq", "* EXCEPT (_order)", "struct(_order.seq, _order.batch, 'f' AS file, 0L AS block, 1L AS place) AS _order") \
        .write.mode("overwrite").parquet(f"{out}/snapshot/upto=1")
    assert {(r.commit_hash, r.seq, r.subject) for r in ST.stream_upsert(*args).collect()} == {("a", 5, "0"), ("b", 1, "2"), ("c", None, "2")}
