"""Round 4: change batches, stores and loads without seq do each wide step once."""

import pytest
from pyspark.sql import functions as F

from commitlens import schemas as S
from commitlens.operators import changes as CH
from commitlens.operators import derive as D
from commitlens.plans import load as LD
from commitlens.plans import store as SO
from commitlens.sources import bindings as B
from conftest import SF_SMALL, rows
from test_changes import changes_df


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    """Plans without adaptive execution, nothing broadcast by size."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def commit(h, repo, author, files=("p",)):
    return (h, repo, author, "", author, "s", "", "", list(files), len(files))


# --- F4, F5, F6, F9: the batch is derived once, its summary shuffled once ---
def test_batch_is_derived_once(spark):
    base = spark.createDataFrame([commit("c1", "r", "A")], S.COMMITS)
    seen = spark.sparkContext.accumulator(0)

    def count(rows_):
        for r in rows_:
            seen.add(1)
            yield r

    batch = spark.createDataFrame(changes_df(spark, [dict(op="create", commit_hash=f"n{i}", repo_name="r", author_name="B") for i in range(40)]).rdd.mapPartitions(count), S.CHANGES)
    res = CH.apply_changes(base, batch)
    assert res.snapshot.count() == 41 and res.status.count() == 40 and rows(res.deltas) == [("r", "B", 40)]
    assert seen.value == 40


def test_summary_of_a_batch_is_shuffled_once(shuffled, tmp_path):
    base = B.commits_table(shuffled, SF_SMALL)
    log = f"{tmp_path}/log"
    CH.sequence_changes(base, B.mixed_changes(shuffled, SF_SMALL)).write.parquet(log)
    p = plan(CH.finalize_sequence(base, shuffled.read.parquet(log))[0])
    assert sum("SortAggregate" in x and "partial_max(_existed" in x for x in p.split("\n")) == 1 and "ReusedExchange" in p


def test_placing_changes_in_runs_does_not_grow_with_the_runs(spark):
    ops = spark.range(0, 3000, 3).select(F.col("id").alias("seq")).union(spark.range(1).select(F.lit(2**62)))
    sizes = []
    for chunk in (500, 10):
        placed = ops.withColumn("run", CH._chunks(ops, chunk, 1000))
        runs = [r["count"] for r in placed.groupBy("run").count().orderBy("run").collect()]
        assert len(runs) == 1000 // chunk and max(runs) <= 2 * chunk
        assert placed.agg(F.count_distinct("run")).first()[0] == len(runs)
        bounds = placed.groupBy("run").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("run").collect()
        assert all(x.b < y.a for x, y in zip(bounds, bounds[1:]))
        sizes.append(placed._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN"))
    assert sizes[0] == sizes[1]


def test_changes_without_a_hash_or_place(spark):
    base = spark.createDataFrame([commit("c1", "r", "A"), commit("c2", "r", "A")], S.COMMITS)
    items = [dict(op="delete", commit_hash=None), dict(op="create", commit_hash=None, repo_name="r", author_name="A"), dict(op="delete", commit_hash="c1"), dict(op="delete", commit_hash="c2"),
             dict(op="update", commit_hash="c2", field="subject", value="x")]
    batch = changes_df(spark, items).withColumn("seq", F.when(F.col("seq") == 4, F.lit(3)).otherwise(F.col("seq")).cast("bigint"))
    for most in (CH.BROADCAST_KEYS, 0):  # few changes share a seq; too many to broadcast
        with pytest.MonkeyPatch.context() as m:
            m.setattr(CH, "BROADCAST_KEYS", most)
            res = CH.apply_changes(base, batch)
            assert rows(res.status, "seq", "status") == [(0, "not_found"), (1, "invalid"), (2, "deleted"), (3, "invalid"), (3, "invalid")]
            assert [(r.commit_hash, r.subject) for r in res.snapshot.collect()] == [("c2", "s")] and rows(res.deltas) == [("r", "A", -1)]


def test_large_range_is_written_by_several_tasks(spark, tmp_path):
    n = 4000
    rows_ = spark.range(n).select(*[F.sha2(F.concat(F.lit(f"{c}-"), F.col("id").cast("string")), 512).alias(c) if isinstance(t, str) else F.lit(None).cast(t).alias(c)
                                    for c, t in [(f.name, f.dataType.simpleString() if f.dataType.simpleString() == "string" else f.dataType) for f in S.COMMITS.fields]])
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "50k"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        table = SO.RangedTable(spark, str(tmp_path), "commits", 2)
        table.write(rows_.repartition(16), 0)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = table.read(0)
    assert got.count() == n and got.select("commit_hash").distinct().count() == n
    files = got.select(F.input_file_name().alias("f")).distinct().count()
    assert files > 4


# --- F7: records without seq are put in order once ---
def test_records_of_a_load_without_seq_are_ordered_once(spark, shuffled):
    commits = spark.createDataFrame([commit("c1", "r", "A"), commit("c1", "r", "B"), commit("c1", "q", "Z"), commit("c2", "r", "A"), commit("c2", "r", "A")], S.COMMITS)
    records = spark.createDataFrame(LD.greatest_records(commits).collect(), LD.greatest_records(commits).schema)
    for most in (CH.BROADCAST_KEYS, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(CH, "BROADCAST_KEYS", most)
            got, want = LD.derive_tables(commits=commits, kept=records), LD.derive_tables(commits=commits)
            for name in want:
                assert rows(got[name]) == rows(want[name]), name
    assert rows(want["commits"], "commit_hash", "repo_name", "author_name") == [("c1", "r", "B"), ("c2", "r", "A")]
    assert "Exchange" not in plan(got["commits_by_repo"]) and "collect_list" not in plan(got["author_counts"])
    one = LD.derive_tables(commits=commits, kept=records.where("repo_name = 'r'"))
    assert "Exchange" not in plan(one["commits"])


def test_load_derives_file_lists_once(spark, tmp_path, monkeypatch):
    raw = B.raw_commits(spark, SF_SMALL)
    plans = []
    monkeypatch.setattr(LD, "write_tables", lambda tables, out, **k: plans.extend(plan(t) for t in tables.values()) or {})
    LD.load_all(spark, f"{tmp_path}/out", raw_commits=raw.unionByName(raw))
    assert len(plans) == 4 and not any("collect_list" in p for p in plans)


def test_customers_do_not_shuffle_file_lists(shuffled):
    p = plan(B.commits_table(shuffled, SF_SMALL)).split("\n")
    first = next(x for x in p if "SortMergeJoin" in x)  # the plan prints the last join first
    assert "l_orderkey" in first and "o_custkey" not in first
    assert rows(D.author_counts(B.commits_table(shuffled, SF_SMALL))) == rows(D.author_counts(shuffled.createDataFrame(B.commits_table(shuffled, SF_SMALL).collect(), S.COMMITS)))
