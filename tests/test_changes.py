from pyspark.sql import functions as F

from commitlens import schemas as S
from commitlens.operators import changes as CH
from commitlens.operators import derive as D
from commitlens.sources import bindings as B
from conftest import SF_SMALL, rows


def base_df(spark):
    return spark.createDataFrame(
        [("c1", "r", "A", "", "A", "s", "", "", ["p"], 1)], S.COMMITS)


def changes_df(spark, items):
    out = []
    for i, ch in enumerate(items):
        row = dict(seq=i, op=None, commit_hash=None, field=None, value=None, repo_name=None,
                   author_name=None, subject=None, message=None)
        row.update(ch)
        out.append(row)
    return spark.createDataFrame(out, S.CHANGES)


def status_of(res):
    return [r.status for r in res.status.orderBy("seq").collect()]


def test_create_if_absent_and_upsert(spark):
    base = base_df(spark)
    batch = changes_df(spark, [
        dict(op="create", commit_hash="c1", repo_name="r", author_name="B", subject="x"),
        dict(op="create", commit_hash="n1", repo_name="r", author_name="  ", subject="x"),
        dict(op="create", commit_hash=" n2 ", repo_name="r", author_name="C", subject="first"),
        dict(op="create", commit_hash="n2", repo_name="r", author_name="D", subject="second"),
    ])
    res = CH.apply_creates(base, batch, "if_absent")
    assert status_of(res) == ["duplicate", "invalid", "created", "duplicate"]
    snap = {r.commit_hash: r for r in res.snapshot.collect()}
    assert set(snap) == {"c1", "n2"} and snap["n2"].subject == "first"
    assert snap["n2"].committer_name == "C" and snap["n2"].files_changed == [] and snap["c1"].author_name == "A"
    assert rows(res.deltas) == [("r", "C", 1)]

    up = CH.apply_creates(base, batch, "upsert")
    assert status_of(up) == ["created", "invalid", "created", "created"]
    snap = {r.commit_hash: r for r in up.snapshot.collect()}
    assert snap["c1"].author_name == "B" and snap["n2"].subject == "second"
    # unconditional writes bump the counter every time
    merged = CH.merge_counter_deltas(D.author_counts(base), up.deltas)
    assert rows(merged) == [("r", "A", 1), ("r", "B", 1), ("r", "C", 1), ("r", "D", 1)]
    assert rows(D.author_counts(up.snapshot)) == [("r", "B", 1), ("r", "D", 1)]


def test_update_statuses_and_order_of_checks(spark):
    base = base_df(spark)
    batch = changes_df(spark, [
        dict(op="update", commit_hash="c1", field="subject", value="new"),
        dict(op="update", commit_hash="c1", field="commit_hash", value="x"),
        dict(op="update", commit_hash="zz", field="bogus", value="1"),
        dict(op="update", commit_hash="zz", field="num_files_changed", value="x"),
        dict(op="update", commit_hash="c1", field="num_files_changed", value="x"),
        dict(op="update", commit_hash="c1", field="author_name", value="Z"),
        dict(op="update", commit_hash="c1", field="subject", value="newer"),
    ])
    res = CH.apply_updates(base, batch)
    assert status_of(res) == ["updated", "invalid_field", "invalid_field", "not_found",
                              "invalid_value", "updated", "updated"]
    row = res.snapshot.collect()[0]
    assert (row.subject, row.author_name, row.num_files_changed) == ("newer", "Z", 1)
    assert rows(D.author_counts(res.snapshot)) == [("r", "Z", 1)]


def test_delete_and_counters(spark):
    base = base_df(spark)
    batch = changes_df(spark, [dict(op="delete", commit_hash="c1"), dict(op="delete", commit_hash="c1"),
                               dict(op="delete", commit_hash="zz")])
    res = CH.apply_deletes(base, batch)
    assert status_of(res) == ["deleted", "not_found", "not_found"]
    assert res.snapshot.count() == 0
    merged = CH.merge_counter_deltas(D.author_counts(base), res.deltas)
    assert rows(merged) == [("r", "A", 0)]  # stays listed at zero


def test_delta_merge_equals_recompute(spark):
    base = B.commits_table(spark, SF_SMALL)
    batch = B.create_changes(spark, SF_SMALL).unionByName(B.delete_changes(spark, SF_SMALL))
    res = CH.apply_changes(base, batch, "if_absent")
    merged = CH.merge_counter_deltas(D.author_counts(base), res.deltas).where(F.col("commit_count") > 0)
    recomputed = D.author_counts(res.snapshot)
    assert merged.exceptAll(recomputed).count() == 0 and recomputed.exceptAll(merged).count() == 0


def test_repos_loaded_sticky_after_delete(spark):
    base = base_df(spark)
    res = CH.apply_deletes(base, changes_df(spark, [dict(op="delete", commit_hash="c1")]))
    assert D.loaded_repos(res.snapshot).count() == 0
    assert rows(D.loaded_repos(res.snapshot, prior=D.loaded_repos(base))) == [("r",)]
