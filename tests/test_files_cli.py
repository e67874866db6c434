"""End to end from NDJSON files: load job with reject accounting, then the
command-line reports."""

import pytest
from pyspark.sql import functions as F

from commitlens.__main__ import main
from commitlens.operators import derive as D
from commitlens.plans import load as LD
from commitlens.sources import bindings as B
from commitlens.sources import normalise as NM
from conftest import SF_SMALL
from test_ingest import C1, LINES


def _write_sources(spark, folder):
    B.commit_lines(spark, SF_SMALL).write.text(f"{folder}/Sample_Commits.json")
    for name, raw in [("Sample_Repos.json", B.raw_repos_documents(spark, SF_SMALL)),
                      ("Licenses.json", B.raw_licenses_parts(spark, SF_SMALL)),
                      ("Languages.json", B.raw_languages(spark, SF_SMALL))]:
        raw.select(F.to_json(F.struct(*raw.columns)).alias("value")).write.text(f"{folder}/{name}")


def test_load_from_files_matches_batch_tables(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write_sources(spark, src)
    written = {}
    paths = LD.load_from_files(spark, src, out, metrics=written)
    for name, n in written.items():  # observed on the write = read back
        assert spark.read.parquet(paths[name]).count() == n
    commits = spark.read.parquet(paths["commits"])
    want = B.commits_table(spark, SF_SMALL)
    got = commits.select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    ac = spark.read.parquet(paths["author_counts"])
    assert ac.exceptAll(D.author_counts(want)).count() == 0
    lb = spark.read.parquet(paths["language_bytes"])
    assert lb.exceptAll(D.language_bytes(NM.unnest_languages(B.raw_languages(spark, SF_SMALL)))).count() == 0
    rejects = {(r.source, r.outcome): r.line_count for r in spark.read.parquet(paths["rejects"]).collect()}
    assert rejects[("commits", "accepted")] == want.count()
    assert rejects[("commits", "malformed")] == 0


def test_edge_case_file_and_last_line_wins(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "Sample_Commits.json").write_text("\n".join(LINES + [C1.replace("Fix it", "last")]) + "\n")
    paths = LD.load_from_files(spark, str(src), out)
    commits = {r.commit_hash: r for r in spark.read.parquet(paths["commits"]).collect()}
    assert set(commits) == {"c1", "c2", "c3"} and commits["c1"].subject == "last"
    counts = {(r.repo_name, r.author_name): r.commit_count for r in spark.read.parquet(paths["author_counts"]).collect()}
    assert counts[("r", "A")] == 2  # both c1 records count
    rejects = {r.outcome: r.line_count for r in spark.read.parquet(paths["rejects"]).collect()}
    assert rejects == {"accepted": 4, "blank": 2, "malformed": 5, "missing_key": 3}


def test_cli_load_and_reports(spark, tmp_path, capsys):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write_sources(spark, src)
    assert main(["load", "--in", src, "--out", out]) == 0
    for name in ["words", "licenses", "languages", "watch", "tiers", "names"]:
        assert main(["report", name, "--tables", out]) == 0
    assert main(["report", "repos", "--tables", out, "--out", str(tmp_path / "repos")]) == 0
    assert spark.read.parquet(str(tmp_path / "repos")).count() > 0
    for bad in (["repos"], ["activity"], ["words", "--ties", "asc"]):
        with pytest.raises(SystemExit):
            main(["report", *bad, "--tables", out])
    assert main(["report", "activity", "--tables", out, "--repo", "1-URGENT", "--ties", "desc", "--top", "3"]) == 0
    shown = capsys.readouterr().out
    assert "word_count" in shown and "watch_tier" in shown and "commit_count" in shown


def test_cli_change_file_and_record_commands(spark, tmp_path, capsys):
    import json

    src, out, out2 = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "out2")
    _write_sources(spark, src)
    assert main(["load", "--in", src, "--out", out]) == 0
    changes = [
        {"seq": 1, "op": "create", "commit_hash": "new-1", "repo_name": "9-NEW", "author_name": "Ann", "subject": "hi"},
        {"seq": 2, "op": "update", "commit_hash": "new-1", "field": "subject", "value": "hello"},
        {"seq": 3, "op": "delete", "commit_hash": "1"},
        {"seq": 4, "op": "delete", "commit_hash": "1"},
        {"seq": 5, "op": "update", "commit_hash": "new-1", "field": "bogus", "value": "x"},
    ]
    path = tmp_path / "changes.json"
    path.write_text("\n".join(json.dumps(c) for c in changes) + "\nnot json\n")
    assert main(["apply", "--tables", out, "--changes", str(path), "--out", out2]) == 0
    status = {r.seq: r.status for r in spark.read.parquet(f"{out2}/change_status").collect()}
    assert status == {1: "created", 2: "updated", 3: "deleted", 4: "not_found", 5: "invalid_field"}
    snap = spark.read.parquet(f"{out2}/commits")
    assert snap.where("commit_hash = '1'").count() == 0
    assert snap.where("commit_hash = 'new-1'").collect()[0].subject == "hello"
    assert spark.read.parquet(f"{out2}/repos_loaded").where("repo_name = '9-NEW'").count() == 1
    rejects = {r.outcome: r.line_count for r in spark.read.parquet(f"{out2}/change_rejects").collect()}
    assert rejects["malformed"] == 1 and rejects["accepted"] == 5
    assert main(["read", "--tables", out2, "--hash", "new-1"]) == 0
    assert main(["list", "--tables", out2, "--repo", "2-HIGH", "--top", "3"]) == 0
    assert main(["search", "--tables", out2, "--author", "customer#0000000[0-4]"]) == 0
    shown = capsys.readouterr().out
    assert "hello" in shown and "created" in shown


def test_stored_snapshot_files_hold_disjoint_hash_ranges(spark, tmp_path):
    out = str(tmp_path / "out")
    # small input: keep the range partitions apart so several files exist
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        paths = LD.load_all(spark, out, raw_commits=B.raw_commits(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    snap = spark.read.parquet(paths["commits"])
    ranges = sorted(
        (r.lo, r.hi) for r in snap.groupBy(F.input_file_name().alias("f"))
        .agg(F.min("commit_hash").alias("lo"), F.max("commit_hash").alias("hi")).collect()
    )
    assert len(ranges) > 1
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    plan = snap.where(F.col("commit_hash") == "1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(commit_hash,1)" in plan
