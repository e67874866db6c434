from commitlens.operators import derive as D
from commitlens.plans import load as LD
from commitlens.session import work_dir
from commitlens.sources import bindings as B
from commitlens.sources import normalise as NM
from commitlens.streaming import counters as ST
from conftest import SF_SMALL


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_commits_table_equals_normalised_raw(spark):
    assert same(B.commits_table(spark, SF_SMALL), NM.normalise_commits(B.raw_commits(spark, SF_SMALL)))


def test_streamed_counts_equal_batch(spark):
    lines = B.commit_lines(spark, SF_SMALL).repartition(3)
    streamed = ST.stream_author_counts_from(spark, lines, max_files_per_trigger=1)
    assert same(streamed, D.author_counts(B.commits_table(spark, SF_SMALL)))


def test_stream_upsert_equals_batch_latest(spark):
    from pyspark.sql import functions as F
    raw = B.commit_versions(spark, SF_SMALL)
    lines = raw.select(F.to_json(F.struct(*raw.columns)).alias("value")).repartition(3)
    streamed = ST.stream_upsert_from(spark, lines, max_files_per_trigger=1)
    batch = D.commits_latest_by_hash(NM.normalise_commits(raw, keep=["seq"]), "seq")
    assert same(streamed.drop("files_changed"), batch.drop("files_changed"))


def test_refresh_twice_equals_once_and_accumulate_doubles(spark):
    raw = B.raw_licenses_parts(spark, SF_SMALL)
    once = D.license_counts(NM.normalise_licenses(raw))
    assert same(LD.reload_license_counts(spark, raw, "refresh"), once)
    doubled = LD.reload_license_counts(spark, raw, "accumulate")
    assert {r.license_name: r.repo_count for r in doubled.collect()} == \
        {r.license_name: 2 * r.repo_count for r in once.collect()}


def test_load_all_writes_every_table(spark):
    out = work_dir(spark, "test-load")
    paths = LD.load_all(
        spark, out,
        raw_commits=B.raw_commits(spark, SF_SMALL),
        raw_repos=B.raw_repos_documents(spark, SF_SMALL),
        raw_licenses=B.raw_licenses_parts(spark, SF_SMALL),
        raw_languages=B.raw_languages(spark, SF_SMALL),
    )
    assert set(paths) == {"commits", "commits_by_repo", "author_counts", "repos_loaded", "repos",
                          "repos_by_tier", "tier_counts", "licenses", "license_counts", "languages", "language_bytes"}
    assert spark.read.parquet(paths["commits"]).count() == B.commits_table(spark, SF_SMALL).count()
    tiers = spark.read.parquet(paths["repos_by_tier"])
    assert "watch_tier" in tiers.columns and tiers.count() > 0
