"""Registered queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Each query reads the driver tables through the bindings, runs one or more
library operators over the whole tables and returns a DataFrame whose column
names match the DuckDB oracle in :mod:`commitlens.plans.oracle`. Arrays are
rendered as comma-joined text for comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
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
from commitlens.plans import reports as RP
from commitlens.plans import store as SO
from commitlens.session import remove
from commitlens.sources import bindings as B
from commitlens.sources import ndjson as J
from commitlens.sources import normalise as NM
from commitlens.streaming import counters as ST
from commitlens.streaming import tables as STT

Query = Callable[[SparkSession, str], DataFrame]

FOCUS_REPO = "1-URGENT"
LIST_REPO = "2-HIGH"
FOCUS_TIER = "10 to 99"
AUTHOR_PATTERN = "customer#0000000[0-4]"


def render_commits(df: DataFrame) -> DataFrame:
    """Canonical commit columns with the file list as comma-joined text."""
    return df.select(
        *[c for c in S.COMMIT_COLUMNS if c != "files_changed"],
        F.array_join("files_changed", ",").alias("files_changed"),
    )


# --- words -------------------------------------------------------------
def q_top_words(spark, sf):
    return RP.word_report(B.subjects(spark, sf))


def q_top_words_commits(spark, sf):
    return RP.word_report(B.commits_table(spark, sf))


def q_top_words_conversations(spark, sf):
    return RP.word_report(B.conversation_subjects(spark, sf))


# --- contributors ------------------------------------------------------
def _author_counts(spark, sf):
    return D.author_counts(B.commits_table(spark, sf))


def _contributors(counts, repo, ties, positive_only):
    return RP.commit_activity(counts, repo, S.TOP_CONTRIBUTORS, ties=ties, positive_only=positive_only)


def q_top_contributors_redis(spark, sf):
    return _contributors(_author_counts(spark, sf), FOCUS_REPO, "desc", False)


def q_top_contributors_cassandra(spark, sf):
    return _contributors(_author_counts(spark, sf), FOCUS_REPO, "asc", True)


def q_top_contributors_per_repo(spark, sf):
    return RP.commit_activity_all(_author_counts(spark, sf))


def q_author_counts(spark, sf):
    return _author_counts(spark, sf)


def q_repos_loaded(spark, sf):
    return D.loaded_repos(B.commits_table(spark, sf))


def q_commits_by_repo(spark, sf):
    return D.commits_by_repo(B.commits_table(spark, sf))


def q_commits_normalised(spark, sf):
    return render_commits(NM.normalise_commits(B.raw_commits(spark, sf)))


def q_commits_from_ndjson(spark, sf):
    classified = J.classify_ndjson(B.commit_lines(spark, sf), S.RAW_COMMIT, ["commit", "repo_name"])
    return render_commits(NM.normalise_commits(J.accepted(classified)))


def q_commit_hash_records(spark, sf):
    from commitlens.functions import json_text

    c = B.commits_table(spark, sf)
    return c.select("commit_hash", "repo_name", "author_name",
                    json_text("files_changed").alias("files_changed"), "num_files_changed")


def q_commits_keep_nulls(spark, sf):
    lines = B.commit_lines(spark, sf, explicit_nulls=True)
    classified = J.classify_ndjson(lines, S.RAW_COMMIT, ["commit", "repo_name"])
    return render_commits(NM.normalise_commits(J.accepted(classified, keep_line=True), nulls="keep"))


def q_author_counts_versions(spark, sf):
    return D.author_counts(NM.normalise_commits(B.commit_versions(spark, sf), keep=["seq"]))


def q_author_counts_snapshot(spark, sf):
    versions = NM.normalise_commits(B.commit_versions(spark, sf), keep=["seq"])
    return D.author_counts(versions, count_mode="distinct", order="seq")


def q_read_record(spark, sf):
    return render_commits(L.read_record(B.commits_table(spark, sf), "1"))


def _purged(spark, sf):
    base = B.commits_table(spark, sf)
    return base, CH.apply_deletes(base, B.purge_changes(spark, sf))


def q_repos_loaded_after_purge(spark, sf):
    _, res = _purged(spark, sf)
    return D.loaded_repos(res.snapshot)


def q_repos_loaded_sticky(spark, sf):
    base, res = _purged(spark, sf)
    return D.loaded_repos(res.snapshot, prior=D.loaded_repos(base))


def q_load_all_tables(spark, sf):
    return LD.load_and_count(
        spark,
        raw_commits=B.raw_commits(spark, sf),
        raw_repos=B.raw_repos_documents(spark, sf),
        raw_licenses=B.raw_licenses_parts(spark, sf),
        raw_languages=B.raw_languages(spark, sf),
    )


def q_commits_latest_by_hash(spark, sf):
    versions = NM.normalise_commits(B.commit_versions(spark, sf), keep=["seq"])
    return render_commits(D.commits_latest_by_hash(versions, "seq"))


def q_load_summary(spark, sf):
    return LD.load_summary(B.commits_table(spark, sf))


# --- ingest ------------------------------------------------------------
def _repo_classified(spark, sf):
    return J.classify_ndjson(B.repo_lines(spark, sf), S.RAW_REPO, ["repo_name"])


def q_ndjson_ingest_repos(spark, sf):
    return NM.normalise_repos(J.accepted(_repo_classified(spark, sf)))


def q_ingest_reject_counts(spark, sf):
    return J.reject_counts(_repo_classified(spark, sf))


def q_file_load_rejects(spark, sf):
    from commitlens.session import work_dir

    base = work_dir(spark, "file-load")
    B.repo_lines(spark, sf).write.mode("overwrite").text(f"{base}/in/{LD.SOURCE_FILES['repos']}")
    paths = LD.load_from_files(spark, f"{base}/in", f"{base}/out")
    return spark.read.parquet(paths["rejects"])


# --- licenses ----------------------------------------------------------
def q_licenses_rows(spark, sf):
    return NM.normalise_licenses(B.raw_licenses_parts(spark, sf), require_repo=True)


def q_licenses_accept_counts(spark, sf):
    return D.license_counts(NM.normalise_licenses(B.raw_licenses_parts(spark, sf)))


def _license_report(raw, ties, positive_only):
    return RP.license_report(D.license_counts(NM.normalise_licenses(raw)), ties=ties, positive_only=positive_only)


def q_top_licenses_redis(spark, sf):
    return _license_report(B.raw_licenses_parts(spark, sf), "desc", False)


def q_top_licenses_cassandra(spark, sf):
    return _license_report(B.raw_licenses_parts(spark, sf), "asc", True)


def q_top_licenses_tied(spark, sf):
    return _license_report(B.raw_licenses_documents(spark, sf), "asc", True)


def q_refresh_then_reload(spark, sf):
    return LD.reload_license_counts(spark, B.raw_licenses_parts(spark, sf), mode="refresh")


def q_accumulate_reload(spark, sf):
    return LD.reload_license_counts(spark, B.raw_licenses_parts(spark, sf), mode="accumulate")


# --- languages ---------------------------------------------------------
def q_languages_unnested(spark, sf):
    return NM.unnest_languages(B.raw_languages(spark, sf))


def q_language_bytes(spark, sf):
    return D.language_bytes(NM.unnest_languages(B.raw_languages(spark, sf)))


def q_top_languages(spark, sf):
    return RP.language_report(D.language_bytes(NM.unnest_languages(B.raw_languages(spark, sf))))


# --- watch counts ------------------------------------------------------
def _repos(raw_fn):
    def build(spark, sf):
        return NM.normalise_repos(raw_fn(spark, sf))

    return build


_parts = _repos(B.raw_repos_parts)
_docs = _repos(B.raw_repos_documents)
_accounts = _repos(B.raw_repos_accounts)
_spend = _repos(B.raw_repos_spend)
_urls = _repos(B.repo_urls)


def q_repos_by_tier(spark, sf):
    return D.repos_by_tier(_parts(spark, sf))


def q_tier_counts(spark, sf):
    return D.tier_counts(_docs(spark, sf))


def q_watch_tiers_dense(spark, sf):
    return H.tier_histogram(_docs(spark, sf))


def q_watch_buckets_neg(spark, sf):
    return H.bucket_histogram(_accounts(spark, sf))


def q_watch_buckets_million(spark, sf):
    return H.bucket_histogram(_spend(spark, sf))


def q_most_watched(spark, sf):
    return H.most_watched(_parts(spark, sf))


def q_most_watched_in_tier(spark, sf):
    return H.most_watched_in_tier(_parts(spark, sf), FOCUS_TIER)


def q_most_watched_overall(spark, sf):
    return H.most_watched_overall(_docs(spark, sf))


def q_most_watched_per_tier(spark, sf):
    return H.most_watched_per_tier(_docs(spark, sf))


# --- names -------------------------------------------------------------
def q_repo_name_lengths(spark, sf):
    return _urls(spark, sf).select("repo_name", "name_length")


def q_name_stats(spark, sf):
    return N.name_stats(_urls(spark, sf))


def q_name_stats_empty(spark, sf):
    # repositories served over ftp: there are none, so no statistics row
    return N.name_stats(_urls(spark, sf).where(F.col("repo_name").startswith("ftp://")))


def q_longest_names(spark, sf):
    return N.longest_names(_urls(spark, sf))


def q_shortest_names(spark, sf):
    return N.shortest_names(_urls(spark, sf))


# --- record access -----------------------------------------------------
def q_list_commits_by_repo(spark, sf):
    return L.list_by_repo(B.commits_table(spark, sf), LIST_REPO)


def q_search_author(spark, sf):
    return render_commits(L.search_author(B.commits_table(spark, sf), AUTHOR_PATTERN))


def q_lookup_batch(spark, sf):
    found = L.lookup(B.commits_table(spark, sf), B.lookup_keys(spark, sf))
    return found.select("commit_hash", "found", "repo_name", "author_name", "subject", "num_files_changed")


# --- change batches ----------------------------------------------------
def _creates(spark, sf, mode):
    return CH.apply_creates(B.commits_table(spark, sf), B.create_changes(spark, sf), mode)


def q_create_if_absent(spark, sf):
    return _creates(spark, sf, "if_absent").status


def q_create_if_absent_snapshot(spark, sf):
    return render_commits(_creates(spark, sf, "if_absent").snapshot)


def q_create_upsert(spark, sf):
    return _creates(spark, sf, "upsert").status


def q_create_upsert_snapshot(spark, sf):
    return render_commits(_creates(spark, sf, "upsert").snapshot)


def q_update_fields(spark, sf):
    return CH.apply_updates(B.commits_table(spark, sf), B.update_changes(spark, sf)).status


def q_update_fields_snapshot(spark, sf):
    return render_commits(CH.apply_updates(B.commits_table(spark, sf), B.update_changes(spark, sf)).snapshot)


def q_delete_batch(spark, sf):
    return CH.apply_deletes(B.commits_table(spark, sf), B.delete_changes(spark, sf)).status


def q_delete_batch_snapshot(spark, sf):
    return render_commits(CH.apply_deletes(B.commits_table(spark, sf), B.delete_changes(spark, sf)).snapshot)


def _mixed(spark, sf):
    return CH.apply_changes(B.commits_table(spark, sf), B.mixed_changes(spark, sf), "if_absent")


def q_mixed_changes(spark, sf):
    return _mixed(spark, sf).status


def q_change_file_status(spark, sf):
    from commitlens.session import work_dir

    base = work_dir(spark, "change-file")
    B.commits_table(spark, sf).write.mode("overwrite").parquet(f"{base}/tables/commits")
    batch = B.mixed_changes(spark, sf)
    batch.select(F.to_json(F.struct(*batch.columns)).alias("value")).write.mode("overwrite").text(
        f"{base}/changes"
    )
    paths = LD.apply_change_file(spark, f"{base}/tables", f"{base}/changes", f"{base}/out")
    return spark.read.parquet(paths["change_status"])


def q_mixed_changes_snapshot(spark, sf):
    return render_commits(_mixed(spark, sf).snapshot)


def q_mixed_changes_counts(spark, sf):
    base = B.commits_table(spark, sf)
    res = CH.apply_changes(base, B.mixed_changes(spark, sf), "if_absent")
    return CH.merge_counter_deltas(D.author_counts(base), res.deltas).where(F.col("commit_count") > F.lit(0))


def _after_changes(spark, sf):
    base = B.commits_table(spark, sf)
    batch = B.create_changes(spark, sf).unionByName(B.delete_changes(spark, sf))
    return base, CH.apply_changes(base, batch, "if_absent")


def q_author_counts_after_changes(spark, sf):
    base, res = _after_changes(spark, sf)
    return CH.merge_counter_deltas(D.author_counts(base), res.deltas)


def q_top_contributors_after_changes(spark, sf):
    base, res = _after_changes(spark, sf)
    counts = CH.merge_counter_deltas(D.author_counts(base), res.deltas)
    return _contributors(counts, "4-NOT SPECIFIED", "asc", True)


# --- streaming ---------------------------------------------------------
def q_stream_author_counts(spark, sf):
    return ST.stream_author_counts_from(spark, B.commit_lines(spark, sf))


def q_stream_language_bytes(spark, sf):
    raw = B.raw_languages(spark, sf)
    lines = raw.select(F.to_json(F.struct(*raw.columns)).alias("value"))
    return ST.stream_language_bytes_from(spark, lines)


def q_stream_upsert(spark, sf):
    raw = B.commit_versions(spark, sf)
    lines = raw.select(F.to_json(F.struct(*raw.columns)).alias("value"))
    return render_commits(ST.stream_upsert_from(spark, lines))


def q_stream_counts_rerun(spark, sf):
    """The stream run again with no new file: the whole table."""
    src, out, cp = ST.stage_lines(spark, B.commit_lines(spark, sf), "stream-rerun")
    for _ in range(2):
        counts = ST.stream_author_counts(spark, src, out, cp, 4)
    return counts


def q_stream_upsert_files(spark, sf):
    """Records without seq, in files: the last line wins."""
    raw = B.commit_versions(spark, sf, in_order=True)
    ordered = raw.select(F.to_json(F.struct(*[c for c in raw.columns if c != "seq"])).alias("value"))
    return render_commits(ST.stream_upsert_from(spark, ordered, max_files_per_trigger=1_000_000, maxRecordsPerFile=ST.FILE_LINES))


# --- loads, by content ---------------------------------------------------
def _loaded(spark, name, **raw):
    return spark.read.parquet(LD.load_all(spark, LD.work_dir(spark, "loaded"), **raw)[name])


def q_loaded_commits(spark, sf):
    return render_commits(_loaded(spark, "commits", raw_commits=B.raw_commits(spark, sf)))


def q_loaded_commits_by_repo(spark, sf):
    return _loaded(spark, "commits_by_repo", raw_commits=B.raw_commits(spark, sf))


def q_loaded_repos_by_tier(spark, sf):
    return _loaded(spark, "repos_by_tier", raw_repos=B.raw_repos_parts(spark, sf)).select("watch_tier", "watch_count", "repo_name")


def q_loaded_languages(spark, sf):
    return _loaded(spark, "languages", raw_languages=B.raw_languages(spark, sf))


def q_load_duplicates(spark, sf):
    """Every record twice, without seq: one row per hash."""
    raw = B.raw_commits(spark, sf)
    return render_commits(_loaded(spark, "commits", raw_commits=raw.unionByName(raw)))


def q_accumulate_subset_tables(spark, sf):
    """Licenses and repos, then licenses alone on top: all tables' contents."""
    base = LD.work_dir(spark, "subset")
    licenses = B.raw_licenses_parts(spark, sf)
    LD.load_all(spark, f"{base}/1", raw_licenses=licenses, raw_repos=B.raw_repos_parts(spark, sf))
    paths = LD.load_all(spark, f"{base}/2", raw_licenses=licenses, mode="accumulate", prior_dir=f"{base}/1")
    keys = {"license_counts": ("license_name", "repo_count"), "tier_counts": ("watch_tier", "repo_count"), "repos_by_tier": ("repo_name", "watch_count"),
            "repos": ("repo_name", "watch_count")}
    out = None
    for name, (key, value) in keys.items():
        rows = spark.read.parquet(paths[name]).select(F.lit(name).alias("table_name"), F.col(key).alias("key"), F.col(value).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def q_change_file_missing_seq(spark, sf):
    """A change file with changes that lack seq or share it: those are
    invalid, the others apply as without them."""
    base = LD.work_dir(spark, "change-seq")
    B.commits_table(spark, sf).write.parquet(f"{base}/tables/commits")
    batch = B.mixed_changes(spark, sf).unionByName(B.changes_without_place(spark, sf))
    batch.select(F.to_json(F.struct(*batch.columns)).alias("value")).write.text(f"{base}/changes")
    paths = LD.apply_change_file(spark, f"{base}/tables", f"{base}/changes", f"{base}/out")
    return spark.read.parquet(paths["change_status"])


def q_hot_hash_changes(spark, sf):
    return CH.apply_sequential(B.commits_table(spark, sf), B.hot_key_changes(spark, sf), chunk=4096).status


# --- strict and lenient parsing ------------------------------------------
def q_commits_lenient_containers(spark, sf):
    lines = J.classify_ndjson(B.lenient_commit_lines(spark, sf), S.RAW_COMMIT, ["commit", "repo_name"])
    return render_commits(NM.normalise_commits(J.accepted(lines)))


def q_ndjson_trailing_text(spark, sf):
    return J.reject_counts(J.classify_ndjson(B.trailing_lines(spark, sf), S.RAW_REPO, ["repo_name"]))


def q_repos_int_forms(spark, sf):
    return NM.normalise_repos(J.accepted(J.classify_ndjson(B.int_form_lines(spark, sf), S.RAW_REPO, ["repo_name"])))


def q_load_null_seq(spark, sf):
    """Versions whose seq is NULL for all but every seventh record: one whole record per hash."""
    raw = B.commit_versions(spark, sf).withColumn("seq", F.when(F.col("seq") % 7 == 0, F.col("seq")))
    return render_commits(_loaded(spark, "commits", raw_commits=raw))


def q_accumulate_same_records(spark, sf):
    """The same repositories and licenses loaded twice: each record once."""
    base = LD.work_dir(spark, "same-records")
    raw = {"raw_repos": B.raw_repos_documents(spark, sf), "raw_licenses": B.raw_licenses_documents(spark, sf)}
    LD.load_all(spark, f"{base}/1", **raw)
    paths = LD.load_all(spark, f"{base}/2", **raw, mode="accumulate", prior_dir=f"{base}/1")
    repos = spark.read.parquet(paths["repos"]).select(F.lit("repos").alias("table_name"), "repo_name", F.col("watch_count").cast("string").alias("value"))
    return repos.unionByName(spark.read.parquet(paths["licenses"]).select(F.lit("licenses").alias("table_name"), "repo_name", F.col("license").alias("value")))


# --- the ranged store ----------------------------------------------------
def _changed_store(spark, sf):
    store = SO.CommitStore.create(spark, LD.work_dir(spark, "store"), B.commits_table(spark, sf), ranges=16)
    store.apply(B.mixed_changes(spark, sf))
    return store


def q_change_touched_ranges(spark, sf):
    return render_commits(_changed_store(spark, sf).read("commits"))


def q_change_incremental_tables(spark, sf):
    """The tables kept by deltas after a batch, one under the other."""
    store = _changed_store(spark, sf)
    none = F.lit(None).cast("string")
    return store.read("author_counts").select(F.lit("author_counts").alias("table_name"), "repo_name", F.col("author_name").alias("key"), F.col("commit_count").cast("string").alias("value")) \
        .unionByName(store.read("commits_by_repo").select(F.lit("commits_by_repo").alias("table_name"), "repo_name", F.col("commit_hash").alias("key"), F.col("subject").alias("value"))) \
        .unionByName(store.repos_loaded().select(F.lit("repos_loaded").alias("table_name"), "repo_name", none.alias("key"), none.alias("value")))


def q_top_contributors_maintained(spark, sf):
    return _changed_store(spark, sf).top_contributors()


def q_lookup_in_ranges(spark, sf):
    """Asked-for keys, most of them absent, from the ranges they fall into."""
    store = SO.CommitStore.create(spark, LD.work_dir(spark, "store"), B.commits_table(spark, sf), ranges=16)
    return render_commits(store.lookup(B.lookup_keys(spark, sf)))


def q_change_bucketed_snapshot(spark, sf):
    """A large batch against a bucketed snapshot."""
    base = BK.write_bucketed(B.commits_table(spark, sf), LD.work_dir(spark, "bucketed"), 16)
    ops = CH.sequence_changes(base, B.mixed_changes(spark, sf))
    return render_commits(CH.finalize_sequence(base, ops)[0])


# --- kept indexes and counts ---------------------------------------------
def q_search_author_indexed(spark, sf):
    base = LD.work_dir(spark, "author-index")
    B.commits_table(spark, sf).write.parquet(f"{base}/commits")
    commits = spark.read.parquet(f"{base}/commits")
    AI.write_index(commits, f"{base}/index")
    return render_commits(AI.search_author(commits, f"{base}/index", AUTHOR_PATTERN))


def q_most_watched_walk(spark, sf):
    paths = LD.load_all(spark, LD.work_dir(spark, "tiers"), raw_repos=B.raw_repos_documents(spark, sf))
    return H.walk_tiers(spark.read.parquet(paths["repos_by_tier"]), spark.read.parquet(paths["tier_counts"]))[0]


def _length_counts_after(spark, sf):
    """Name lengths after deletes and creates of repositories, by deltas."""
    moves = NM.normalise_repos(B.repo_url_changes(spark, sf), keep=["sign"])
    deltas = moves.groupBy("name_length").agg(F.sum("sign").cast("bigint").alias("repo_count"))
    return CH.merge_counter_deltas(N.length_counts(_urls(spark, sf)), deltas, ["name_length"], "repo_count")


def q_name_stats_after_changes(spark, sf):
    return N.stats_of_lengths(_length_counts_after(spark, sf))


def q_longest_names_by_counts(spark, sf):
    return N.longest_by_counts(_urls(spark, sf), N.length_counts(_urls(spark, sf)))


def q_stream_all_tables(spark, sf):
    """All commit tables of one stream, one under the other."""
    raw = B.commit_versions(spark, sf)
    lines = raw.select(F.to_json(F.struct(*raw.columns)).alias("value"))
    src, out, cp = ST.stage_lines(spark, lines, "stream-tables", **ST.COMPRESSED)
    stream = STT.CommitStream(spark, out)
    stream.run(src, cp, 4)
    remove(spark, src)
    none, commit = F.lit(None).cast("string"), ["repo_name", "commit_hash", "author_name"]
    return stream.read("author_counts").select(F.lit("author_counts").alias("table_name"), "repo_name", F.col("author_name").alias("key"), F.col("commit_count").cast("string").alias("value")) \
        .unionByName(stream.read("commits", commit).select(F.lit("commits").alias("table_name"), "repo_name", F.col("commit_hash").alias("key"), F.col("author_name").alias("value"))) \
        .unionByName(stream.read("commits_by_repo", commit).select(F.lit("commits_by_repo").alias("table_name"), "repo_name", F.col("commit_hash").alias("key"), F.col("author_name").alias("value"))) \
        .unionByName(stream.read("repos_loaded").select(F.lit("repos_loaded").alias("table_name"), "repo_name", none.alias("key"), none.alias("value")))


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
