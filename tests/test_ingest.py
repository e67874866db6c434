
from commitlens import schemas as S
from commitlens.operators import derive as D
from commitlens.sources import ndjson as J
from commitlens.sources import normalise as NM
from conftest import rows

C1 = ('{"commit":"c1","repo_name":"r","author":{"name":"A","email":"a@x"},"committer":{"name":"B"},'
      '"difference":[{"new_path":"p"},{"new_path":""},{"old_path":"q"}],"subject":"Fix it"}')
LINES = [
    C1,
    '{"commit":"c2","repo_name":"r"}',
    '{"commit":"c3","repo_name":"r","author":{"name":null},"difference":null}',
    '{"commit":"","repo_name":"r"}',
    '{"repo_name":"r"}',
    '{"commit":"c4"}',
    "",
    "    ",
    "not json",
    '{"commit":',
    "5",
    '[{"commit":"c5","repo_name":"r"}]',
    '{"commit":"c6","repo_name":"r","author":"oops"}',
]


def lines_df(spark, lines):
    return spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "seq bigint, value string")


def test_commit_normalise_and_rejects(spark):
    classified = J.classify_ndjson(lines_df(spark, LINES), S.RAW_COMMIT, ["commit", "repo_name"])
    commits = NM.normalise_commits(J.accepted(classified))
    got = {r.commit_hash: r for r in commits.collect()}
    assert set(got) == {"c1", "c2", "c3"}
    c1 = got["c1"]
    assert c1.files_changed == ["p"] and c1.num_files_changed == 3
    assert (c1.author_name, c1.author_email, c1.committer_name) == ("A", "a@x", "B")
    assert (c1.message, c1.tree, c1.subject) == ("", "", "Fix it")
    c2 = got["c2"]
    assert (c2.author_name, c2.committer_name, c2.author_email) == ("unknown", "unknown", "")
    assert c2.files_changed == [] and c2.num_files_changed == 0
    assert got["c3"].author_name == "unknown" and got["c3"].num_files_changed == 0
    reasons = dict(rows(J.reject_counts(classified)))
    assert reasons == {"accepted": 3, "blank": 2, "malformed": 5, "missing_key": 3}
    rej = rows(J.rejected(classified), "line", "reason")
    assert ("5", "malformed") in rej and ('{"commit":"c6","repo_name":"r","author":"oops"}', "malformed") in rej


def test_duplicate_hash_last_write_wins_and_counts_every_record(spark):
    c1b = C1.replace("Fix it", "Fix it again")
    classified = J.classify_ndjson(lines_df(spark, [C1, c1b]), S.RAW_COMMIT, ["commit", "repo_name"])
    recs = NM.normalise_commits(J.accepted(classified), keep=["seq"])
    latest = D.commits_latest_by_hash(recs, "seq").collect()
    assert len(latest) == 1 and latest[0].subject == "Fix it again"
    assert rows(D.author_counts(recs)) == [("r", "A", 2)]


def test_same_hash_two_repos(spark):
    a = '{"commit":"h","repo_name":"r","subject":"x"}'
    b = '{"commit":"h","repo_name":"s","subject":"y"}'
    recs = NM.normalise_commits(J.accepted(J.classify_ndjson(lines_df(spark, [a, b]), S.RAW_COMMIT,
                                                             ["commit", "repo_name"])), keep=["seq"])
    assert D.commits_latest_by_hash(recs, "seq").count() == 1
    assert rows(D.commits_by_repo(recs, "seq"), "repo_name", "commit_hash") == [("r", "h"), ("s", "h")]


def test_read_lines_keeps_file_order(spark, tmp_path):
    p = tmp_path / "commits.json"
    p.write_text("\n".join([C1, C1.replace("Fix it", "later")]) + "\n")
    classified = J.read_ndjson(spark, str(p), S.RAW_COMMIT, ["commit", "repo_name"])
    recs = NM.normalise_commits(J.accepted(classified), keep=["line_order"])
    out = D.commits_latest_by_hash(recs, "line_order").collect()
    assert out[0].subject == "later"


def test_repos_lenient_int(spark):
    vals = ["0", "1", "9", "-1", "1000000", None, "", "abc", "3.5", " 12 ", "+5"]
    lines = [('{"repo_name":"r%d"%s}' % (i, "" if v is None else ',"watch_count":"%s"' % v)) for i, v in enumerate(vals)]
    lines.append('{"repo_name":"n","watch_count":null}')
    lines.append('{"watch_count":"4"}')
    repos = NM.normalise_repos(J.accepted(J.classify_ndjson(lines_df(spark, lines), S.RAW_REPO, ["repo_name"])))
    got = dict(rows(repos, "repo_name", "watch_count"))
    assert [got[f"r{i}"] for i in range(len(vals))] == [0, 1, 9, -1, 1000000, 0, 0, 0, 0, 12, 5]
    assert got["n"] == 0 and len(got) == len(vals) + 1


def test_licenses_two_rules(spark):
    raw = spark.createDataFrame(
        [(None, "mit"), ("r", None), ("r", ""), ("a", "gpl")], "repo_name string, license string")
    assert {tuple(r) for r in NM.normalise_licenses(raw).collect()} == {(None, "mit"), ("a", "gpl")}
    assert rows(NM.normalise_licenses(raw, require_repo=True)) == [("a", "gpl")]
    assert rows(D.license_counts(NM.normalise_licenses(raw))) == [("gpl", 1), ("mit", 1)]


def test_languages_unnest(spark):
    lines = ['{"language":[{"name":"C","bytes":"10"},{"name":"D","bytes":"x"},{"name":"","bytes":"9"}]}',
             '{"language":null}', "{}", '{"language":[{"name":"C","bytes":5}]}']
    raw = J.accepted(J.classify_ndjson(lines_df(spark, lines), S.RAW_LANGUAGE))
    langs = NM.unnest_languages(raw)
    assert rows(langs, "name", "bytes") == [("C", 5), ("C", 10), ("D", 0)]
    assert rows(D.language_bytes(langs)) == [("C", 15), ("D", 0)]


def test_explicit_null_kept_only_on_request(spark):
    lines = ['{"commit":"c3","repo_name":"r","author":{"name":null},"difference":null,"subject":null}',
             '{"commit":"c2","repo_name":"r","author":null}',
             '{"commit":"c1","repo_name":"r","author":{"email":"e"},"committer":{"name":null}}']
    acc = J.accepted(J.classify_ndjson(lines_df(spark, lines), S.RAW_COMMIT, ["commit", "repo_name"]),
                     keep_line=True)
    keep = {r.commit_hash: r for r in NM.normalise_commits(acc, nulls="keep").collect()}
    assert keep["c3"].author_name is None and keep["c3"].subject is None and keep["c3"].message == ""
    assert keep["c2"].author_name == "unknown"
    assert keep["c1"].author_name == "unknown" and keep["c1"].committer_name is None
    default = {r.commit_hash: r for r in NM.normalise_commits(acc).collect()}
    assert default["c3"].author_name == "unknown" and default["c1"].committer_name == "unknown"


def test_count_modes(spark):
    lines = [C1, C1.replace("Fix it", "again"), C1.replace('"c1"', '"c9"')]
    recs = NM.normalise_commits(J.accepted(J.classify_ndjson(lines_df(spark, lines), S.RAW_COMMIT,
                                                             ["commit", "repo_name"])), keep=["seq"])
    assert rows(D.author_counts(recs)) == [("r", "A", 3)]
    assert rows(D.author_counts(recs, count_mode="distinct", order="seq")) == [("r", "A", 2)]
