"""DuckDB SQL oracle: for each registered query, an independent SQL
formulation over the driver's tables (views ``orders``, ``lineitem``,
``customer``, ``part``, ``documents``, ``conversations``, ``pages``).

Every computed column is aliased to the name the Spark query produces;
integer results are cast to BIGINT (DuckDB counts/sums are wider) and
doubles are truncated with ``trunc`` where Spark casts (DuckDB rounds).
"""

from __future__ import annotations

from commitlens import schemas as S


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP_LIST = ", ".join(_quote(w) for w in S.STOP_WORDS)

# ---------------------------------------------------------------------------
# Shared CTE bodies.
# ---------------------------------------------------------------------------
COMMITS = """
lp AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_returnflag = 'N' THEN '' ELSE 'f/' || CAST(l_partkey AS VARCHAR) END AS new_path
  FROM lineitem
),
li AS (
  SELECT l_orderkey, count(*) AS n_lines,
         string_agg(NULLIF(new_path, ''), ',' ORDER BY l_linenumber, new_path) AS files
  FROM lp GROUP BY l_orderkey
),
commits AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS commit_hash,
         o.o_orderpriority AS repo_name,
         CASE WHEN o.o_orderstatus = 'P' THEN 'unknown' ELSE coalesce(c.c_name, 'unknown') END AS author_name,
         CASE WHEN o.o_orderstatus = 'P' THEN ''
              ELSE coalesce(lower(c.c_mktsegment) || '@example.com', '') END AS author_email,
         CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'unknown' ELSE coalesce(c.c_name, 'unknown') END AS committer_name,
         'Update order ' || CAST(o.o_orderkey AS VARCHAR) || ' (' || o.o_orderstatus || ')' AS subject,
         CASE WHEN o.o_orderstatus = 'F' THEN '' ELSE 'customer ' || CAST(o.o_custkey AS VARCHAR) END AS message,
         'tree-' || CAST(o.o_orderkey AS VARCHAR) AS tree,
         coalesce(li.files, '') AS files_changed,
         CAST(coalesce(li.n_lines, 0) AS BIGINT) AS num_files_changed
  FROM orders o
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
),
author_counts AS (
  SELECT repo_name, author_name, CAST(count(*) AS BIGINT) AS commit_count
  FROM commits GROUP BY repo_name, author_name
)"""

COMMIT_COLS = (
    "commit_hash, repo_name, author_name, author_email, committer_name, subject, message, tree, "
    "files_changed, num_files_changed"
)


def _tier(col: str) -> str:
    return f"""CASE WHEN {col} = 0 THEN '0 watchers'
            WHEN {col} BETWEEN 1 AND 9 THEN '1 to 9'
            WHEN {col} BETWEEN 10 AND 99 THEN '10 to 99'
            WHEN {col} BETWEEN 100 AND 999 THEN '100 to 999'
            WHEN {col} BETWEEN 1000 AND 9999 THEN '1,000 to 9,999'
            WHEN {col} >= 10000 THEN '10,000+'
            ELSE '0 watchers' END"""


def _bucket(col: str) -> str:
    return f"""CASE WHEN {col} >= 0 AND {col} < 1 THEN 0
            WHEN {col} >= 1 AND {col} < 10 THEN 1
            WHEN {col} >= 10 AND {col} < 100 THEN 10
            WHEN {col} >= 100 AND {col} < 1000 THEN 100
            WHEN {col} >= 1000 AND {col} < 10000 THEN 1000
            WHEN {col} >= 10000 AND {col} < 1000000 THEN 10000 END"""


def _bucket_label(col: str) -> str:
    return f"""CASE {col} WHEN 0 THEN '0 watchers' WHEN 1 THEN '1 to 9' WHEN 10 THEN '10 to 99'
            WHEN 100 THEN '100 to 999' WHEN 1000 THEN '1,000 to 9,999' WHEN 10000 THEN '10,000+'
            ELSE 'other' END"""


def _bar(value: str, width: int, partition: str = "") -> str:
    over = f"OVER (PARTITION BY {partition})" if partition else "OVER ()"
    return (
        f"CASE WHEN max({value}) {over} = 0 THEN 0 "
        f"ELSE CAST(trunc({value}::DOUBLE / max({value}) {over} * {width}) AS BIGINT) END"
    )


REPOS_PARTS = "SELECT p_name AS repo_name, CAST(p_size AS BIGINT) AS watch_count FROM part"
REPOS_DOCS = (
    "SELECT source || '/' || CAST(doc_id AS VARCHAR) AS repo_name, CAST(n_chars AS BIGINT) AS watch_count "
    "FROM documents"
)
REPOS_ACCOUNTS = "SELECT c_name AS repo_name, CAST(trunc(c_acctbal) AS BIGINT) AS watch_count FROM customer"
REPOS_SPEND = """SELECT c.c_name AS repo_name, CAST(coalesce(s.spend, 0) AS BIGINT) AS watch_count
  FROM customer c LEFT JOIN (SELECT o_custkey, sum(CAST(floor(o_totalprice) AS BIGINT)) AS spend
                             FROM orders GROUP BY o_custkey) s ON s.o_custkey = c.c_custkey"""
URLS = "SELECT url AS repo_name, CAST(length(url) AS BIGINT) AS name_length FROM pages WHERE url IS NOT NULL AND url <> ''"

LICENSES_PARTS = """SELECT CASE WHEN p_size = 50 THEN NULL ELSE p_name END AS repo_name,
         CASE WHEN p_size <= 2 THEN NULL WHEN p_size <= 4 THEN '' ELSE p_brand END AS license
  FROM part"""

LANGUAGES = """SELECT repo_name, name, bytes FROM (
    SELECT source AS repo_name, lang AS name, CAST(n_chars AS BIGINT) AS bytes, lang, n_chars FROM documents
    UNION ALL
    SELECT source AS repo_name,
           CASE WHEN lang = 'en' THEN '' ELSE upper(lang) END AS name,
           CASE WHEN lang = 'de' THEN 0 ELSE CAST(doc_id AS BIGINT) END AS bytes, lang, n_chars FROM documents
  ) WHERE NOT (lang = 'es' AND n_chars < 1000) AND name IS NOT NULL AND name <> ''"""


def _top_words(table: str) -> str:
    return f"""
WITH w AS (SELECT unnest(string_split(lower(text), ' ')) AS word FROM {table}),
c AS (SELECT word, CAST(count(*) AS BIGINT) AS word_count FROM w
      WHERE word NOT IN ({STOP_LIST}) AND regexp_matches(word, '^[^\\n]{{3,}}\\n?$')
      GROUP BY word),
t AS (SELECT word, word_count,
             CAST(row_number() OVER (ORDER BY word_count DESC, word ASC) AS BIGINT) AS rank
      FROM c QUALIFY rank <= {S.TOP_WORDS})
SELECT word, word_count, rank, {_bar('word_count', S.BAR_WIDTH_WORDS)} AS bar_length FROM t"""


def _contributors(counts_cte: str, repo: str, tie: str, positive: bool) -> str:
    where = f"repo_name = '{repo}'" + (" AND commit_count > 0" if positive else "")
    return f"""
WITH {counts_cte},
t AS (SELECT author_name, commit_count,
             CAST(row_number() OVER (ORDER BY commit_count DESC, author_name {tie}) AS BIGINT) AS rank
      FROM author_counts WHERE {where} QUALIFY rank <= {S.TOP_CONTRIBUTORS})
SELECT author_name, commit_count, rank, {_bar('commit_count', S.BAR_WIDTH_CONTRIBUTORS)} AS bar_length FROM t"""


def _license_report(source: str, tie: str, positive: bool) -> str:
    pos = "WHERE repo_count > 0" if positive else ""
    return f"""
WITH lic AS ({source}),
cnt AS (SELECT license AS license_name, CAST(count(*) AS BIGINT) AS repo_count FROM lic
        WHERE license IS NOT NULL AND license <> '' GROUP BY license),
t AS (SELECT license_name, repo_count,
             CAST(row_number() OVER (ORDER BY repo_count DESC, license_name {tie}) AS BIGINT) AS rank
      FROM cnt {pos} QUALIFY rank <= {S.TOP_LICENSES})
SELECT license_name, repo_count, rank, {_bar('repo_count', S.BAR_WIDTH_LICENSES)} AS bar_length,
       CASE WHEN sum(repo_count) OVER () = 0 THEN 0.0
            ELSE repo_count::DOUBLE / (sum(repo_count) OVER ())::DOUBLE * 100.0 END AS share_of_top
FROM t"""


def _bucket_histogram(repos: str) -> str:
    return f"""
WITH r AS ({repos}),
b AS (SELECT {_bucket('watch_count')} AS bound FROM r),
c AS (SELECT bound, CAST(count(*) AS BIGINT) AS repo_count FROM b GROUP BY bound)
SELECT {_bucket_label('bound')} AS watch_range, repo_count,
       CAST(row_number() OVER (ORDER BY bound ASC NULLS LAST) AS BIGINT) AS bucket_order,
       {_bar('repo_count', S.BAR_WIDTH_HISTOGRAM)} AS bar_length
FROM c"""


CREATES = """
ch AS (
  SELECT o_orderkey * 10 + 1 AS seq, 'create' AS op, CAST(o_orderkey AS VARCHAR) AS commit_hash,
         o_orderpriority AS repo_name, 'Author#' || CAST(o_custkey AS VARCHAR) AS author_name,
         'Recreate ' || CAST(o_orderkey AS VARCHAR) AS subject
  FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'
  UNION ALL
  SELECT o_orderkey * 10 + 2, 'create', 'new-' || CAST(o_orderkey AS VARCHAR), o_orderpriority,
         CASE WHEN o_orderstatus = 'P' THEN '   ' ELSE 'Author#' || CAST(o_custkey AS VARCHAR) END,
         'Create ' || CAST(o_orderkey AS VARCHAR)
  FROM orders WHERE o_orderpriority = '5-LOW'
  UNION ALL
  SELECT o_orderkey * 10 + 7, 'create', 'new-' || CAST(o_orderkey AS VARCHAR), o_orderpriority,
         'Second Author', 'Create again ' || CAST(o_orderkey AS VARCHAR)
  FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F'
),
cv AS (
  SELECT *, (trim(commit_hash) <> '' AND trim(repo_name) <> '' AND trim(author_name) <> '') AS valid FROM ch
)"""

DELETES = """
del AS (
  SELECT o_orderkey * 10 + 1 AS seq, 'delete' AS op, CAST(o_orderkey AS VARCHAR) AS commit_hash
  FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F'
  UNION ALL
  SELECT o_orderkey * 10 + 2, 'delete', CAST(o_orderkey AS VARCHAR)
  FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F'
  UNION ALL
  SELECT o_orderkey * 10 + 3, 'delete', 'missing-' || CAST(o_orderkey AS VARCHAR)
  FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
)"""

UPDATES = """
upd AS (
  SELECT o_orderkey * 10 + 1 AS seq, CAST(o_orderkey AS VARCHAR) AS commit_hash, 'subject' AS field,
         'edited ' || CAST(o_orderkey AS VARCHAR) AS value
  FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'O'
  UNION ALL SELECT o_orderkey * 10 + 2, CAST(o_orderkey AS VARCHAR), 'subject', 'edited twice ' || CAST(o_orderkey AS VARCHAR)
  FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'O'
  UNION ALL SELECT o_orderkey * 10 + 3, CAST(o_orderkey AS VARCHAR), 'num_files_changed', '7'
  FROM orders WHERE o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey * 10 + 4, CAST(o_orderkey AS VARCHAR), 'num_files_changed', 'seven'
  FROM orders WHERE o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O'
  UNION ALL SELECT o_orderkey * 10 + 5, CAST(o_orderkey AS VARCHAR), 'commit_hash', 'x'
  FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey * 10 + 6, 'missing-' || CAST(o_orderkey AS VARCHAR), 'subject', 'nobody'
  FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey * 10 + 7, 'missing-' || CAST(o_orderkey AS VARCHAR), 'bogus', '1'
  FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey * 10 + 8, CAST(o_orderkey AS VARCHAR), 'author_name', 'Renamed Author'
  FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
),
upd_status AS (
  SELECT u.seq, 'update' AS op, u.commit_hash,
         CASE WHEN u.field NOT IN ('repo_name', 'author_name', 'author_email', 'committer_name',
                                   'subject', 'message', 'tree', 'num_files_changed') THEN 'invalid_field'
              WHEN c.commit_hash IS NULL THEN 'not_found'
              WHEN u.field = 'num_files_changed' AND TRY_CAST(u.value AS BIGINT) IS NULL THEN 'invalid_value'
              ELSE 'updated' END AS status,
         u.field, u.value
  FROM upd u LEFT JOIN commits c ON c.commit_hash = u.commit_hash
),
last_set AS (
  SELECT commit_hash, field, value FROM (
    SELECT *, row_number() OVER (PARTITION BY commit_hash, field ORDER BY seq DESC) AS rn
    FROM upd_status WHERE status = 'updated') WHERE rn = 1
)"""


SQL: dict[str, str] = {}

SQL["top_words"] = _top_words("documents")
SQL["top_words_conversations"] = _top_words("conversations")

SQL["author_counts"] = f"WITH {COMMITS} SELECT * FROM author_counts"
SQL["top_contributors_redis"] = _contributors(COMMITS, "1-URGENT", "DESC", False)
SQL["top_contributors_cassandra"] = _contributors(COMMITS, "1-URGENT", "ASC", True)
SQL["top_contributors_per_repo"] = f"""
WITH {COMMITS},
t AS (SELECT repo_name, author_name, commit_count,
             CAST(row_number() OVER (PARTITION BY repo_name ORDER BY commit_count DESC, author_name ASC) AS BIGINT) AS rank
      FROM author_counts QUALIFY rank <= {S.TOP_CONTRIBUTORS})
SELECT repo_name, author_name, commit_count, rank,
       {_bar('commit_count', S.BAR_WIDTH_CONTRIBUTORS, 'repo_name')} AS bar_length FROM t"""
SQL["repos_loaded"] = f"WITH {COMMITS} SELECT DISTINCT repo_name FROM commits"
SQL["commits_by_repo"] = (
    f"WITH {COMMITS} SELECT repo_name, commit_hash, author_name, subject, num_files_changed FROM commits"
)
SQL["commits_normalised"] = f"WITH {COMMITS} SELECT {COMMIT_COLS} FROM commits"
SQL["commits_from_ndjson"] = SQL["commits_normalised"]
SQL["commits_latest_by_hash"] = """
WITH v AS (
  SELECT ((l_orderkey * 100 + l_linenumber) * 2 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) * 4
         + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS seq,
         'p' || CAST(l_partkey AS VARCHAR) || '-s' || CAST(l_suppkey AS VARCHAR) AS commit_hash,
         'flag-' || l_returnflag AS repo_name,
         'Supplier#' || CAST(l_suppkey AS VARCHAR) AS author_name,
         '' AS author_email, 'unknown' AS committer_name,
         'line ' || CAST(l_linenumber AS VARCHAR) || ' of order ' || CAST(l_orderkey AS VARCHAR) AS subject,
         coalesce(l_linestatus, '') AS message, '' AS tree,
         'o/' || CAST(l_orderkey AS VARCHAR) AS files_changed, CAST(1 AS BIGINT) AS num_files_changed
  FROM lineitem)
SELECT commit_hash, repo_name, author_name, author_email, committer_name, subject, message, tree,
       files_changed, num_files_changed
FROM v QUALIFY row_number() OVER (PARTITION BY commit_hash ORDER BY seq DESC) = 1"""
SQL["load_summary"] = f"""WITH {COMMITS}
SELECT CAST(count(*) AS BIGINT) AS record_count, CAST(count(DISTINCT repo_name) AS BIGINT) AS repo_count FROM commits"""

SQL["ndjson_ingest_repos"] = """
SELECT c_name AS repo_name,
       CASE WHEN c_mktsegment = 'MACHINERY' AND c_nationkey < 10 THEN CAST(0 AS BIGINT)
            ELSE CAST(trunc(c_acctbal) AS BIGINT) END AS watch_count,
       CAST(length(c_name) AS BIGINT) AS name_length
FROM customer
WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING') AND NOT (c_mktsegment = 'FURNITURE' AND c_nationkey < 5)"""
SQL["ingest_reject_counts"] = """
WITH o AS (
  SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'blank'
              WHEN c_mktsegment = 'AUTOMOBILE' THEN 'malformed'
              WHEN c_mktsegment = 'FURNITURE' AND c_nationkey < 5 THEN 'missing_key'
              ELSE 'accepted' END AS outcome
  FROM customer),
d AS (SELECT * FROM (VALUES ('accepted'), ('blank'), ('malformed'), ('missing_key')) AS t(outcome))
SELECT d.outcome, CAST(count(o.outcome) AS BIGINT) AS line_count
FROM d LEFT JOIN o ON o.outcome = d.outcome GROUP BY d.outcome"""

SQL["licenses_rows"] = f"""WITH lic AS ({LICENSES_PARTS})
SELECT repo_name, license FROM lic
WHERE repo_name IS NOT NULL AND repo_name <> '' AND license IS NOT NULL AND license <> ''"""
SQL["licenses_accept_counts"] = f"""WITH lic AS ({LICENSES_PARTS})
SELECT license AS license_name, CAST(count(*) AS BIGINT) AS repo_count FROM lic
WHERE license IS NOT NULL AND license <> '' GROUP BY license"""
SQL["top_licenses_redis"] = _license_report(LICENSES_PARTS, "DESC", False)
SQL["top_licenses_cassandra"] = _license_report(LICENSES_PARTS, "ASC", True)
SQL["top_licenses_tied"] = _license_report(
    "SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS repo_name, source AS license FROM documents", "ASC", True
)
SQL["refresh_then_reload"] = SQL["licenses_accept_counts"]
SQL["accumulate_reload"] = f"""WITH lic AS ({LICENSES_PARTS})
SELECT license AS license_name, CAST(2 * count(*) AS BIGINT) AS repo_count FROM lic
WHERE license IS NOT NULL AND license <> '' GROUP BY license"""

SQL["languages_unnested"] = LANGUAGES
SQL["language_bytes"] = f"""WITH l AS ({LANGUAGES})
SELECT name, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM l GROUP BY name"""
SQL["top_languages"] = f"""WITH l AS ({LANGUAGES}),
b AS (SELECT name, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM l GROUP BY name)
SELECT name, total_bytes,
       CAST(row_number() OVER (ORDER BY total_bytes DESC, name DESC) AS BIGINT) AS rank
FROM b QUALIFY rank <= {S.TOP_LANGUAGES}"""

SQL["repos_by_tier"] = f"""WITH r AS ({REPOS_PARTS})
SELECT DISTINCT {_tier('watch_count')} AS watch_tier, watch_count, repo_name FROM r"""
SQL["tier_counts"] = f"""WITH r AS ({REPOS_DOCS})
SELECT {_tier('watch_count')} AS watch_tier, CAST(count(*) AS BIGINT) AS repo_count FROM r GROUP BY 1"""
SQL["watch_tiers_dense"] = f"""
WITH r AS ({REPOS_DOCS}),
c AS (SELECT {_tier('watch_count')} AS watch_tier, count(*) AS n FROM r GROUP BY 1),
d AS (SELECT * FROM (VALUES ('0 watchers', 1), ('1 to 9', 2), ('10 to 99', 3), ('100 to 999', 4),
                            ('1,000 to 9,999', 5), ('10,000+', 6)) AS t(watch_tier, tier_order)),
f AS (SELECT d.watch_tier, CAST(d.tier_order AS BIGINT) AS tier_order, CAST(coalesce(c.n, 0) AS BIGINT) AS repo_count
      FROM d LEFT JOIN c ON c.watch_tier = d.watch_tier)
SELECT watch_tier, tier_order, repo_count, {_bar('repo_count', S.BAR_WIDTH_HISTOGRAM)} AS bar_length FROM f"""
SQL["watch_buckets_neg"] = _bucket_histogram(REPOS_ACCOUNTS)
SQL["watch_buckets_million"] = _bucket_histogram(REPOS_SPEND)
SQL["most_watched"] = f"""WITH r AS ({REPOS_PARTS})
SELECT repo_name, watch_count,
       CAST(row_number() OVER (ORDER BY watch_count DESC, repo_name ASC) AS BIGINT) AS rank
FROM r QUALIFY rank <= {S.TOP_WATCHED}"""
SQL["most_watched_in_tier"] = f"""WITH r AS ({REPOS_PARTS}),
t AS (SELECT DISTINCT {_tier('watch_count')} AS watch_tier, watch_count, repo_name FROM r)
SELECT watch_tier, watch_count, repo_name,
       CAST(row_number() OVER (ORDER BY watch_count DESC, repo_name ASC) AS BIGINT) AS rank
FROM t WHERE watch_tier = '10 to 99' QUALIFY rank <= {S.TOP_WATCHED}"""
SQL["most_watched_overall"] = f"""WITH r AS ({REPOS_DOCS}),
t AS (SELECT DISTINCT {_tier('watch_count')} AS watch_tier, watch_count, repo_name FROM r)
SELECT watch_tier, watch_count, repo_name,
       CAST(row_number() OVER (ORDER BY watch_count DESC, repo_name ASC) AS BIGINT) AS rank
FROM t QUALIFY rank <= {S.TOP_WATCHED}"""
SQL["most_watched_per_tier"] = f"""WITH r AS ({REPOS_DOCS}),
t AS (SELECT DISTINCT {_tier('watch_count')} AS watch_tier, watch_count, repo_name FROM r),
k AS (SELECT watch_tier, watch_count, repo_name,
             CAST(row_number() OVER (PARTITION BY watch_tier ORDER BY watch_count DESC, repo_name ASC) AS BIGINT) AS rank
      FROM t QUALIFY rank <= {S.TOP_WATCHED})
SELECT watch_tier, watch_count, repo_name, rank,
       CAST(CASE watch_tier WHEN '0 watchers' THEN 1 WHEN '1 to 9' THEN 2 WHEN '10 to 99' THEN 3
            WHEN '100 to 999' THEN 4 WHEN '1,000 to 9,999' THEN 5 WHEN '10,000+' THEN 6 END AS BIGINT) AS tier_order
FROM k"""

SQL["repo_name_lengths"] = URLS
SQL["name_stats"] = f"""WITH r AS ({URLS})
SELECT avg(name_length) AS avg_length, CAST(min(name_length) AS BIGINT) AS min_length,
       CAST(max(name_length) AS BIGINT) AS max_length, CAST(count(*) AS BIGINT) AS total
FROM r HAVING count(*) > 0"""
SQL["name_stats_empty"] = f"""WITH r AS ({URLS})
SELECT avg(name_length) AS avg_length, CAST(min(name_length) AS BIGINT) AS min_length,
       CAST(max(name_length) AS BIGINT) AS max_length, CAST(count(*) AS BIGINT) AS total
FROM r WHERE starts_with(repo_name, 'ftp://') HAVING count(*) > 0"""
SQL["longest_names"] = f"""WITH r AS ({URLS})
SELECT repo_name, name_length,
       CAST(row_number() OVER (ORDER BY name_length DESC, repo_name ASC) AS BIGINT) AS rank
FROM r QUALIFY rank <= {S.TOP_NAMES}"""
SQL["shortest_names"] = f"""WITH r AS ({URLS})
SELECT repo_name, name_length,
       CAST(row_number() OVER (ORDER BY name_length ASC, repo_name ASC) AS BIGINT) AS rank
FROM r QUALIFY rank <= {S.TOP_NAMES}"""

SQL["list_commits_by_repo"] = f"""WITH {COMMITS}
SELECT commit_hash, author_name, subject, num_files_changed,
       substr(commit_hash, 1, 10) AS short_hash, substr(subject, 1, 50) AS subject_preview
FROM commits WHERE repo_name = '2-HIGH' ORDER BY commit_hash LIMIT {S.LIST_LIMIT}"""
SQL["search_author"] = f"""WITH {COMMITS}
SELECT {COMMIT_COLS} FROM commits
WHERE regexp_matches(author_name, 'customer#0000000[0-4]', 'i')
ORDER BY commit_hash LIMIT {S.LIST_LIMIT}"""
SQL["lookup_batch"] = f"""WITH {COMMITS},
k AS (SELECT DISTINCT commit_hash FROM (
        SELECT CAST(o_orderkey AS VARCHAR) AS commit_hash FROM orders WHERE o_orderstatus = 'P'
        UNION ALL
        SELECT 'absent-' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '5-LOW'))
SELECT k.commit_hash, c.commit_hash IS NOT NULL AS found, c.repo_name, c.author_name, c.subject, c.num_files_changed
FROM k LEFT JOIN commits c ON c.commit_hash = k.commit_hash"""

SQL["create_if_absent"] = f"""WITH {COMMITS}, {CREATES.strip()}
SELECT seq, op, trim(commit_hash) AS commit_hash,
       CASE WHEN NOT valid THEN 'invalid'
            WHEN trim(commit_hash) IN (SELECT commit_hash FROM commits) THEN 'duplicate'
            WHEN seq = min(CASE WHEN valid THEN seq END) OVER (PARTITION BY trim(commit_hash)) THEN 'created'
            ELSE 'duplicate' END AS status
FROM cv"""
SQL["create_if_absent_snapshot"] = f"""WITH {COMMITS}, {CREATES.strip()},
firsts AS (SELECT * FROM cv WHERE valid
           QUALIFY row_number() OVER (PARTITION BY trim(commit_hash) ORDER BY seq) = 1)
SELECT {COMMIT_COLS} FROM commits
UNION ALL
SELECT trim(commit_hash), trim(repo_name), trim(author_name), '', trim(author_name), subject, '', '', '', 0
FROM firsts WHERE trim(commit_hash) NOT IN (SELECT commit_hash FROM commits)"""
SQL["create_upsert"] = f"""WITH {CREATES.strip()}
SELECT seq, op, trim(commit_hash) AS commit_hash,
       CASE WHEN valid THEN 'created' ELSE 'invalid' END AS status FROM cv"""
SQL["create_upsert_snapshot"] = f"""WITH {COMMITS}, {CREATES.strip()},
lasts AS (SELECT * FROM cv WHERE valid
          QUALIFY row_number() OVER (PARTITION BY trim(commit_hash) ORDER BY seq DESC) = 1)
SELECT {COMMIT_COLS} FROM commits WHERE commit_hash NOT IN (SELECT trim(commit_hash) FROM lasts)
UNION ALL
SELECT trim(commit_hash), trim(repo_name), trim(author_name), '', trim(author_name), subject, '', '', '', 0
FROM lasts"""

SQL["update_fields"] = f"""WITH {COMMITS}, {UPDATES.strip()}
SELECT seq, op, commit_hash, status FROM upd_status"""
SQL["update_fields_snapshot"] = f"""WITH {COMMITS}, {UPDATES.strip()},
p AS (SELECT commit_hash,
             max(CASE WHEN field = 'subject' THEN value END) AS subject,
             max(CASE WHEN field = 'author_name' THEN value END) AS author_name,
             max(CASE WHEN field = 'num_files_changed' THEN value END) AS num_files_changed,
             bool_or(field = 'subject') AS set_subject,
             bool_or(field = 'author_name') AS set_author,
             bool_or(field = 'num_files_changed') AS set_files
      FROM last_set GROUP BY commit_hash)
SELECT c.commit_hash, c.repo_name,
       CASE WHEN p.set_author THEN p.author_name ELSE c.author_name END AS author_name,
       c.author_email, c.committer_name,
       CASE WHEN p.set_subject THEN p.subject ELSE c.subject END AS subject,
       c.message, c.tree, c.files_changed,
       CASE WHEN p.set_files THEN CAST(p.num_files_changed AS BIGINT) ELSE c.num_files_changed END AS num_files_changed
FROM commits c LEFT JOIN p ON p.commit_hash = c.commit_hash"""

SQL["delete_batch"] = f"""WITH {COMMITS}, {DELETES.strip()}
SELECT d.seq, d.op, d.commit_hash,
       CASE WHEN d.commit_hash IN (SELECT commit_hash FROM commits)
                 AND d.seq = min(d.seq) OVER (PARTITION BY d.commit_hash) THEN 'deleted'
            ELSE 'not_found' END AS status
FROM del d"""
SQL["delete_batch_snapshot"] = f"""WITH {COMMITS}, {DELETES.strip()}
SELECT {COMMIT_COLS} FROM commits WHERE commit_hash NOT IN (SELECT commit_hash FROM del)"""

_AFTER = f"""WITH {COMMITS}, {CREATES.strip()}, {DELETES.strip()},
firsts AS (SELECT * FROM cv WHERE valid
           QUALIFY row_number() OVER (PARTITION BY trim(commit_hash) ORDER BY seq) = 1),
created AS (SELECT trim(commit_hash) AS commit_hash, trim(repo_name) AS repo_name, trim(author_name) AS author_name
            FROM firsts WHERE trim(commit_hash) NOT IN (SELECT commit_hash FROM commits)),
snap AS (SELECT commit_hash, repo_name, author_name FROM commits
         UNION ALL SELECT commit_hash, repo_name, author_name FROM created),
final AS (SELECT * FROM snap WHERE commit_hash NOT IN (SELECT commit_hash FROM del)),
recount AS (SELECT repo_name, author_name, count(*) AS n FROM final GROUP BY ALL),
members AS (SELECT repo_name, author_name FROM author_counts
            UNION SELECT repo_name, author_name FROM created),
merged AS (SELECT m.repo_name, m.author_name, CAST(coalesce(r.n, 0) AS BIGINT) AS commit_count
           FROM members m LEFT JOIN recount r ON r.repo_name = m.repo_name AND r.author_name = m.author_name)"""
SQL["author_counts_after_changes"] = f"{_AFTER} SELECT * FROM merged"
SQL["top_contributors_after_changes"] = f"""{_AFTER},
t AS (SELECT author_name, commit_count,
             CAST(row_number() OVER (ORDER BY commit_count DESC, author_name ASC) AS BIGINT) AS rank
      FROM merged WHERE repo_name = '4-NOT SPECIFIED' AND commit_count > 0 QUALIFY rank <= {S.TOP_CONTRIBUTORS})
SELECT author_name, commit_count, rank, {_bar('commit_count', S.BAR_WIDTH_CONTRIBUTORS)} AS bar_length FROM t"""

SQL["stream_author_counts"] = SQL["author_counts"]
SQL["stream_language_bytes"] = SQL["language_bytes"]
SQL["stream_upsert"] = SQL["commits_latest_by_hash"]

SQL["commits_keep_nulls"] = f"""WITH {COMMITS}
SELECT commit_hash, repo_name, author_name, author_email, committer_name, subject,
       CASE WHEN message = '' THEN NULL ELSE message END AS message, tree, files_changed, num_files_changed
FROM commits"""

_VERSIONS = """
v AS (
  SELECT ((l_orderkey * 100 + l_linenumber) * 2 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) * 4
         + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS seq,
         'p' || CAST(l_partkey AS VARCHAR) || '-s' || CAST(l_suppkey AS VARCHAR) AS commit_hash,
         'flag-' || l_returnflag AS repo_name,
         'Supplier#' || CAST(l_suppkey AS VARCHAR) AS author_name
  FROM lineitem)"""
SQL["author_counts_versions"] = f"""WITH {_VERSIONS.strip()}
SELECT repo_name, author_name, CAST(count(*) AS BIGINT) AS commit_count FROM v GROUP BY ALL"""
SQL["author_counts_snapshot"] = f"""WITH {_VERSIONS.strip()},
latest AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY commit_hash ORDER BY seq DESC) = 1)
SELECT repo_name, author_name, CAST(count(*) AS BIGINT) AS commit_count FROM latest GROUP BY ALL"""
SQL["read_record"] = f"WITH {COMMITS} SELECT {COMMIT_COLS} FROM commits WHERE commit_hash = '1'"
SQL["repos_loaded_after_purge"] = f"""WITH {COMMITS}
SELECT DISTINCT repo_name FROM commits WHERE repo_name <> '3-MEDIUM'"""
SQL["repos_loaded_sticky"] = f"WITH {COMMITS} SELECT DISTINCT repo_name FROM commits"
SQL["load_all_tables"] = f"""WITH {COMMITS},
r AS ({REPOS_DOCS}),
lic AS ({LICENSES_PARTS}),
l AS ({LANGUAGES})
SELECT table_name, CAST(row_count AS BIGINT) AS row_count FROM (
  SELECT 'commits' AS table_name, count(*) AS row_count FROM commits
  UNION ALL SELECT 'commits_by_repo', count(*) FROM commits
  UNION ALL SELECT 'author_counts', count(*) FROM author_counts
  UNION ALL SELECT 'repos_loaded', count(DISTINCT repo_name) FROM commits
  UNION ALL SELECT 'repos', count(*) FROM r WHERE repo_name IS NOT NULL AND repo_name <> ''
  UNION ALL SELECT 'repos_by_tier', count(*) FROM (SELECT DISTINCT {_tier('watch_count')}, watch_count, repo_name FROM r)
  UNION ALL SELECT 'tier_counts', count(DISTINCT {_tier('watch_count')}) FROM r
  UNION ALL SELECT 'licenses', count(*) FROM lic WHERE repo_name IS NOT NULL AND repo_name <> ''
                                                   AND license IS NOT NULL AND license <> ''
  UNION ALL SELECT 'license_counts', count(DISTINCT license) FROM lic WHERE license IS NOT NULL AND license <> ''
  UNION ALL SELECT 'languages', count(*) FROM l
  UNION ALL SELECT 'language_bytes', count(DISTINCT name) FROM l)"""

MIXED = """
mk AS (SELECT o_orderkey AS k, o_custkey AS cust, o_orderpriority AS prio, o_orderstatus AS st FROM orders),
ops AS (
  SELECT k * 10 + 1 AS seq, 'delete' AS op, CAST(k AS VARCHAR) AS commit_hash, NULL AS field, NULL AS value,
         NULL AS repo_name, NULL AS author_name, NULL AS subject FROM mk WHERE prio = '1-URGENT' AND st = 'O'
  UNION ALL SELECT k * 10 + 2, 'create', CAST(k AS VARCHAR), NULL, NULL, prio, 'Author#' || CAST(cust AS VARCHAR),
         'Recreated ' || CAST(k AS VARCHAR) FROM mk WHERE prio = '1-URGENT' AND st = 'O'
  UNION ALL SELECT k * 10 + 3, 'update', CAST(k AS VARCHAR), 'subject', 'after ' || CAST(k AS VARCHAR), NULL, NULL, NULL
         FROM mk WHERE prio = '1-URGENT' AND st = 'O'
  UNION ALL SELECT k * 10 + 1, 'update', CAST(k AS VARCHAR), 'author_name', 'Temp', NULL, NULL, NULL
         FROM mk WHERE prio = '2-HIGH' AND st = 'F'
  UNION ALL SELECT k * 10 + 2, 'delete', CAST(k AS VARCHAR), NULL, NULL, NULL, NULL, NULL
         FROM mk WHERE prio = '2-HIGH' AND st = 'F'
  UNION ALL SELECT k * 10 + 1, 'create', 'mix-' || CAST(k AS VARCHAR), NULL, NULL, prio, 'New#' || CAST(cust AS VARCHAR), 'new'
         FROM mk WHERE prio = '3-MEDIUM' AND st = 'O'
  UNION ALL SELECT k * 10 + 2, 'update', 'mix-' || CAST(k AS VARCHAR), 'subject', 'edited', NULL, NULL, NULL
         FROM mk WHERE prio = '3-MEDIUM' AND st = 'O'
  UNION ALL SELECT k * 10 + 3, 'delete', 'mix-' || CAST(k AS VARCHAR), NULL, NULL, NULL, NULL, NULL
         FROM mk WHERE prio = '3-MEDIUM' AND st = 'O'
  UNION ALL SELECT k * 10 + 4, 'update', 'mix-' || CAST(k AS VARCHAR), 'tree', 'T', NULL, NULL, NULL
         FROM mk WHERE prio = '3-MEDIUM' AND st = 'O'
  UNION ALL SELECT k * 10 + 5, 'create', 'mix-' || CAST(k AS VARCHAR), NULL, NULL, prio, 'Again#' || CAST(cust AS VARCHAR), 'again'
         FROM mk WHERE prio = '3-MEDIUM' AND st = 'O'
  UNION ALL SELECT k * 10 + 1, 'create', CAST(k AS VARCHAR), NULL, NULL, prio, 'Dup', 'dup'
         FROM mk WHERE prio = '4-NOT SPECIFIED' AND st = 'P'
  UNION ALL SELECT k * 10 + 2, 'update', CAST(k AS VARCHAR), 'num_files_changed', 'x', NULL, NULL, NULL
         FROM mk WHERE prio = '4-NOT SPECIFIED' AND st = 'P'
  UNION ALL SELECT k * 10 + 3, 'update', CAST(k AS VARCHAR), 'tree', 'T', NULL, NULL, NULL
         FROM mk WHERE prio = '4-NOT SPECIFIED' AND st = 'P'
  UNION ALL SELECT k * 10 + 4, 'delete', 'gone-' || CAST(k AS VARCHAR), NULL, NULL, NULL, NULL, NULL
         FROM mk WHERE prio = '4-NOT SPECIFIED' AND st = 'P'
  UNION ALL SELECT k * 10 + 1, 'update', CAST(k AS VARCHAR), 'bogus', '1', NULL, NULL, NULL
         FROM mk WHERE prio = '5-LOW' AND st = 'F'
  UNION ALL SELECT k * 10 + 2, 'create', 'blank-' || CAST(k AS VARCHAR), NULL, NULL, prio, '  ', 'blank'
         FROM mk WHERE prio = '5-LOW' AND st = 'F'
),
t AS (
  SELECT *,
         op = 'create' AND coalesce(trim(repo_name), '') <> '' AND coalesce(trim(author_name), '') <> '' AS valid,
         CASE WHEN op = 'create' AND coalesce(trim(repo_name), '') <> '' AND coalesce(trim(author_name), '') <> ''
              THEN TRUE WHEN op = 'delete' THEN FALSE END AS eff
  FROM ops
),
e AS (
  SELECT t.*,
         coalesce(last_value(eff IGNORE NULLS) OVER (PARTITION BY commit_hash ORDER BY seq
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                  commit_hash IN (SELECT commit_hash FROM commits)) AS before
  FROM t
),
st AS (
  SELECT *,
         CASE WHEN op = 'create' AND NOT valid THEN 'invalid'
              WHEN op = 'create' AND before THEN 'duplicate'
              WHEN op = 'create' THEN 'created'
              WHEN op = 'delete' AND before THEN 'deleted'
              WHEN op = 'delete' THEN 'not_found'
              WHEN field NOT IN ('repo_name', 'author_name', 'author_email', 'committer_name',
                                 'subject', 'message', 'tree', 'num_files_changed') THEN 'invalid_field'
              WHEN NOT before THEN 'not_found'
              WHEN field = 'num_files_changed' AND TRY_CAST(value AS BIGINT) IS NULL THEN 'invalid_value'
              ELSE 'updated' END AS status
  FROM e
)"""

_MIXED_FINAL = f"""WITH {COMMITS}, {MIXED.strip()},
fin AS (SELECT commit_hash, arg_max(eff, seq) AS exists_final FROM st WHERE eff IS NOT NULL GROUP BY commit_hash),
anc AS (SELECT * FROM st WHERE status IN ('created', 'deleted')
        QUALIFY row_number() OVER (PARTITION BY commit_hash ORDER BY seq DESC) = 1),
upd AS (SELECT s.* FROM st s LEFT JOIN anc a ON a.commit_hash = s.commit_hash
        WHERE s.status = 'updated' AND (a.seq IS NULL OR s.seq > a.seq)
        QUALIFY row_number() OVER (PARTITION BY s.commit_hash, s.field ORDER BY s.seq DESC) = 1),
p AS (SELECT commit_hash,
             max(CASE WHEN field = 'subject' THEN value END) AS subject,
             max(CASE WHEN field = 'author_name' THEN value END) AS author_name,
             max(CASE WHEN field = 'tree' THEN value END) AS tree,
             max(CASE WHEN field = 'num_files_changed' THEN value END) AS nfc,
             bool_or(field = 'subject') AS set_subject, bool_or(field = 'author_name') AS set_author,
             bool_or(field = 'tree') AS set_tree, bool_or(field = 'num_files_changed') AS set_nfc
      FROM upd GROUP BY commit_hash),
keys AS (SELECT commit_hash FROM commits UNION SELECT commit_hash FROM st),
j AS (
  SELECT k.commit_hash,
         coalesce(f.exists_final, c.commit_hash IS NOT NULL) AS exists_final,
         coalesce(a.op = 'create', FALSE) AS anchored,
         c.repo_name AS o_repo, c.author_name AS o_author, c.author_email AS o_email,
         c.committer_name AS o_committer, c.subject AS o_subject, c.message AS o_message, c.tree AS o_tree,
         c.files_changed AS o_files, c.num_files_changed AS o_nfc,
         trim(a.repo_name) AS a_repo, trim(a.author_name) AS a_author, a.subject AS a_subject,
         p.subject AS p_subject, p.author_name AS p_author, p.tree AS p_tree, p.nfc AS p_nfc,
         coalesce(p.set_subject, FALSE) AS set_subject, coalesce(p.set_author, FALSE) AS set_author,
         coalesce(p.set_tree, FALSE) AS set_tree, coalesce(p.set_nfc, FALSE) AS set_nfc
  FROM keys k LEFT JOIN commits c ON c.commit_hash = k.commit_hash
  LEFT JOIN fin f ON f.commit_hash = k.commit_hash
  LEFT JOIN anc a ON a.commit_hash = k.commit_hash
  LEFT JOIN p ON p.commit_hash = k.commit_hash
),
final AS (
  SELECT commit_hash,
         CASE WHEN anchored THEN a_repo ELSE o_repo END AS repo_name,
         CASE WHEN set_author THEN p_author WHEN anchored THEN a_author ELSE o_author END AS author_name,
         CASE WHEN anchored THEN '' ELSE o_email END AS author_email,
         CASE WHEN anchored THEN a_author ELSE o_committer END AS committer_name,
         CASE WHEN set_subject THEN p_subject WHEN anchored THEN coalesce(a_subject, '') ELSE o_subject END AS subject,
         CASE WHEN anchored THEN '' ELSE o_message END AS message,
         CASE WHEN set_tree THEN p_tree WHEN anchored THEN '' ELSE o_tree END AS tree,
         CASE WHEN anchored THEN '' ELSE o_files END AS files_changed,
         CASE WHEN set_nfc THEN CAST(p_nfc AS BIGINT) WHEN anchored THEN CAST(0 AS BIGINT) ELSE o_nfc END
           AS num_files_changed
  FROM j WHERE exists_final
)"""

SQL["mixed_changes"] = f"""WITH {COMMITS}, {MIXED.strip()}
SELECT seq, op, commit_hash, status FROM st"""
SQL["mixed_changes_snapshot"] = f"{_MIXED_FINAL} SELECT {COMMIT_COLS} FROM final"
SQL["mixed_changes_counts"] = f"""{_MIXED_FINAL}
SELECT repo_name, author_name, CAST(count(*) AS BIGINT) AS commit_count FROM final GROUP BY ALL"""

SQL["commit_hash_records"] = """
WITH lp AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_returnflag = 'N' THEN '' ELSE 'f/' || CAST(l_partkey AS VARCHAR) END AS new_path
  FROM lineitem),
f AS (SELECT l_orderkey, count(*) AS n,
             list(new_path ORDER BY l_linenumber, new_path) FILTER (WHERE new_path <> '') AS files
      FROM lp GROUP BY l_orderkey)
SELECT CAST(o.o_orderkey AS VARCHAR) AS commit_hash, o.o_orderpriority AS repo_name,
       CASE WHEN o.o_orderstatus = 'P' THEN 'unknown' ELSE coalesce(c.c_name, 'unknown') END AS author_name,
       coalesce(CAST(to_json(f.files) AS VARCHAR), '[]') AS files_changed,
       CAST(coalesce(f.n, 0) AS BIGINT) AS num_files_changed
FROM orders o LEFT JOIN f ON f.l_orderkey = o.o_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey"""

SQL["file_load_rejects"] = """
WITH o AS (
  SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'blank'
              WHEN c_mktsegment = 'AUTOMOBILE' THEN 'malformed'
              WHEN c_mktsegment = 'FURNITURE' AND c_nationkey < 5 THEN 'missing_key'
              ELSE 'accepted' END AS outcome
  FROM customer),
d AS (SELECT * FROM (VALUES ('accepted'), ('blank'), ('malformed'), ('missing_key')) AS t(outcome))
SELECT 'repos' AS source, d.outcome, CAST(count(o.outcome) AS BIGINT) AS line_count
FROM d LEFT JOIN o ON o.outcome = d.outcome GROUP BY d.outcome"""

SQL["top_words_commits"] = f"""
WITH {COMMITS},
w AS (SELECT unnest(string_split(lower(subject), ' ')) AS word FROM commits),
c AS (SELECT word, CAST(count(*) AS BIGINT) AS word_count FROM w
      WHERE word NOT IN ({STOP_LIST}) AND regexp_matches(word, '^[^\\n]{{3,}}\\n?$')
      GROUP BY word),
t AS (SELECT word, word_count,
             CAST(row_number() OVER (ORDER BY word_count DESC, word ASC) AS BIGINT) AS rank
      FROM c QUALIFY rank <= {S.TOP_WORDS})
SELECT word, word_count, rank, {_bar('word_count', S.BAR_WIDTH_WORDS)} AS bar_length FROM t"""

SQL["change_file_status"] = SQL["mixed_changes"]

SQL["stream_counts_rerun"] = SQL["author_counts"]
SQL["stream_upsert_files"] = SQL["commits_latest_by_hash"]
SQL["loaded_commits"] = SQL["commits_normalised"]
SQL["loaded_commits_by_repo"] = SQL["commits_by_repo"]
SQL["loaded_repos_by_tier"] = SQL["repos_by_tier"]
SQL["loaded_languages"] = LANGUAGES
SQL["load_duplicates"] = SQL["commits_normalised"]
SQL["accumulate_subset_tables"] = f"""
WITH lic AS ({LICENSES_PARTS}), r AS ({REPOS_PARTS}),
t AS (SELECT {_tier('watch_count')} AS tier, repo_name, watch_count FROM r)
SELECT 'license_counts' AS table_name, license AS key, CAST(2 * count(*) AS BIGINT) AS value FROM lic
  WHERE license IS NOT NULL AND license <> '' GROUP BY license
UNION ALL SELECT 'tier_counts', tier, CAST(count(*) AS BIGINT) FROM t GROUP BY tier
UNION ALL SELECT 'repos_by_tier', repo_name, watch_count FROM (SELECT DISTINCT tier, repo_name, watch_count FROM t)
UNION ALL SELECT 'repos', repo_name, watch_count FROM r"""
SQL["change_file_missing_seq"] = f"""WITH {COMMITS}, {MIXED.strip()}
SELECT seq, op, commit_hash, status FROM st
UNION ALL SELECT NULL, 'delete', CAST(o_orderkey AS VARCHAR), 'invalid' FROM orders
  WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
UNION ALL SELECT o_orderkey * 10 + 9, 'update', CAST(o_orderkey AS VARCHAR), 'invalid' FROM orders, range(2)
  WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'P'"""
SQL["hot_hash_changes"] = """
WITH ch AS (
  SELECT o_orderkey AS k, o_orderkey * 1000003 AS seq,
         CASE o_orderkey % 9 WHEN 0 THEN 'create' WHEN 6 THEN 'delete' ELSE 'update' END AS op FROM orders),
hot AS (
  SELECT *, coalesce(last_value(CASE op WHEN 'create' THEN true WHEN 'delete' THEN false END IGNORE NULLS)
    OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS there
  FROM ch WHERE k % 3 = 0)
SELECT seq, op, 'hot-1' AS commit_hash,
  CASE WHEN op = 'create' THEN CASE WHEN there THEN 'duplicate' ELSE 'created' END
       WHEN NOT there THEN 'not_found' WHEN op = 'delete' THEN 'deleted' ELSE 'updated' END AS status FROM hot
UNION ALL SELECT seq, 'update', CAST(k AS VARCHAR), 'updated' FROM ch WHERE k % 3 <> 0"""
SQL["commits_lenient_containers"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS commit_hash, o_orderpriority AS repo_name, 'unknown' AS author_name, '' AS author_email,
  'unknown' AS committer_name, 's' AS subject, '' AS message, '' AS tree, '' AS files_changed, CAST(0 AS BIGINT) AS num_files_changed
FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0"""
SQL["ndjson_trailing_text"] = """
WITH o AS (SELECT CASE WHEN c_custkey % 5 IN (2, 4) THEN 'accepted' ELSE 'malformed' END AS outcome FROM customer),
d AS (SELECT * FROM (VALUES ('accepted'), ('blank'), ('malformed'), ('missing_key')) AS t(outcome))
SELECT d.outcome, CAST(count(o.outcome) AS BIGINT) AS line_count FROM d LEFT JOIN o ON o.outcome = d.outcome GROUP BY d.outcome"""
SQL["repos_int_forms"] = """
SELECT c_name AS repo_name, CAST(CASE c_custkey % 8 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey * 100 WHEN 2 THEN 1
    WHEN 3 THEN c_custkey * 1000 WHEN 4 THEN 0 WHEN 7 THEN -c_custkey ELSE c_custkey END AS BIGINT) AS watch_count, CAST(length(c_name) AS BIGINT) AS name_length
FROM customer"""
# no order value: the greatest record
SQL["load_null_seq"] = SQL["commits_latest_by_hash"].replace(
    "ORDER BY seq DESC", "ORDER BY CASE WHEN seq % 7 = 0 THEN seq END DESC NULLS LAST, repo_name DESC, author_name DESC, subject DESC, message DESC, files_changed DESC")
SQL["accumulate_same_records"] = f"""
WITH r AS ({REPOS_DOCS})
SELECT 'repos' AS table_name, repo_name, CAST(watch_count AS VARCHAR) AS value FROM r
UNION ALL SELECT 'licenses', 'doc/' || CAST(doc_id AS VARCHAR), source FROM documents WHERE source IS NOT NULL AND source <> ''"""
SQL["change_touched_ranges"] = SQL["mixed_changes_snapshot"]
SQL["change_bucketed_snapshot"] = SQL["mixed_changes_snapshot"]
SQL["change_incremental_tables"] = f"""{_MIXED_FINAL}
SELECT 'author_counts' AS table_name, repo_name, author_name AS key, CAST(count(*) AS VARCHAR) AS value FROM final GROUP BY repo_name, author_name
UNION ALL SELECT 'commits_by_repo', repo_name, commit_hash, subject FROM final
UNION ALL SELECT DISTINCT 'repos_loaded', repo_name, NULL, NULL FROM final"""
SQL["top_contributors_maintained"] = f"""{_MIXED_FINAL},
c AS (SELECT repo_name, author_name, CAST(count(*) AS BIGINT) AS commit_count FROM final GROUP BY ALL)
SELECT repo_name, author_name, commit_count,
       CAST(row_number() OVER (PARTITION BY repo_name ORDER BY commit_count DESC, author_name ASC) AS BIGINT) AS rank
FROM c QUALIFY rank <= {S.TOP_CONTRIBUTORS}"""
SQL["lookup_in_ranges"] = f"""WITH {COMMITS}
SELECT {COMMIT_COLS} FROM commits WHERE commit_hash IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P')"""
SQL["search_author_indexed"] = SQL["search_author"]
SQL["most_watched_walk"] = SQL["most_watched_overall"]
SQL["longest_names_by_counts"] = SQL["longest_names"]
SQL["name_stats_after_changes"] = """
WITH r AS (SELECT length(url) AS n, 1 AS c FROM pages
  UNION ALL SELECT length(url), -1 FROM pages WHERE page_id % 4 = 1
  UNION ALL SELECT length(url) + 5, 1 FROM pages WHERE page_id % 5 = 2),
f AS (SELECT n, sum(c) AS c FROM r GROUP BY n HAVING sum(c) > 0)
SELECT CAST(sum(n * c) AS DOUBLE) / CAST(sum(c) AS DOUBLE) AS avg_length, CAST(min(n) AS BIGINT) AS min_length,
       CAST(max(n) AS BIGINT) AS max_length, CAST(sum(c) AS BIGINT) AS total FROM f HAVING sum(c) > 0"""
SQL["stream_all_tables"] = f"""WITH {_VERSIONS.strip()},
latest AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY commit_hash ORDER BY seq DESC) = 1),
by_repo AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY repo_name, commit_hash ORDER BY seq DESC) = 1)
SELECT 'author_counts' AS table_name, repo_name, author_name AS key, CAST(count(*) AS VARCHAR) AS value FROM v GROUP BY repo_name, author_name
UNION ALL SELECT 'commits', repo_name, commit_hash, author_name FROM latest
UNION ALL SELECT 'commits_by_repo', repo_name, commit_hash, author_name FROM by_repo
UNION ALL SELECT DISTINCT 'repos_loaded', repo_name, NULL, NULL FROM v"""
