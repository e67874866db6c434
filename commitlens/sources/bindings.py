"""Reference-shaped records derived from the driver's parquet tables.

The original inputs (commit, repo, license and language NDJSON files) are not
available, so each record kind is derived from a driver table by Spark. All
derivations are per-row projections or per-key aggregates whose work grows
with the tables; none reads a fixed or made-up input.

Where a binding derives a value that must reappear in the DuckDB oracle SQL,
the same rule is written there independently (see ``plans/oracle.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table."""
    return table(spark, sf_dir, name).select(*cols)


# ---------------------------------------------------------------------------
# Commits: orders are commits, the order priority is the repository, the
# customer is the author and the order's line items are the changed files.
# ---------------------------------------------------------------------------
def _changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: the line count and the (line number, path) entries.

    A line with return flag N stands for a change without a new path. The
    entries array is one record's changed-file list, so its size is that of a
    single input record; consumers that need only the count never build it
    (Catalyst prunes the unused collect_list out of the aggregate)."""
    li = scan(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_partkey").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == F.lit("N"), F.lit(""))
        .otherwise(F.concat(F.lit("f/"), F.col("l_partkey").cast("string")))
        .alias("new_path"),
    )
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_lines"),
        F.sort_array(F.collect_list(F.struct("l_linenumber", "new_path"))).alias("entries"),
    )


def _commit_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and files. The customer comes first: once
    customers are too many to broadcast, that join shuffles the narrow orders
    and not the file lists."""
    orders = scan(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    files = _changed_files(spark, sf_dir)
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(
        files, orders.o_orderkey == files.l_orderkey, "left"
    )


def raw_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit records in the NDJSON shape (nested author/committer, a
    ``difference`` array of ``{new_path}``). Pending orders have no author
    object, household customers no committer, finished orders no message."""
    b = _commit_base(spark, sf_dir)
    return b.select(
        F.col("o_orderkey").cast("string").alias("commit"),
        F.col("o_orderpriority").alias("repo_name"),
        F.when(F.col("o_orderstatus") == F.lit("P"), F.lit(None))
        .otherwise(
            F.struct(
                F.col("c_name").alias("name"),
                F.concat(F.lower("c_mktsegment"), F.lit("@example.com")).alias("email"),
            )
        )
        .alias("author"),
        F.when(F.col("c_mktsegment") == F.lit("HOUSEHOLD"), F.lit(None))
        .otherwise(F.struct(F.col("c_name").alias("name")))
        .alias("committer"),
        F.transform("entries", lambda e: F.struct(e["new_path"].alias("new_path"))).alias(
            "difference"
        ),
        F.concat(
            F.lit("Update order "), F.col("o_orderkey").cast("string"),
            F.lit(" ("), F.col("o_orderstatus"), F.lit(")"),
        ).alias("subject"),
        F.when(F.col("o_orderstatus") == F.lit("F"), F.lit(None))
        .otherwise(F.concat(F.lit("customer "), F.col("o_custkey").cast("string")))
        .alias("message"),
        F.concat(F.lit("tree-"), F.col("o_orderkey").cast("string")).alias("tree"),
    )


def commits_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical ``commits`` table of :func:`raw_commits`, built straight
    from the tables: ``num_files_changed`` is a per-order count, so queries
    that do not read ``files_changed`` never assemble the per-record arrays.
    Equal to ``normalise_commits(raw_commits(...))`` (asserted in tests)."""
    b = _commit_base(spark, sf_dir)
    paths = F.filter(
        F.transform(F.coalesce(F.col("entries"), F.array()), lambda e: e["new_path"]),
        lambda p: p != F.lit(""),
    )
    pending = F.col("o_orderstatus") == F.lit("P")
    household = F.col("c_mktsegment") == F.lit("HOUSEHOLD")
    return b.select(
        F.col("o_orderkey").cast("string").alias("commit_hash"),
        F.col("o_orderpriority").alias("repo_name"),
        F.when(pending, F.lit("unknown")).otherwise(F.coalesce("c_name", F.lit("unknown"))).alias(
            "author_name"
        ),
        F.when(pending, F.lit(""))
        .otherwise(F.coalesce(F.concat(F.lower("c_mktsegment"), F.lit("@example.com")), F.lit("")))
        .alias("author_email"),
        F.when(household, F.lit("unknown"))
        .otherwise(F.coalesce("c_name", F.lit("unknown")))
        .alias("committer_name"),
        F.concat(
            F.lit("Update order "), F.col("o_orderkey").cast("string"),
            F.lit(" ("), F.col("o_orderstatus"), F.lit(")"),
        ).alias("subject"),
        F.when(F.col("o_orderstatus") == F.lit("F"), F.lit(""))
        .otherwise(F.concat(F.lit("customer "), F.col("o_custkey").cast("string")))
        .alias("message"),
        F.concat(F.lit("tree-"), F.col("o_orderkey").cast("string")).alias("tree"),
        paths.alias("files_changed"),
        F.coalesce(F.col("n_lines"), F.lit(0)).cast("bigint").alias("num_files_changed"),
    )


def commit_versions(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """Commit records where a hash repeats: one version per line item, keyed
    by (part, supplier), ordered by ``seq`` = (order key, line number, line
    status, return flag) packed into one integer. Line items that tie on all
    four yield identical records, so last-write-wins is deterministic."""
    li = scan(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
              "l_returnflag", "l_linestatus")
    line = F.col("l_orderkey") * F.lit(100) + F.col("l_linenumber")
    status = F.when(F.col("l_linestatus") == F.lit("O"), F.lit(1)).otherwise(F.lit(0))
    flag = (
        F.when(F.col("l_returnflag") == F.lit("A"), F.lit(0))
        .when(F.col("l_returnflag") == F.lit("N"), F.lit(1))
        .when(F.col("l_returnflag") == F.lit("R"), F.lit(2))
        .otherwise(F.lit(3))
    )
    li = li.withColumn("seq", ((line * F.lit(2) + status) * F.lit(4) + flag).cast("bigint"))
    if in_order:
        li = li.repartitionByRange("seq").sortWithinPartitions("seq")
    return li.select(
        "seq",
        F.concat(
            F.lit("p"), F.col("l_partkey").cast("string"), F.lit("-s"), F.col("l_suppkey").cast("string")
        ).alias("commit"),
        F.concat(F.lit("flag-"), F.col("l_returnflag")).alias("repo_name"),
        F.struct(
            F.concat(F.lit("Supplier#"), F.col("l_suppkey").cast("string")).alias("name"),
            F.lit(None).cast("string").alias("email"),
        ).alias("author"),
        F.lit(None).cast("struct<name:string>").alias("committer"),
        F.array(
            F.struct(F.concat(F.lit("o/"), F.col("l_orderkey").cast("string")).alias("new_path"))
        ).alias("difference"),
        F.concat(
            F.lit("line "), F.col("l_linenumber").cast("string"),
            F.lit(" of order "), F.col("l_orderkey").cast("string"),
        ).alias("subject"),
        F.col("l_linestatus").alias("message"),
        F.lit(None).cast("string").alias("tree"),
    )


# ---------------------------------------------------------------------------
# Repositories (name, watch_count as text).
# ---------------------------------------------------------------------------
def raw_repos_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: name and truncated account balance (negatives included)."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_name").alias("repo_name"),
        F.col("c_acctbal").cast("bigint").cast("string").alias("watch_count"),
    )


def raw_repos_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: ``source/doc_id`` with the character count."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("repo_name"),
        F.col("n_chars").cast("string").alias("watch_count"),
    )


def raw_repos_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their total spend (sum of floored order prices); a
    customer without orders has no watch_count. The per-customer sum is a
    partial aggregate, so a customer with a third of all orders is combined
    map-side before the shuffle."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    spend = o.groupBy("o_custkey").agg(
        F.sum(F.floor("o_totalprice").cast("bigint")).alias("spend")
    )
    j = c.join(spend, c.c_custkey == spend.o_custkey, "left")
    return j.select(
        F.col("c_name").alias("repo_name"), F.col("spend").cast("string").alias("watch_count")
    )


def raw_repos_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts: few distinct names and sizes, so duplicates and heavy ties."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_name").alias("repo_name"), F.col("p_size").cast("string").alias("watch_count")
    )


def repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs as repository names (for name-length statistics)."""
    return table(spark, sf_dir, "pages").select(
        F.col("url").alias("repo_name"), F.lit(None).cast("string").alias("watch_count")
    )


def repo_url_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories that go (``sign`` -1: every fourth page's URL) and come (+1: a
    longer URL of every fifth page)."""
    p = table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string").alias("watch_count")
    gone = p.where(F.col("page_id") % 4 == 1).select(F.col("url").alias("repo_name"), none, F.lit(-1).alias("sign"))
    new = p.where(F.col("page_id") % 5 == 2).select(F.concat("url", F.lit("/tree")).alias("repo_name"), none, F.lit(1).alias("sign"))
    return gone.unionByName(new)


# ---------------------------------------------------------------------------
# Licenses and languages.
# ---------------------------------------------------------------------------
def raw_licenses_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts: the brand is the license. Sizes 1-2 carry no license, 3-4 an
    empty one, and size 50 has no repo name (counted, but not a row)."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.when(size == F.lit(50), F.lit(None)).otherwise(F.col("p_name")).alias("repo_name"),
        F.when(size <= F.lit(2), F.lit(None))
        .when(size <= F.lit(4), F.lit(""))
        .otherwise(F.col("p_brand"))
        .alias("license"),
    )


def raw_licenses_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the source is the license (an exact many-way tie)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("repo_name"),
        F.col("source").alias("license"),
    )


def raw_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One language record per document, built per row (no grouping): the
    document language with its character count, plus a second entry that is
    nameless for English, has unparsable bytes for German and the document id
    as bytes otherwise. Short Spanish documents have no language array."""
    d = table(spark, sf_dir, "documents")
    lang = F.col("lang")
    first = F.struct(lang.alias("name"), F.col("n_chars").cast("string").alias("bytes"))
    second = F.struct(
        F.when(lang == F.lit("en"), F.lit("")).otherwise(F.upper(lang)).alias("name"),
        F.when(lang == F.lit("de"), F.lit("n/a"))
        .otherwise(F.col("doc_id").cast("string"))
        .alias("bytes"),
    )
    return d.select(
        F.col("source").alias("repo_name"),
        F.when((lang == F.lit("es")) & (F.col("n_chars") < F.lit(1000)), F.lit(None))
        .otherwise(F.array(first, second))
        .alias("language"),
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit-subject text: every document text."""
    return scan(spark, sf_dir, "documents", "text").select(F.col("text").alias("subject"))


def conversation_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "conversations", "text").select(F.col("text").alias("subject"))



# ---------------------------------------------------------------------------
# Text lines (NDJSON) rendered by Spark from the tables, with rejects mixed in.
# ---------------------------------------------------------------------------
def repo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repo NDJSON lines from customers. Automobile customers yield a
    truncated (malformed) line, building customers a blank line, furniture
    customers of nations 0-4 a line without ``repo_name``; machinery
    customers of nations 0-9 carry a non-integer watch count (``"<n>.5"``)."""
    c = table(spark, sf_dir, "customer")
    seg, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    count_text = F.col("c_acctbal").cast("bigint").cast("string")
    watch = F.when((seg == F.lit("MACHINERY")) & (nation < F.lit(10)), F.concat(count_text, F.lit(".5"))).otherwise(
        count_text
    )
    full = F.to_json(F.struct(F.col("c_name").alias("repo_name"), watch.alias("watch_count")))
    keyless = F.to_json(F.struct(watch.alias("watch_count")))
    line = (
        F.when(seg == F.lit("AUTOMOBILE"), F.substr(full, F.lit(1), F.length(full) - F.lit(2)))
        .when(seg == F.lit("BUILDING"), F.lit("  "))
        .when((seg == F.lit("FURNITURE")) & (nation < F.lit(5)), keyless)
        .otherwise(full)
    )
    return c.select(line.alias("value"))


def commit_lines(spark: SparkSession, sf_dir: str, explicit_nulls: bool = False) -> DataFrame:
    """Commit NDJSON lines: every raw commit record rendered with to_json.
    By default a NULL field is an omitted key; ``explicit_nulls=True`` writes
    it as a JSON null instead."""
    raw = raw_commits(spark, sf_dir)
    opts = {"ignoreNullFields": "false"} if explicit_nulls else {}
    return raw.select(F.to_json(F.struct(*raw.columns), opts).alias("value"))


# ---------------------------------------------------------------------------
# Change batches (seq, op, commit_hash, field, value, repo_name, author_name,
# subject, message) derived from orders.
# ---------------------------------------------------------------------------
def _changes_from(o: DataFrame, specs: list[tuple]) -> DataFrame:
    """Changes generated from one scan of ``o``: each spec is
    ``(condition, seq, op, key, field, value, repo, author, subject)``; a row
    emits one change per spec whose condition holds (explode of a filtered
    array, no union of scans)."""
    none = F.lit(None).cast("string")

    def change(seq, op, key, field, value, repo, author, subject):
        return F.struct(
            seq.cast("bigint").alias("seq"),
            F.lit(op).alias("op"),
            key.alias("commit_hash"),
            (field if field is not None else none).alias("field"),
            (value if value is not None else none).alias("value"),
            (repo if repo is not None else none).alias("repo_name"),
            (author if author is not None else none).alias("author_name"),
            (subject if subject is not None else none).alias("subject"),
            none.alias("message"),
        )

    items = [F.when(cond, change(*rest)) for cond, *rest in specs]
    emitted = F.filter(F.array(*items), lambda c: c.isNotNull())
    return o.select(F.inline(emitted))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def create_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creates: urgent open orders re-create existing hashes; low-priority
    orders create new hashes (blank author when pending); finished
    low-priority orders create their new hash twice."""
    o = _orders(spark, sf_dir)
    key, prio, st = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    k = key.cast("string")
    new_key = F.concat(F.lit("new-"), k)
    author = F.concat(F.lit("Author#"), F.col("o_custkey").cast("string"))
    low = prio == F.lit("5-LOW")
    return _changes_from(o, [
        ((prio == F.lit("1-URGENT")) & (st == F.lit("O")), key * 10 + 1, "create", k, None, None,
         prio, author, F.concat(F.lit("Recreate "), k)),
        (low, key * 10 + 2, "create", new_key, None, None,
         prio, F.when(st == F.lit("P"), F.lit("   ")).otherwise(author), F.concat(F.lit("Create "), k)),
        (low & (st == F.lit("F")), key * 10 + 7, "create", new_key, None, None,
         prio, F.lit("Second Author"), F.concat(F.lit("Create again "), k)),
    ])


def update_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates covering every status: valid subject edits (two per key, the
    later wins), valid and invalid integer values, a disallowed field,
    missing keys with a valid and with a disallowed field, and author
    renames that all map to one author (a hot key)."""
    o = _orders(spark, sf_dir)
    key, prio, st = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    k = key.cast("string")
    missing = F.concat(F.lit("missing-"), k)
    lit = F.lit

    def at(p, s_):
        return (prio == lit(p)) & (st == lit(s_))

    return _changes_from(o, [
        (at("2-HIGH", "O"), key * 10 + 1, "update", k, lit("subject"), F.concat(lit("edited "), k), None, None, None),
        (at("2-HIGH", "O"), key * 10 + 2, "update", k, lit("subject"), F.concat(lit("edited twice "), k),
         None, None, None),
        (at("3-MEDIUM", "F"), key * 10 + 3, "update", k, lit("num_files_changed"), lit("7"), None, None, None),
        (at("3-MEDIUM", "O"), key * 10 + 4, "update", k, lit("num_files_changed"), lit("seven"), None, None, None),
        (at("4-NOT SPECIFIED", "P"), key * 10 + 5, "update", k, lit("commit_hash"), lit("x"), None, None, None),
        (at("5-LOW", "P"), key * 10 + 6, "update", missing, lit("subject"), lit("nobody"), None, None, None),
        (at("5-LOW", "F"), key * 10 + 7, "update", missing, lit("bogus"), lit("1"), None, None, None),
        (at("1-URGENT", "F"), key * 10 + 8, "update", k, lit("author_name"), lit("Renamed Author"), None, None, None),
    ])


def delete_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes: finished not-specified orders (each twice, the second is
    not_found) and missing keys for pending urgent orders."""
    o = _orders(spark, sf_dir)
    key, prio, st = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    k = key.cast("string")
    doomed = (prio == F.lit("4-NOT SPECIFIED")) & (st == F.lit("F"))
    return _changes_from(o, [
        (doomed, key * 10 + 1, "delete", k, None, None, None, None, None),
        (doomed, key * 10 + 2, "delete", k, None, None, None, None, None),
        ((prio == F.lit("1-URGENT")) & (st == F.lit("P")), key * 10 + 3, "delete", F.concat(F.lit("missing-"), k),
         None, None, None, None, None),
    ])


def lookup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key batch: hashes of pending orders plus absent hashes for low
    priority orders."""
    o = _orders(spark, sf_dir)
    present = o.where(F.col("o_orderstatus") == F.lit("P")).select(
        F.col("o_orderkey").cast("string").alias("commit_hash")
    )
    absent = o.where(F.col("o_orderpriority") == F.lit("5-LOW")).select(
        F.concat(F.lit("absent-"), F.col("o_orderkey").cast("string")).alias("commit_hash")
    )
    return present.unionByName(absent)


def purge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes of every commit of the medium-priority repository."""
    o = _orders(spark, sf_dir)
    key = F.col("o_orderkey")
    return _changes_from(o, [
        (F.col("o_orderpriority") == F.lit("3-MEDIUM"), key * 10 + 1, "delete", key.cast("string"),
         None, None, None, None, None),
    ])


def mixed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixed batch where one key sees several changes in order:
    urgent open orders are deleted, re-created and edited; high finished
    orders are edited then deleted; medium open orders get a new key that is
    created, edited, deleted, edited again (missing) and created again;
    pending not-specified orders get a duplicate create, a bad integer, a
    valid edit and a delete of a missing key; low finished orders get a
    disallowed field and a create with a blank author."""
    o = _orders(spark, sf_dir)
    key, prio, st, cust = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey")
    k = key.cast("string")
    mix = F.concat(F.lit("mix-"), k)
    urgent = (prio == F.lit("1-URGENT")) & (st == F.lit("O"))
    high = (prio == F.lit("2-HIGH")) & (st == F.lit("F"))
    medium = (prio == F.lit("3-MEDIUM")) & (st == F.lit("O"))
    pending = (prio == F.lit("4-NOT SPECIFIED")) & (st == F.lit("P"))
    low = (prio == F.lit("5-LOW")) & (st == F.lit("F"))
    lit = F.lit
    return _changes_from(o, [
        (urgent, key * 10 + 1, "delete", k, None, None, None, None, None),
        (urgent, key * 10 + 2, "create", k, None, None, prio,
         F.concat(lit("Author#"), cust.cast("string")), F.concat(lit("Recreated "), k)),
        (urgent, key * 10 + 3, "update", k, lit("subject"), F.concat(lit("after "), k), None, None, None),
        (high, key * 10 + 1, "update", k, lit("author_name"), lit("Temp"), None, None, None),
        (high, key * 10 + 2, "delete", k, None, None, None, None, None),
        (medium, key * 10 + 1, "create", mix, None, None, prio, F.concat(lit("New#"), cust.cast("string")), lit("new")),
        (medium, key * 10 + 2, "update", mix, lit("subject"), lit("edited"), None, None, None),
        (medium, key * 10 + 3, "delete", mix, None, None, None, None, None),
        (medium, key * 10 + 4, "update", mix, lit("tree"), lit("T"), None, None, None),
        (medium, key * 10 + 5, "create", mix, None, None, prio, F.concat(lit("Again#"), cust.cast("string")),
         lit("again")),
        (pending, key * 10 + 1, "create", k, None, None, prio, lit("Dup"), lit("dup")),
        (pending, key * 10 + 2, "update", k, lit("num_files_changed"), lit("x"), None, None, None),
        (pending, key * 10 + 3, "update", k, lit("tree"), lit("T"), None, None, None),
        (pending, key * 10 + 4, "delete", F.concat(lit("gone-"), k), None, None, None, None, None),
        (low, key * 10 + 1, "update", k, lit("bogus"), lit("1"), None, None, None),
        (low, key * 10 + 2, "create", F.concat(lit("blank-"), k), None, None, prio, lit("  "), lit("blank")),
    ])


def changes_without_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that have no place in a batch: deletes of urgent finished
    orders without ``seq``, and two updates of each high pending order that
    share one."""
    o = _orders(spark, sf_dir)
    key, prio, st = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    k, shared = key.cast("string"), (prio == F.lit("2-HIGH")) & (st == F.lit("P"))
    return _changes_from(o, [
        ((prio == F.lit("1-URGENT")) & (st == F.lit("F")), F.lit(None), "delete", k, None, None, None, None, None),
        (shared, key * 10 + 9, "update", k, F.lit("subject"), F.lit("one"), None, None, None),
        (shared, key * 10 + 9, "update", k, F.lit("subject"), F.lit("other"), None, None, None),
    ])


def hot_key_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change per order, ``seq`` far apart; every third one creates,
    updates or deletes the same hash, the others update their own."""
    o = _orders(spark, sf_dir)
    key = F.col("o_orderkey")
    k, hot, seq = key.cast("string"), F.lit("hot-1"), key * 1_000_003
    turn = key % 9
    return _changes_from(o, [
        (turn == 0, seq, "create", hot, None, None, F.lit("r"), F.lit("A"), k),
        (turn == 3, seq, "update", hot, F.lit("subject"), k, None, None, None),
        (turn == 6, seq, "delete", hot, None, None, None, None, None),
        (key % 3 != 0, seq, "update", k, F.lit("subject"), F.lit("s"), None, None, None),
    ])


def lenient_commit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit lines whose author, committer and changed files hold a false
    value of some type by the order key; every seventh holds text there
    (malformed), every eleventh has a false number as its key."""
    o = _orders(spark, sf_dir)
    key = F.col("o_orderkey")
    false = F.element_at(F.array(*[F.lit(x) for x in ('""', "[]", "{}", "false", "0", "null")]), (key % 6 + 1).cast("int"))
    box = F.when(key % 7 == 0, F.lit('"oops"')).otherwise(false)
    own = F.when(key % 11 == 0, F.lit("0")).otherwise(F.concat(F.lit('"'), key.cast("string"), F.lit('"')))
    line = F.concat(F.lit('{"commit":'), own, F.lit(',"repo_name":"'), F.col("o_orderpriority"), F.lit('","author":'), box,
                    F.lit(',"committer":'), box, F.lit(',"difference":'), box, F.lit(',"subject":"s"}'))
    return o.select(line.alias("value"))


def trailing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repo lines with something after the object, by the customer key: text,
    another object, spaces (fine), an array end and a new array, or nothing."""
    full = F.to_json(F.struct(F.col("c_name").alias("repo_name")))
    turn = F.col("c_custkey") % 5
    line = (F.when(turn == 0, F.concat(full, F.lit(" trailing"))).when(turn == 1, F.concat(full, full)).when(turn == 2, F.concat(full, F.lit("  ")))
            .when(turn == 3, F.concat(full, F.lit("],["), full)).otherwise(full))
    return table(spark, sf_dir, "customer").select(line.alias("value"))


def int_form_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repo lines whose watch count is a JSON fraction (also one that rounding
    would carry over), exponent, boolean, grouped or padded string, by the
    customer key."""
    k = F.col("c_custkey").cast("string")
    turn = F.col("c_custkey") % 8
    count = (F.when(turn == 0, F.concat(k, F.lit(".9"))).when(turn == 1, F.concat(k, F.lit("e2"))).when(turn == 2, F.lit("true"))
             .when(turn == 3, F.concat(F.lit('"'), k, F.lit('_000"'))).when(turn == 4, F.lit("false")).when(turn == 5, F.concat(F.lit('" '), k, F.lit(' "')))
             .when(turn == 6, F.concat(k, F.lit(".99999999"))).otherwise(F.concat(F.lit("-"), k, F.lit(".9999999"))))
    line = F.concat(F.lit('{"repo_name":"'), F.col("c_name"), F.lit('","watch_count":'), count, F.lit("}"))
    return table(spark, sf_dir, "customer").select(line.alias("value"))
