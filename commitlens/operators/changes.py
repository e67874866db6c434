"""Change batches (create / update / delete by commit hash) applied to a
commit snapshot.

Parquet has no row-level DML, so a batch produces a *new* snapshot plus one
status row per change; callers write the snapshot to a new path. Within a
batch, changes to the same key follow ``seq`` order: the first create of an
absent key wins (``if_absent``) or the last one does (``upsert``); later
deletes of an already deleted key are ``not_found``; updates of the same
field keep the last value. A mixed batch (:func:`apply_sequential`) is
applied exactly as one change after another.

Per-key reductions are ``groupBy().agg(min/max_by)`` (partial aggregates), so
a key that holds a third of the batch is reduced map-side. The batch side is
always the right side of a left, semi or anti join with the snapshot, so Spark
can broadcast it when it is small and the snapshot stays where it is read;
existence is looked up for the batch's distinct keys, never for the whole
snapshot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens import schemas as S
from commitlens.functions import strict_long, truthy
from commitlens.session import stored

_WHITESPACE = " \t\r\n\x0b\x0c"


@dataclass
class ChangeResult:
    snapshot: DataFrame  # new commits snapshot, canonical schema
    status: DataFrame  # seq, op, commit_hash, status
    deltas: DataFrame  # repo_name, author_name, commit_count (+1 / -1 per record)


def _strip(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.btrim(col, F.lit(_WHITESPACE))


#: Most counted changes whose keys, and whose summaries (the records of the
#: batch), are broadcast to the snapshot; beyond it Spark decides by its
#: estimates, which derived tables inflate.
BROADCAST_KEYS, BROADCAST_SUMMARIES = 500_000, 20_000


def _small(df: DataFrame, n: int | None, most: int) -> DataFrame:
    return F.broadcast(df) if n is not None and n <= most else df


def _keys(base: DataFrame, batch: DataFrame, n: int | None = None) -> DataFrame:
    """Those keys of the batch (of ``n`` changes) that the snapshot has, with
    an existence flag (snapshot keys are unique)."""
    wanted = _small(batch.select("commit_hash").distinct(), n, BROADCAST_KEYS)
    own = base.select("commit_hash").join(wanted, "commit_hash", "left_semi")
    return own.withColumn("_exists", F.lit(True))


def _empty_deltas(base: DataFrame) -> DataFrame:
    return base.select("repo_name", "author_name", F.lit(0).cast("bigint").alias("commit_count")).limit(0)


def _new_record(c: DataFrame) -> DataFrame:
    """A created record: no email, committer = author, no tree, no files."""
    return c.select(
        "commit_hash",
        "repo_name",
        "author_name",
        F.lit(S.DEFAULT_TEXT).alias("author_email"),
        F.col("author_name").alias("committer_name"),
        F.coalesce("subject", F.lit(S.DEFAULT_TEXT)).alias("subject"),
        F.coalesce("message", F.lit(S.DEFAULT_TEXT)).alias("message"),
        F.lit(S.DEFAULT_TEXT).alias("tree"),
        F.array().cast("array<string>").alias("files_changed"),
        F.lit(0).cast("bigint").alias("num_files_changed"),
    )


def apply_creates(base: DataFrame, changes: DataFrame, mode: str = "if_absent") -> ChangeResult:
    """Create records. A create needs a non-blank hash, repo and author
    (after trimming), else ``invalid``. ``if_absent``: an existing key, or a
    key already created earlier in the batch, is a ``duplicate``.
    ``upsert``: every valid create is ``created`` and replaces the record;
    its author counter is bumped every time (the unconditional-write
    semantics), while a recomputed count sees only the final snapshot."""
    if mode not in ("if_absent", "upsert"):
        raise ValueError("mode must be 'if_absent' or 'upsert'")
    c = changes.where(F.col("op") == F.lit("create")).select(
        "seq",
        F.col("op"),
        _strip("commit_hash").alias("commit_hash"),
        _strip("repo_name").alias("repo_name"),
        _strip("author_name").alias("author_name"),
        "subject",
        "message",
    )
    valid = truthy("commit_hash") & truthy("repo_name") & truthy("author_name")
    c = c.withColumn("_valid", valid)
    good = c.where(F.col("_valid"))
    payload = F.struct("repo_name", "author_name", "subject", "message")

    if mode == "if_absent":
        firsts = good.groupBy("commit_hash").agg(
            F.min("seq").alias("_first_seq"), F.min_by(payload, F.col("seq")).alias("_rec")
        )
        known = firsts.join(_keys(base, firsts), "commit_hash", "left")
        flagged = c.join(known.select("commit_hash", "_first_seq", "_exists"), "commit_hash", "left")
        status = flagged.select(
            "seq",
            "op",
            "commit_hash",
            F.when(~F.col("_valid"), F.lit("invalid"))
            .when(F.col("_exists").isNotNull(), F.lit("duplicate"))
            .when(F.col("seq") == F.col("_first_seq"), F.lit("created"))
            .otherwise(F.lit("duplicate"))
            .alias("status"),
        )
        fresh = known.where(F.col("_exists").isNull())
        created = _new_record(fresh.select("commit_hash", "_rec.*"))
        snapshot = base.select(*S.COMMIT_COLUMNS).unionByName(created)
        deltas = created.groupBy("repo_name", "author_name").agg(
            F.count(F.lit(1)).cast("bigint").alias("commit_count")
        )
    else:
        lasts = good.groupBy("commit_hash").agg(F.max_by(payload, F.col("seq")).alias("_rec"))
        created = _new_record(lasts.select("commit_hash", "_rec.*"))
        kept = base.select(*S.COMMIT_COLUMNS).join(lasts.select("commit_hash"), "commit_hash", "left_anti")
        snapshot = kept.unionByName(created)
        status = c.select(
            "seq",
            "op",
            "commit_hash",
            F.when(F.col("_valid"), F.lit("created")).otherwise(F.lit("invalid")).alias("status"),
        )
        deltas = good.groupBy("repo_name", "author_name").agg(
            F.count(F.lit(1)).cast("bigint").alias("commit_count")
        )
    return ChangeResult(snapshot, status, deltas)


def update_status(field: Column, exists: Column, value: Column) -> Column:
    """Check order: field name, then existence, then the value."""
    allowed = field.isNotNull() & field.isin(S.UPDATABLE_FIELDS)
    needs_int = field.isin(S.INTEGER_FIELDS)
    return (
        F.when(~allowed, F.lit("invalid_field"))
        .when(exists.isNull(), F.lit("not_found"))
        .when(needs_int & strict_long(value).isNull(), F.lit("invalid_value"))
        .otherwise(F.lit("updated"))
    )


def apply_updates(base: DataFrame, changes: DataFrame) -> ChangeResult:
    """Set allow-listed fields of existing records. Status per change:
    ``invalid_field`` / ``not_found`` / ``invalid_value`` / ``updated``.
    Accepted updates are pivoted to one row per key (last value per field by
    ``seq``) and merged into the snapshot with one left join. Counters are
    not touched: derived tables are recomputed from the snapshot, so an
    author or repo change moves the counts consistently."""
    u = changes.where(F.col("op") == F.lit("update")).select(
        "seq", "op", _strip("commit_hash").alias("commit_hash"), "field", "value"
    )
    flagged = u.join(_keys(base, u), "commit_hash", "left")
    flagged = flagged.withColumn("status", update_status(F.col("field"), F.col("_exists"), F.col("value")))
    status = flagged.select("seq", "op", "commit_hash", "status")

    # Field and value checks need no snapshot; the existence check is the
    # left join below (updates of absent keys find no row), so the snapshot
    # is scanned once.
    ok = u.where(update_status(F.col("field"), F.lit(True), F.col("value")) == F.lit("updated"))
    aggs = []
    for f in S.UPDATABLE_FIELDS:
        is_f = F.col("field") == F.lit(f)
        aggs.append(F.max_by(F.when(is_f, F.col("value")), F.when(is_f, F.col("seq"))).alias(f"_new_{f}"))
        aggs.append(F.bool_or(is_f).alias(f"_set_{f}"))
    pivot = ok.groupBy("commit_hash").agg(*aggs)

    merged = base.select(*S.COMMIT_COLUMNS).join(pivot, "commit_hash", "left")
    out = []
    for name in S.COMMIT_COLUMNS:
        if name in S.UPDATABLE_FIELDS:
            new = F.col(f"_new_{name}")
            if name in S.INTEGER_FIELDS:
                new = strict_long(new)
            out.append(
                F.when(F.coalesce(F.col(f"_set_{name}"), F.lit(False)), new)
                .otherwise(F.col(name))
                .alias(name)
            )
        else:
            out.append(F.col(name))
    return ChangeResult(merged.select(*out), status, _empty_deltas(base))


def apply_deletes(base: DataFrame, changes: DataFrame) -> ChangeResult:
    """Delete records by key: ``deleted`` for the first delete of an
    existing key, ``not_found`` otherwise; the author counter gets -1 per
    deleted record."""
    d = changes.where(F.col("op") == F.lit("delete")).select(
        "seq", "op", _strip("commit_hash").alias("commit_hash")
    )
    firsts = d.groupBy("commit_hash").agg(F.min("seq").alias("_first_seq"))
    flagged = d.join(firsts.join(_keys(base, firsts), "commit_hash", "left"), "commit_hash", "left")
    status = flagged.select(
        "seq",
        "op",
        "commit_hash",
        F.when(F.col("_exists").isNotNull() & (F.col("seq") == F.col("_first_seq")), F.lit("deleted"))
        .otherwise(F.lit("not_found"))
        .alias("status"),
    )
    base = base.select(*S.COMMIT_COLUMNS)
    snapshot = base.join(firsts.select("commit_hash"), "commit_hash", "left_anti")
    removed = base.join(firsts.select("commit_hash"), "commit_hash", "left_semi")
    deltas = removed.groupBy("repo_name", "author_name").agg(
        (-F.count(F.lit(1))).cast("bigint").alias("commit_count")
    )
    return ChangeResult(snapshot, status, deltas)


def apply_changes(base: DataFrame, changes: DataFrame, create_mode: str = "if_absent") -> ChangeResult:
    """Apply a mixed batch in ``seq`` order (see :func:`apply_sequential`)."""
    return apply_sequential(base, changes, create_mode)


def merge_counter_deltas(
    counts: DataFrame, deltas: DataFrame, keys=("repo_name", "author_name"), value: str = "commit_count"
) -> DataFrame:
    """Add +/- deltas to counters. Members may reach zero or below and stay
    listed (filter with ``positive_only`` when reading). One partial + final
    aggregate over the union, no join."""
    keys = list(keys)
    both = counts.select(*keys, value).unionByName(deltas.select(*keys, value))
    return both.groupBy(*keys).agg(F.sum(value).cast("bigint").alias(value))


# ---------------------------------------------------------------------------
# Exact sequential semantics for mixed batches.
# ---------------------------------------------------------------------------
def _chunks(ops: DataFrame, chunk: int, n: int) -> Column:
    """The run of ``seq`` values a change falls into. Runs are cut at
    quantiles of the batch's own ``seq``, so each holds about ``chunk``
    changes however sparse the values are. One aggregate over the batch's
    ``seq``; the driver gets the cuts, a ten-thousandth of the batch or less."""
    parts = min(10_000, -(-n // chunk))
    if parts < 2:
        return F.lit(0)
    probabilities = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = sorted(set(ops.agg(F.percentile_approx("seq", probabilities, 10 * parts)).first()[0] or []))
    if not cuts:
        return F.lit(0)
    # how many cuts are below, by bisection in an array: one expression that
    # stays the same however many cuts there are (a branch per cut made code
    # that grew with the batch). Padded with a value that nothing exceeds.
    depth = len(cuts).bit_length()
    padded = [*cuts, *[2**63 - 1] * (2**depth - 1 - len(cuts))]
    values = F.split(F.lit(",".join(map(str, padded))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(2**i) for i in reversed(range(depth))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(values, at + step - F.lit(1)) < F.col("seq"), at + step).otherwise(at))


def _existence_before(ops: DataFrame, base: DataFrame, chunk: int, n: int) -> DataFrame:
    """For every change, whether its key exists just before it is applied.

    Only creates and deletes change existence: after a valid create the key
    exists (created or already there), after a delete it does not. So the
    existence before a change is the effect of the last create/delete before
    it, else whether the snapshot has the key. That "last before" is a prefix
    scan per key, done in two levels so no task ever holds a whole key: runs
    of about ``chunk`` changes summarise their last effect per key (partial
    aggregate), a window over one key's summaries carries the effect into
    each run, and a window over one (key, run) resolves each change. The
    snapshot is asked once per key, at the summaries."""
    from pyspark.sql import Window

    effect = F.when(F.col("_sets"), F.col("_effect"))
    tagged = ops.withColumn("_chunk", _chunks(ops, chunk, n))
    # every (key, run) holding a change gets a summary row (NULL when the
    # run has no create/delete) so each change finds its run's entry
    summary = tagged.groupBy("commit_hash", "_chunk").agg(
        F.max_by(F.col("_effect"), F.when(F.col("_sets"), F.col("seq"))).alias("_chunk_last")
    )
    carried = summary.withColumn(
        "_entering",
        F.last("_chunk_last", ignorenulls=True).over(
            Window.partitionBy("commit_hash").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        ),
    ).join(_keys(base, ops, n), "commit_hash", "left").select(
        "commit_hash", "_chunk", "_entering", F.col("_exists").isNotNull().alias("_existed"))
    within = Window.partitionBy("commit_hash", "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    resolved = tagged.withColumn("_prev_in_chunk", F.last(effect, ignorenulls=True).over(within)).join(
        carried, ["commit_hash", "_chunk"], "left")
    existed = F.coalesce(F.col("_existed"), F.lit(False))
    before = F.coalesce(F.col("_prev_in_chunk"), F.col("_entering"), existed)
    return resolved.withColumn("_exists_before", before).withColumn("_existed", existed).drop("_prev_in_chunk", "_entering", "_chunk")


def sequence_changes(
    base: DataFrame, changes: DataFrame, create_mode: str = "if_absent", chunk: int = 1 << 16, n: int | None = None
) -> DataFrame:
    """Every change of a mixed batch with its status, as if the changes were
    applied one after another in ``seq`` order. A change without ``seq``, or
    whose ``seq`` another change has too, has no place in that order: it is
    ``invalid`` and not applied. The result keeps what
    :func:`finalize_sequence` needs (the change fields and the ``_sets`` /
    ``_effect`` / ``_existed`` flags), so it can be written once and finished
    from storage. The changes are read several times: a batch that is costly
    to derive is written first (:func:`commitlens.session.stored`)."""
    if create_mode not in ("if_absent", "upsert"):
        raise ValueError("create_mode must be 'if_absent' or 'upsert'")
    ch = changes.select(
        "seq",
        "op",
        _strip("commit_hash").alias("commit_hash"),
        "field",
        "value",
        _strip("repo_name").alias("repo_name"),
        _strip("author_name").alias("author_name"),
        "subject",
        "message",
    )
    is_create, is_delete, is_update = (F.col("op") == F.lit(x) for x in ("create", "delete", "update"))
    valid_create = is_create & truthy("repo_name") & truthy("author_name") & truthy("commit_hash")
    repeated = changes.where("seq IS NOT NULL").groupBy("seq").agg(F.count("*").alias("_n")).where("_n > 1").select("seq", F.lit(True).alias("_repeated"))
    shared = repeated.count()  # counted first: the changes are shuffled by seq only if too many share one
    placed = F.col("seq").isNotNull()
    if shared:
        ch = ch.join(_small(repeated, shared, BROADCAST_KEYS), "seq", "left")
        placed = placed & F.col("_repeated").isNull()
    ch = ch.withColumn("_placed", placed).drop("_repeated")
    ops = ch.withColumn("_sets", F.col("_placed") & F.coalesce(valid_create | is_delete, F.lit(False))).withColumn(
        "_effect", valid_create
    )
    ops = _existence_before(ops, base, chunk, changes.count() if n is None else n)
    before = F.col("_exists_before")
    status = (
        F.when(~F.col("_placed") | (is_create & ~valid_create), F.lit("invalid"))
        .when(is_create & before & F.lit(create_mode == "if_absent"), F.lit("duplicate"))
        .when(is_create, F.lit("created"))
        .when(is_delete & before, F.lit("deleted"))
        .when(is_delete, F.lit("not_found"))
        .when(is_update, update_status(F.col("field"), F.when(before, F.lit(True)), F.col("value")))
        .otherwise(F.lit("invalid_op"))
    )
    return ops.withColumn("status", status).drop("_exists_before", "_placed")


def finalize_sequence(base: DataFrame, ops: DataFrame, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The new snapshot and the exact counter deltas of a sequenced batch
    (the output of :func:`sequence_changes`, ``n`` its counted changes)."""
    # One pass per key: final existence (last create/delete), the anchor
    # (last successful create, or a successful delete, which clears the
    # record) and per field the last successful update. An update survives
    # into the final record only if it comes after the anchor, and the last
    # update of a field decides that for the field, so no second pass over
    # the changes is needed.
    reset = F.col("status").isin("created", "deleted")
    payload = F.struct(
        F.col("seq").alias("seq"),
        (F.col("status") == F.lit("created")).alias("is_create"),
        "repo_name", "author_name", "subject", "message",
    )
    aggs = [
        F.bool_or("_existed").alias("_existed"),
        F.max_by(F.col("_effect"), F.when(F.col("_sets"), F.col("seq"))).alias("_final_effect"),
        F.max_by(F.when(reset, payload), F.when(reset, F.col("seq"))).alias("_anchor"),
    ]
    for f in S.UPDATABLE_FIELDS:
        upd_f = (F.col("status") == F.lit("updated")) & (F.col("field") == F.lit(f))
        aggs.append(F.max_by(F.when(upd_f, F.col("value")), F.when(upd_f, F.col("seq"))).alias(f"_new_{f}"))
        aggs.append(F.max(F.when(upd_f, F.col("seq"))).alias(f"_seq_{f}"))
    # a change without a hash changes nothing. Both sides below use the same
    # columns of the same rows, so that Spark shuffles the summary once
    summary = ops.where("commit_hash IS NOT NULL").groupBy("commit_hash").agg(*aggs)
    after_anchor = {
        f: F.col(f"_seq_{f}").isNotNull()
        & (F.col("_anchor").isNull() | (F.col(f"_seq_{f}") > F.col("_anchor.seq")))
        for f in S.UPDATABLE_FIELDS
    }

    old = base.select(*[F.col(c).alias(f"_old_{c}") for c in S.COMMIT_COLUMNS])
    # The snapshot with the summary of the keys it has, and the created keys it
    # has not: the summary can be broadcast, and only it is filtered twice.
    same = old["_old_commit_hash"] == summary["commit_hash"]
    absent = [F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns]
    created = summary.where(~F.col("_existed")).select(*absent, *summary.columns)
    joined = old.join(_small(summary, n, BROADCAST_SUMMARIES), same, "left").unionByName(created)
    key = F.coalesce(F.col("_old_commit_hash"), F.col("commit_hash"))
    anchored_new = F.coalesce(F.col("_anchor.is_create"), F.lit(False))
    exists_final = F.coalesce(F.col("_final_effect"), F.col("_existed"), F.col("_old_commit_hash").isNotNull())

    def start(name: str) -> Column:
        """Value before the trailing updates: the created record or the old one."""
        new_vals = {
            "commit_hash": key,
            "repo_name": F.col("_anchor.repo_name"),
            "author_name": F.col("_anchor.author_name"),
            "author_email": F.lit(S.DEFAULT_TEXT),
            "committer_name": F.col("_anchor.author_name"),
            "subject": F.coalesce(F.col("_anchor.subject"), F.lit(S.DEFAULT_TEXT)),
            "message": F.coalesce(F.col("_anchor.message"), F.lit(S.DEFAULT_TEXT)),
            "tree": F.lit(S.DEFAULT_TEXT),
            "files_changed": F.array().cast("array<string>"),
            "num_files_changed": F.lit(0).cast("bigint"),
        }
        return F.when(anchored_new, new_vals[name]).otherwise(F.col(f"_old_{name}"))

    cols = []
    for name in S.COMMIT_COLUMNS:
        v = start(name)
        if name in S.UPDATABLE_FIELDS:
            new = F.col(f"_new_{name}")
            if name in S.INTEGER_FIELDS:
                new = strict_long(new)
            v = F.when(F.coalesce(after_anchor[name], F.lit(False)), new).otherwise(v)
        cols.append(v.alias(name))
    final = joined.where(exists_final).select(*cols)

    touched = old.join(_small(summary, n, BROADCAST_SUMMARIES), same).unionByName(created)
    before_row = F.when(
        F.col("_old_commit_hash").isNotNull(),
        F.struct(F.col("_old_repo_name").alias("repo_name"), F.col("_old_author_name").alias("author_name"),
                 F.lit(-1).cast("bigint").alias("commit_count")),
    )
    after_cols = {c: v for c, v in zip(S.COMMIT_COLUMNS, cols)}
    after_row = F.when(
        exists_final,
        F.struct(after_cols["repo_name"].alias("repo_name"), after_cols["author_name"].alias("author_name"),
                 F.lit(1).cast("bigint").alias("commit_count")),
    )
    moves = touched.select(F.explode(F.filter(F.array(before_row, after_row), lambda x: x.isNotNull())).alias("m"))
    deltas = (
        moves.select("m.*")
        .groupBy("repo_name", "author_name")
        .agg(F.sum("commit_count").cast("bigint").alias("commit_count"))
        .where(F.col("commit_count") != F.lit(0))
    )
    return final, deltas


def apply_sequential(
    base: DataFrame, changes: DataFrame, create_mode: str = "if_absent", chunk: int = 1 << 16
) -> ChangeResult:
    """Apply a mixed batch of creates, updates and deletes exactly as if one
    change after another in ``seq`` order (changes that have no place in it
    are ``invalid``).

    Statuses follow the single-change rules against the state at that point.
    The final record of a key is the last record set by a successful create
    (or the snapshot's record when none), with the successful updates that
    follow it; a key whose last create/delete is a delete is gone. ``deltas``
    are exact counter changes (the final snapshot's counts minus the
    original's), so merged counters always equal recomputed ones. The batch
    is written once to the work folder; every step reads it from there."""
    changes = stored(changes, "changes")
    n = changes.count()
    ops = sequence_changes(base, changes, create_mode, chunk, n)
    snapshot, deltas = finalize_sequence(base, ops, n)
    return ChangeResult(snapshot, ops.select("seq", "op", "commit_hash", "status"), deltas)
