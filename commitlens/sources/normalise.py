"""Raw records to canonical tables. Each function is DataFrame -> DataFrame,
uses native expressions only, and never shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens import schemas as S
from commitlens.functions import (
    array_length,
    code_point_length,
    default_if_null,
    lenient_long,
    new_paths,
    truthy,
)


def _keep(df: DataFrame, extra: list[str] | None) -> list[str]:
    return [c for c in (extra or []) if c in df.columns]


#: Keys whose explicit null is told from an absent key: (object, key).
_NULLABLE = [("author", "name"), ("author", "email"), ("committer", "name"), (None, "subject"), (None, "message"), (None, "tree")]


def _presence(line: Column) -> Column:
    """Which of the keys the line's JSON object has, even with a null value; NULL
    for a line that has to be read key by key (see :func:`_has_key`)."""
    value = F.try_parse_json(line)
    path = lambda box, key: f"$.{box}.{key}" if box else f"$.{key}"
    return F.transform(F.array(value), lambda v: F.when(v.isNotNull(), F.struct(*[F.try_variant_get(v, path(b, k), "variant").isNotNull().alias(f"{b or ''}_{k}")
                                                                                   for b, k in _NULLABLE])))[0]


def _has_key(line: Column, box: str | None, key: str) -> Column:
    """The object (or the object in ``box``) has ``key``, by its keys alone: for
    lines that repeat keys or hold NaN."""
    keys = F.json_object_keys(F.get_json_object(line, f"$.{box}") if box else line)
    return F.coalesce(F.array_contains(keys, F.lit(key)), F.lit(False))


def _defaulted(value: Column, default: str, nulls: str, box: str | None, key: str) -> Column:
    """``obj.get(key, default)``: with ``nulls="default"`` a NULL value and an
    absent key both give the default; with ``nulls="keep"`` an explicit JSON
    null stays NULL and only an absent key (or absent object) defaults."""
    if nulls == "default":
        return default_if_null(value, default)
    present = F.when(F.col("_present").isNotNull(), F.col("_present")[f"{box or ''}_{key}"]).otherwise(_has_key(F.col("_line"), box, key))
    return F.when(value.isNotNull(), value).when(present, F.lit(None).cast("string")).otherwise(F.lit(default))


def normalise_commits(raw: DataFrame, keep: list[str] | None = None, nulls: str = "default") -> DataFrame:
    """Commit records with a non-empty hash and repo, flattened to the
    canonical ``commits`` schema. Absent fields take the defaults (``unknown``
    for names, empty text otherwise); ``files_changed`` holds the non-empty
    new paths and ``num_files_changed`` counts every entry of the
    changed-files array. ``keep`` names extra columns to carry (e.g. ``seq``).

    ``nulls="default"`` also defaults explicit JSON nulls. ``nulls="keep"``
    keeps them NULL, which needs the raw line (``_line``, kept by
    ``classify_ndjson``) to tell an absent key from a null one."""
    if nulls not in ("default", "keep"):
        raise ValueError("nulls must be 'default' or 'keep'")
    author, committer = F.col("author"), F.col("committer")
    rows = raw.where(truthy("commit") & truthy("repo_name"))
    if nulls == "keep":
        if "_line" not in raw.columns:
            raise ValueError("nulls='keep' needs the raw line column _line")
        rows = rows.select("*", F.inline(F.array(F.struct(_presence(F.col("_line")).alias("_present")))))
    return rows.select(
        *_keep(raw, keep),
        F.col("commit").alias("commit_hash"),
        F.col("repo_name"),
        _defaulted(author["name"], S.DEFAULT_NAME, nulls, "author", "name").alias("author_name"),
        _defaulted(author["email"], S.DEFAULT_TEXT, nulls, "author", "email").alias("author_email"),
        _defaulted(committer["name"], S.DEFAULT_NAME, nulls, "committer", "name").alias("committer_name"),
        _defaulted(F.col("subject"), S.DEFAULT_TEXT, nulls, None, "subject").alias("subject"),
        _defaulted(F.col("message"), S.DEFAULT_TEXT, nulls, None, "message").alias("message"),
        _defaulted(F.col("tree"), S.DEFAULT_TEXT, nulls, None, "tree").alias("tree"),
        new_paths("difference").alias("files_changed"),
        array_length("difference").alias("num_files_changed"),
    )


def normalise_repos(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Repos with a non-empty name; ``watch_count`` is int-coerced (absent or
    not an integer gives 0) and ``name_length`` counts code points."""
    return raw.where(truthy("repo_name")).select(
        *_keep(raw, keep),
        F.col("repo_name"),
        lenient_long("watch_count").alias("watch_count"),
        code_point_length("repo_name").alias("name_length"),
    )


def normalise_licenses(raw: DataFrame, require_repo: bool = False) -> DataFrame:
    """License records with a non-empty license. ``require_repo=False`` is the
    counting rule (a record without repo still counts); ``True`` is the row
    rule, which also needs a non-empty repo name."""
    cond = truthy("license")
    if require_repo:
        cond = cond & truthy("repo_name")
    return raw.where(cond).select("repo_name", "license")


def unnest_languages(raw: DataFrame) -> DataFrame:
    """One row per (repo, language) entry. A NULL or absent array gives no
    rows, bytes are int-coerced (else 0) and entries without a name are
    dropped; a language with 0 bytes is kept."""
    entries = raw.select("repo_name", F.explode("language").alias("l"))
    return entries.where(truthy(F.col("l")["name"])).select(
        "repo_name",
        F.col("l")["name"].alias("name"),
        lenient_long(F.col("l")["bytes"]).alias("bytes"),
    )
