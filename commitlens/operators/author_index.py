"""Author search without reading every commit: a dictionary of distinct authors
with trigram postings, and the commits of each author.

A regular expression that needs certain letters can only match authors that hold
their trigrams; the expression itself decides among those. Texts are folded as
the case-insensitive match folds them, so no author that matches is left out: the
characters outside ASCII that match an ASCII letter are mapped to it, and runs of
needed letters end at any other character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens import schemas as S

# Characters that match an ASCII letter when case is ignored (long s, Kelvin sign, dotless and dotted i).
FOLD_FROM, FOLD_TO = "ſKıİ", "skii"
GRAM = 3
#: Authors up to which a counted list of hits is broadcast.
SMALL_AUTHORS = 100_000


def folded(author: Column) -> Column:
    return F.translate(F.lower(F.translate(author, FOLD_FROM, FOLD_TO)), FOLD_FROM, FOLD_TO)


def needed_runs(pattern: str) -> list[str]:
    """Runs of ASCII characters, lower-cased, that every match holds. Only what
    stands plainly outside groups, sets and choices counts; a pattern with a
    choice or an unusual escape outside of those has none."""
    runs, run, depth, i = [], "", 0, 0

    def end(optional: bool = False) -> None:
        nonlocal run
        if optional:
            run = run[:-1]
        if run:
            runs.append(run)
        run = ""

    while i < len(pattern):
        c, step, literal = pattern[i], 1, ""
        if c == "\\":
            nxt = pattern[i + 1:i + 2]
            if nxt in ("Q", "E", "x", "u", "c", "0", "N", "k", "p", "P", ""):
                return []
            step, literal = 2, nxt if not nxt.isalnum() else ""
            if depth == 0 and not literal:
                end()
        elif c == "[":
            if depth == 0:
                end()
            close, nested = i + 1, 1
            while close < len(pattern) and nested:
                x = pattern[close]
                close += 2 if x == "\\" else 1
                nested += (x == "[") - (x == "]")
            if pattern[i + 1:i + 2] in ("]", "^") and "]" in pattern[i + 1:i + 3]:
                return []  # a bracket as a member: leave it to the expression
            step = close - i
        elif c == "(":
            if depth == 0:
                end()
            if pattern[i + 1:i + 2] == "?":
                return []  # flags and look-around
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                end()
        elif depth:
            pass
        elif c == "|":
            return []
        elif c in "*?{":
            end(optional=True)
            if c == "{":
                step = max(1, pattern.find("}", i) - i + 1)
        elif c == "+":
            end()
        elif c in ".^$":
            end()
        else:
            literal = c
        if literal and depth == 0:
            if literal.isascii() and literal.isprintable():
                run += literal.lower()
            else:
                end()
        i += step
    end()
    return [r for r in runs if len(r) >= GRAM]


def grams_of(run: str) -> list[str]:
    return [run[i:i + GRAM] for i in range(len(run) - GRAM + 1)]


def write_index(commits: DataFrame, out_dir: str) -> None:
    """The dictionary, the postings (sorted by trigram) and the hashes of each
    author (sorted by author), so that each lookup reads few row groups."""
    out_dir = out_dir.rstrip("/")
    spark = commits.sparkSession
    commits.select("author_name").where("author_name IS NOT NULL").distinct().write.parquet(f"{out_dir}/authors")
    authors = spark.read.parquet(f"{out_dir}/authors")
    text = folded(F.col("author_name"))
    n = F.length(text) - GRAM
    grams = authors.where(n >= 0).select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: F.substr(text, i + 1, F.lit(GRAM))))).alias("gram"), "author_name")
    grams.repartitionByRange("gram", "author_name").sortWithinPartitions("gram", "author_name").write.parquet(f"{out_dir}/grams")
    by_author = commits.where("author_name IS NOT NULL").select("author_name", "commit_hash")
    by_author.repartitionByRange("author_name", "commit_hash").sortWithinPartitions("author_name", "commit_hash").write.parquet(f"{out_dir}/commits_by_author")


def matching_authors(spark: SparkSession, index_dir: str, pattern: str) -> DataFrame:
    """The distinct authors that the pattern matches anywhere, ignoring case."""
    index_dir = index_dir.rstrip("/")
    grams = sorted({g for run in needed_runs(pattern) for g in grams_of(run)})
    if grams:
        posted = spark.read.parquet(f"{index_dir}/grams").where(F.col("gram").isin(grams))
        authors = posted.groupBy("author_name").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    else:
        authors = spark.read.parquet(f"{index_dir}/authors")
    return authors.select("author_name").where(F.col("author_name").rlike("(?iu)" + pattern))


def search_author(commits: DataFrame, index_dir: str, pattern: str, n: int = S.LIST_LIMIT) -> DataFrame:
    """The first ``n`` commits by hash whose author the pattern matches: the same
    as the search over all commits, which here are read by hash only."""
    if n < 1:
        raise ValueError("limit must be positive")
    spark = commits.sparkSession
    authors = matching_authors(spark, index_dir, pattern).cache()
    try:
        hits = authors.count()
        hashes = spark.read.parquet(f"{index_dir.rstrip('/')}/commits_by_author")
        few = [r[0] for r in authors.limit(S.LIST_LIMIT + 1).collect()]
        if hits <= S.LIST_LIMIT:
            own = hashes.where(F.col("author_name").isin(few))  # pushed to the scan
        else:
            own = hashes.join(F.broadcast(authors) if hits <= SMALL_AUTHORS else authors, "author_name", "left_semi")
        first = [r[0] for r in own.select("commit_hash").orderBy("commit_hash").limit(n).collect()]
    finally:
        authors.unpersist()
    return commits.where(F.col("commit_hash").isin(first)).orderBy("commit_hash").limit(n)
