"""Common words of commit subjects.

Lower-case, split on single spaces (empty tokens kept, punctuation stays on
the word), drop stop words and words shorter than the minimum length, count,
rank. All native expressions; the word count is a partial + final hash
aggregate, so a word that makes up a third of all tokens is combined inside
every task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens import schemas as S
from commitlens.operators.ranking import top_k, with_report_columns


def qualifying_word(word: Column, min_length: int = S.MIN_WORD_LENGTH) -> Column:
    """The word matches ``^.{min,}$`` where ``.`` is any character but a line
    feed and ``$`` may sit before one final line feed: drop one trailing line
    feed, then require no line feed and at least ``min`` code points. Written
    with plain string functions so it stays in generated code."""
    core = F.when(word.endswith(F.lit("\n")), F.substr(word, F.lit(1), F.length(word) - F.lit(1))).otherwise(word)
    return (F.instr(core, "\n") == F.lit(0)) & (F.length(core) >= F.lit(min_length))


def words(df: DataFrame, text_col: str = "subject") -> DataFrame:
    """One row per space-separated token of the lower-cased text."""
    return df.select(F.explode(F.split(F.lower(F.col(text_col)), " ")).alias("word"))


def word_counts(
    df: DataFrame,
    text_col: str = "subject",
    stop_words: Sequence[str] = S.STOP_WORDS,
    min_length: int = S.MIN_WORD_LENGTH,
) -> DataFrame:
    """Count per qualifying word over the whole text column."""
    w = words(df, text_col)
    keep = ~F.col("word").isin(list(stop_words)) & qualifying_word(F.col("word"), min_length)
    return w.where(keep).groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("word_count"))


def top_words(
    df: DataFrame,
    text_col: str = "subject",
    n: int = S.TOP_WORDS,
    stop_words: Sequence[str] = S.STOP_WORDS,
    width: int = S.BAR_WIDTH_WORDS,
) -> DataFrame:
    """The n most common words (count DESC, word ASC) with rank and bar."""
    counts = word_counts(df, text_col, stop_words)
    return with_report_columns(top_k(counts, "word_count", "word", n), "word_count", width)
