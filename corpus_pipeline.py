"""Corpus cleaning: quality rules, near duplicates, benchmark decontamination,
secrets, tokens.

Each stage is written as Parquet under the shared folder and reread as the next
one's input, so a lost executor costs its own tasks only. The first four
return the columns of documents: rows go, and secrets are replaced in the
text. The last one returns each document's id, language and source with its token
ids, their number and whether they decode to the text.

Edge cases. A null or empty text has no words, so the quality rules reject it;
texts of any length are processed whole; of repeated rows, as of near duplicates,
one id stays, with all rows of that id; an empty table gives no rows. Extra columns
pass through the first four stages, whatever their names; the last returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm import decontaminate, jaccard_join, quality, secrets, sentencepiece
from commitlens.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


#: Near duplicates: five words and a similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, that with the smallest id stays."""
    return jaccard_join.keep_one(docs, size=NEAR_WORDS, threshold=NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return secrets.redact_secrets(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, their number, and whether they decode
    to its text."""
    done = sentencepiece.decode(sentencepiece.encode(docs.select("doc_id", "lang", "source", "text")))
    plain = F.translate(F.coalesce("text", F.lit("")), sentencepiece.MARK, " ")
    return done.select("doc_id", "lang", "source", "tokens", F.size("tokens").cast("bigint").alias("n_tokens"),
                       (F.col("decoded") == plain).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]

#: SQL can't express a trained tagger or a tokenizer; tests/llm holds the
#: result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
