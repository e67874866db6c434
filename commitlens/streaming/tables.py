"""All commit tables from one stream.

Commit lines are parsed once per micro-batch and the accepted records written;
each table takes its part from those records into a log of its own (see
:class:`counters.BatchLog`), and a mark written last says that the micro-batch is
in all of them; the records go then. A reader takes every table up to the last mark, so the tables
always show the same records. After a crash between two sinks Spark replays the
micro-batch, which rewrites the same folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens import schemas as S
from commitlens.operators import derive as D
from commitlens.session import dropping_shuffles, read_if_exists, remove
from commitlens.streaming.counters import COMPACT_EVERY, BatchLog, _last_versions, between_batches, commit_records, text_stream


def _sums(keys: list[str], value: str) -> Callable[[DataFrame], DataFrame]:
    """Totals of increments; ``batch_id`` says up to which batch."""
    return lambda log: log.groupBy(*keys).agg(F.sum(value).cast("bigint").alias(value), F.max("batch_id").alias("batch_id"))


def _last_per_repo(rows: DataFrame) -> DataFrame:
    return D.latest_by_key(rows, ["repo_name", "commit_hash"], "_order")


class CommitStream:
    """The tables under ``out_dir``: commits, commits_by_repo, author_counts and
    repos_loaded, as a load of the same lines gives them."""

    def __init__(self, spark: SparkSession, out_dir: str, compact_every: int = COMPACT_EVERY):
        self.spark, self.out_dir = spark, out_dir.rstrip("/")
        log = lambda name, reduce, **more: BatchLog(spark, f"{self.out_dir}/{name}", reduce, compact_every, **more)
        pairs = ["repo_name", "author_name"]
        slim = ["repo_name", "commit_hash", "author_name", "subject", "num_files_changed", "_order"]
        #: Table: (its log, what a micro-batch adds).
        self.sinks: dict[str, tuple[BatchLog, Callable[[DataFrame], DataFrame]]] = {
            "commits": (log("commits", _last_versions, reduced=True), lambda r: between_batches(_last_versions(r))),
            "commits_by_repo": (log("commits_by_repo", _last_per_repo, reduced=True), lambda r: between_batches(_last_per_repo(r.select(*slim)))),
            "author_counts": (log("author_counts", _sums(pairs, "commit_count")), lambda r: D.author_counts(r)),
            "repos_loaded": (log("repos_loaded", _sums(["repo_name"], "records")), lambda r: r.groupBy("repo_name").agg(F.count("*").alias("records"))),
        }

    def done(self) -> int:
        """The last micro-batch that is in all tables, -1 without one."""
        marks = read_if_exists(self.spark, f"{self.out_dir}/done")
        return -1 if marks is None or (last := marks.agg(F.max("batch_id")).first()[0]) is None else int(last)

    def write(self, lines: DataFrame, batch_id: int) -> None:
        """One micro-batch into all tables."""
        path = f"{self.out_dir}/records/batch_id={batch_id}"
        records = commit_records(lines, batch_id)
        with dropping_shuffles(lines.sparkSession):
            records.write.mode("overwrite").option("compression", "zstd").parquet(path)
        own = lines.sparkSession.read.parquet(path)
        for log, part in self.sinks.values():
            log.write(part(own), batch_id)
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.out_dir}/done/batch_id={batch_id}")
        remove(self.spark, path)

    def run(self, source_dir: str, checkpoint_dir: str, max_files_per_trigger: int = 1) -> None:
        """Process all lines that are present and stop."""
        text_stream(self.spark, source_dir, max_files_per_trigger).writeStream.outputMode("append").option("checkpointLocation", checkpoint_dir) \
            .trigger(availableNow=True).foreachBatch(self.write).start().awaitTermination()

    def read(self, name: str, columns: list[str] | None = None) -> DataFrame | None:
        """A table (or ``columns`` of it) after the last micro-batch that is in all of
        them; None before any."""
        last = self.done()
        if last < 0:
            return None
        own = {"commits": S.COMMIT_COLUMNS, "commits_by_repo": ["repo_name", "commit_hash", "author_name", "subject", "num_files_changed"],
               "author_counts": ["repo_name", "author_name", "commit_count"], "repos_loaded": ["repo_name"]}[name]
        wanted = columns or own
        keys = {"commits": ["commit_hash"], "commits_by_repo": ["repo_name", "commit_hash"]}.get(name)
        log = self.sinks[name][0]
        # places in the order are unique, so that other columns decide nothing
        return (log.read(last, list(dict.fromkeys([*keys, *wanted, "_order"]))) if keys else log.read(last)).select(*wanted)
