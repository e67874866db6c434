"""Structured Streaming versions of the load-time counters and the record
upsert.

* Counters: NDJSON files are read as a text stream, classified and
  normalised with the batch functions, aggregated with ``groupBy().agg()``
  (state = one row per key) in ``update`` mode; ``foreachBatch`` writes the
  changed totals of micro-batch N to ``batch_id=N`` and the counter table is
  the latest total per key over that log.
* Upsert: every micro-batch is reduced to the last version per hash and
  written as ``batch_id=N``; the snapshot is the last version per hash over
  the log: the greatest ``seq`` where records carry one, otherwise the last
  by arrival (micro-batch, file, place in the file).

A sink is a :class:`BatchLog`: a folder per micro-batch, and every
``COMPACT_EVERY`` micro-batches a snapshot of all before, so a read covers one
snapshot and a bounded tail however long the stream has run. Replaying a
micro-batch after a failure rewrites the same folders with the same rows, and a
micro-batch costs in proportion to its own size.

``trigger(availableNow=True)`` processes everything present in bounded
micro-batches (``maxFilesPerTrigger``) and stops. The data has no event time,
so no watermark applies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens import schemas as S
from commitlens.operators import derive as D
from commitlens.session import dropping_shuffles, read_if_exists, remove, work_dir
from commitlens.sources import ndjson as J
from commitlens.sources import normalise as NM


COMPACT_EVERY = 20
COMMIT_WITH_SEQ = T.StructType(list(S.RAW_COMMIT.fields) + [T.StructField("seq", T.LongType())])


def text_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Lines as ``value``, with the file they come from."""
    return (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(source_dir)
        .select("value", F.struct(F.col("_metadata.file_path").alias("file"),
                                  F.col("_metadata.file_block_start").alias("block")).alias("_from"))
    )


class BatchLog:
    """The output of a stream: ``log/batch_id=N`` folders, ``snapshot/upto=N``
    folders that hold the reduced table of all batches up to N, and
    ``marks/upto=N`` folders written after their snapshot is whole. Folders that
    the snapshot before the last one covers are removed, so that a listing has
    at most two snapshots and the batches since the older one."""

    def __init__(self, spark: SparkSession, out_dir: str, reduce: Callable[[DataFrame], DataFrame], compact_every: int = COMPACT_EVERY, reduced: bool = False):
        """``reduced``: what is written has one row per key already, so a table
        that is in one folder needs no reducing."""
        self.spark, self.out_dir, self.reduce, self.compact_every, self.reduced = spark, out_dir.rstrip("/"), reduce, compact_every, reduced

    def _mark(self, before: int | None = None) -> int:
        """Last snapshot (before a batch), -1 without one."""
        marks = read_if_exists(self.spark, f"{self.out_dir}/marks")
        if marks is None:
            return -1
        own = marks if before is None else marks.where(F.col("upto") < before)
        return -1 if (last := own.agg(F.max("upto")).first()[0]) is None else int(last)

    def _rows(self, mark: int, last: int | None = None, spark: SparkSession | None = None) -> DataFrame | None:
        """The snapshot and the batches after it (partition pruning: earlier
        folders are not read)."""
        spark = spark or self.spark
        log = read_if_exists(spark, f"{self.out_dir}/log")
        if log is None:
            return None
        tail = log.where(F.col("batch_id") > mark)
        tail = (tail if last is None else tail.where(F.col("batch_id") <= last)).withColumn("batch_id", F.col("batch_id").cast("bigint"))
        if mark < 0:
            return tail
        return spark.read.parquet(f"{self.out_dir}/snapshot/upto={mark}").unionByName(tail, allowMissingColumns=True)  # earlier folders may keep more of an order

    def write(self, batch: DataFrame, batch_id: int) -> None:
        with dropping_shuffles(batch.sparkSession):
            batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.out_dir}/log/batch_id={batch_id}")
            if (batch_id + 1) % self.compact_every == 0:
                whole = self.reduce(self._rows(self._mark(before=batch_id), batch_id, batch.sparkSession))
                whole.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.out_dir}/snapshot/upto={batch_id}")
                self.spark.range(1).write.mode("overwrite").parquet(f"{self.out_dir}/marks/upto={batch_id}")
                self._remove_before(self._mark(before=batch_id))

    def _numbers(self, kind: str, name: str) -> list[int]:
        """The numbers of the folders ``kind/name=N``."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out_dir}/{kind}")
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)
        parts = [status.getPath().getName().partition("=") for status in found]
        return [int(value) for key, _, value in parts if key == name and value.isdigit()]

    def _remove_before(self, mark: int) -> None:
        """Remove the batches that the snapshot at ``mark`` holds, and older snapshots."""
        if mark < 0:
            return
        for kind, name, last in (("log", "batch_id", mark), ("snapshot", "upto", mark - 1), ("marks", "upto", mark - 1)):
            for n in self._numbers(kind, name):
                if n <= last:
                    remove(self.spark, f"{self.out_dir}/{kind}/{name}={n}")

    def read(self, upto: int | None = None, columns: list[str] | None = None) -> DataFrame | None:
        """The current table with ``batch_id`` (or that after batch ``upto``, which
        is no older than the last batch but one); None before any batch. With
        ``columns`` (those that reducing needs among them) no others are moved."""
        mark = self._mark(before=None if upto is None else upto + 1)
        rows = self._rows(mark, upto)
        if rows is None:
            return None
        if self.reduced and (mark >= 0) + sum(mark < n and (upto is None or n <= upto) for n in self._numbers("log", "batch_id")) == 1:
            return rows
        return self.reduce(rows if columns is None else rows.select(*columns))

    def run(self, stream: DataFrame, mode: str, checkpoint_dir: str, prepare: Callable[[DataFrame, int], DataFrame]) -> None:
        """Process all that is present and stop."""
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, batch_id: self.write(prepare(batch, batch_id), batch_id))
            .start()
        )
        query.awaitTermination()


def _latest_totals(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Per key, the row of its latest micro-batch (a partial ``max_by``)."""
    return lambda log: D.latest_by_key(log, keys, "batch_id")


def stream_counts(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType,
    required: list[str],
    derive: Callable[[DataFrame], DataFrame],
    keys: list[str],
    out_dir: str,
    checkpoint_dir: str,
    max_files_per_trigger: int = 1,
    compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """Run a counter stream to completion over the files present and return
    the current counter table, which holds all runs on the same folders.

    The aggregate runs in ``update`` mode: each micro-batch emits only the
    keys whose totals changed, written to its own folder. The table is the
    latest total per key."""
    lines = text_stream(spark, source_dir, max_files_per_trigger)
    counts = derive(J.accepted(J.classify_ndjson(lines, schema, required)).drop("_from"))
    log = BatchLog(spark, out_dir, _latest_totals(keys), compact_every)
    log.run(counts, "update", checkpoint_dir, lambda batch, _: batch)
    table = log.read()
    return spark.createDataFrame([], counts.schema) if table is None else table.select(*counts.columns)


def _last_versions(records: DataFrame) -> DataFrame:
    return D.latest_by_key(records, ["commit_hash"], "_order")


def commit_records(lines: DataFrame, batch_id: int) -> DataFrame:
    """The commits of a micro-batch's lines, with their place in the order of
    versions as ``_order``: ``seq``, then micro-batch, file and place in the file.

    A compressed file is read by one task, so lines that come in fewer parts than
    there are cores are dealt out before they are parsed; their places are
    taken before (ids increase along a task, so along a file's split)."""
    placed = lines.select("value", F.struct(F.col("_from.file"), F.col("_from.block"), F.monotonically_increasing_id().alias("place")).alias("_from"))
    if lines.rdd.getNumPartitions() < lines.sparkSession.sparkContext.defaultParallelism:
        placed = placed.repartition("_from.place")
    records = NM.normalise_commits(J.accepted(J.classify_ndjson(placed, COMMIT_WITH_SEQ, ["commit", "repo_name"])), keep=["seq", "_from"])
    order = F.struct("seq", F.lit(batch_id).cast("bigint").alias("batch"), F.col("_from.file").alias("file"),
                     F.col("_from.block").alias("block"), F.col("_from.place").alias("place"))
    return records.withColumn("_order", order).drop("_from", "seq")


def between_batches(versions: DataFrame) -> DataFrame:
    """Reduced records of a micro-batch as they are kept: versions of a key come
    from different micro-batches from here on, so file and place decide nothing."""
    return versions.withColumn("_order", F.struct("_order.seq", "_order.batch"))


def stream_upsert(
    spark: SparkSession,
    source_dir: str,
    out_dir: str,
    checkpoint_dir: str,
    max_files_per_trigger: int = 1,
    compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """Stream commit records into a snapshot keyed by hash; returns the
    snapshot (with ``seq``, null where records have none).

    Each micro-batch is reduced to its last version per hash. Versions are
    ordered by ``seq`` if they carry it (a record without one is older than
    any that has one), then by micro-batch, file and place in the file."""
    log = BatchLog(spark, out_dir, _last_versions, compact_every, reduced=True)
    log.run(text_stream(spark, source_dir, max_files_per_trigger), "append", checkpoint_dir,
            lambda lines, batch_id: between_batches(_last_versions(commit_records(lines, batch_id))))
    table = log.read()
    if table is None:
        schema = T.StructType([T.StructField("seq", T.LongType()), *S.COMMITS.fields])
        return spark.createDataFrame([], schema)
    return table.select(F.col("_order.seq").alias("seq"), *S.COMMIT_COLUMNS)


#: Lines in a compressed file that one task reads whole.
FILE_LINES = 500_000


def stage_lines(spark: SparkSession, lines: DataFrame, purpose: str, **options) -> tuple[str, str, str]:
    """Write a lines frame as text files (the stream's source folder; options as
    of the writer) and return (source, sink, checkpoint) folders."""
    base = work_dir(spark, purpose)
    with dropping_shuffles(spark):
        lines.write.mode("overwrite").options(**options).text(f"{base}/source")
    return f"{base}/source", f"{base}/sink", f"{base}/checkpoint"


def stream_author_counts(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str, max_files_per_trigger: int = 4) -> DataFrame:
    return stream_counts(
        spark, source_dir, S.RAW_COMMIT, ["commit", "repo_name"],
        lambda recs: D.author_counts(NM.normalise_commits(recs)),
        ["repo_name", "author_name"], out_dir, checkpoint_dir, max_files_per_trigger,
    )


def stream_author_counts_from(spark: SparkSession, lines: DataFrame, max_files_per_trigger: int = 4) -> DataFrame:
    return stream_author_counts(spark, *stage_lines(spark, lines, "stream-authors"), max_files_per_trigger)


def stream_language_bytes_from(spark: SparkSession, lines: DataFrame, max_files_per_trigger: int = 4) -> DataFrame:
    src, out, cp = stage_lines(spark, lines, "stream-languages")
    return stream_counts(
        spark, src, S.RAW_LANGUAGE, [],
        lambda recs: D.language_bytes(NM.unnest_languages(recs)),
        ["name"], out, cp, max_files_per_trigger,
    )


#: Compressed to a ninth or so: the whole source is there before the stream starts.
COMPRESSED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def stream_upsert_from(spark: SparkSession, lines: DataFrame, max_files_per_trigger: int = 4, **options) -> DataFrame:
    src, out, cp = stage_lines(spark, lines, "stream-upsert", **COMPRESSED, **options)
    table = stream_upsert(spark, src, out, cp, max_files_per_trigger).drop("seq")
    remove(spark, src)  # of our own, and all in the table
    return table
