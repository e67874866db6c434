"""A snapshot in buckets, for change batches too large to broadcast.

The snapshot is written bucketed and sorted by hash; joins by hash then shuffle
the batch into the snapshot's buckets and leave the snapshot where it is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from commitlens import schemas as S

KEY = "commit_hash"


def _name() -> str:
    return f"commitlens_bucketed_{uuid.uuid4().hex[:12]}"


def write_bucketed(commits: DataFrame, path: str, buckets: int) -> DataFrame:
    """Write the snapshot to ``path`` in ``buckets`` buckets, one file each, and read it back."""
    name = _name()
    commits.select(*S.COMMIT_COLUMNS).repartition(buckets, KEY).write.bucketBy(buckets, KEY).sortBy(KEY).option("path", path).mode("overwrite").saveAsTable(name)
    return commits.sparkSession.table(name)


def read_bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A snapshot written by :func:`write_bucketed`, in any session. The table that
    tells Spark of the buckets is external: dropping it leaves the files."""
    name = _name()
    spark.sql(f"CREATE TABLE {name} ({S.COMMITS.toDDL()}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
