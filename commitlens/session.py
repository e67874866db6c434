"""Session construction and the shared work folder.

Intermediate outputs (load-job tables, streaming sources, sinks and
checkpoints) go under the folder the cluster names in
``spark.checkpoint.dir``; that folder is shared by all executors. Only when
the setting is absent and the master is local (tests) is a folder of our own made.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # streaming state (one row per counter key) kept in RocksDB: bounded JVM
    # heap however many keys there are
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def cluster_conf(total_cores: int) -> dict[str, str]:
    """Settings for a large cluster (e.g. 1000 executors over ~100 TB).

    * shuffle partitions: about 3 per core, so a stage runs in ~3 waves and
      every partition stays well below executor memory; AQE coalesces the
      small ones after each stage, so a small query does not pay for them;
    * input splits of 256 MB: fewer, larger scan tasks for wide parquet;
    * skew join: a partition 5x the median and over 256 MB is split, so a
      key holding a third of the rows does not land in one task;
    * broadcast only below 64 MB, decided by Spark's size estimate or, with
      AQE, the measured shuffle size."""
    return {
        "spark.sql.shuffle.partitions": str(max(200, 3 * total_cores)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * 1024 * 1024),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    }


def build_session(
    master: str | None = None, shuffle_partitions: int | None = None, app: str = "commitlens",
    total_cores: int | None = None, **conf,
) -> SparkSession:
    """A session with the settings above for all that spark-submit (or an
    existing session) has not set. ``master`` and ``shuffle_partitions`` are
    set only when given; a plain Python run without a master is local.
    ``total_cores`` adds :func:`cluster_conf`."""
    given = dict(SparkConf().getAll())
    settings = dict(DEFAULT_CONF)
    if total_cores is not None:
        settings.update(cluster_conf(total_cores))
    settings = {k: v for k, v in settings.items() if k not in given}
    if master is not None:
        settings["spark.master"] = master
    elif "spark.master" not in given:
        settings["spark.master"] = "local[*]"
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k: str(v) for k, v in conf.items()})
    spark = SparkSession.builder.appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. A folder of our own is
    made only for a local master (tests); a cluster must name one."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: only the session conf is visible
        sc = None
    root = spark.conf.get("spark.checkpoint.dir", None)
    if sc is not None:
        root = root or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if sc is None or not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="commitlens-ckpt-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def is_local(master: str) -> bool:
    """One machine: ``local`` or ``local[...]`` (not ``local-cluster``)."""
    return master == "local" or master.startswith("local[")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unique folder name under the shared checkpoint folder; the
    writers make the folder, on whatever store it is."""
    return f"{checkpoint_root(spark)}/commitlens/{purpose}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to a new work folder and read back: for what
    several jobs or branches of a plan would each compute again."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, None if there is no such path. Spark
    resolves the path, so it may be in any store."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


#: Shuffle files of a job go when it ends; else they stay until the driver
#: happens to collect its garbage, which a long run of jobs fills disks before.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside drop their shuffle files when they end."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of our own, in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
