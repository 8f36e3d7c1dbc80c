"""Session helpers: a local test session and the checkpoint folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: str = "8", shuffle_partitions: int = 8, app: str = "ferryload", checkpoint_dir: str | None = None
) -> SparkSession:
    """Session for tests and the bench. On a cluster the caller's session is used as it is."""
    builder = SparkSession.builder
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors and the driver see: ``spark.checkpoint.dir``, or, in a local session
    (tests) where that is unset, a folder below the warehouse. A cluster has to name one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not configured and not (master == "local" or master.startswith("local[")):
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    return (configured or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints").rstrip("/")


class JobFolder:
    """A folder of one job below the shared folder; it goes when the Python process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove)

    def _remove(self) -> None:
        context = self.spark.sparkContext
        if context._jsc is not None and not context._jsc.sc().isStopped():
            remove_folder(self.spark, self.path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whichever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and forget how it was built."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
