"""Session defaults, table access and checkpoint folder handling."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cores: str = "8", app: str = "studyloom", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks. A cluster passes its own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # call sites of column functions are not recorded; that halves the time to build wide plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STUDYLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every job relies on: naive times are read as UTC.

    In local mode the untouched default of 200 shuffle partitions is brought down to the cores; a
    cluster keeps what it was given, and AQE joins small partitions there.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.sparkContext.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(max(1, spark.sparkContext.defaultParallelism)))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's own, or a scratch one in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        configured = tempfile.mkdtemp(prefix="studyloom-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return configured


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the checkpoint root for tables a job writes and reads back."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The table as written to a scratch folder and read back: pinned like a checkpoint, but packed by columns. Its order is lost.

    What was shuffled to make it is let go at once, not when the driver happens to collect its garbage.
    """
    spark, clean = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch_dir(spark, label), spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    return spark.read.parquet(path)


class Tables:
    """Lazy access to the parquet tables of one data folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = prepare(spark)
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def glob(self, name: str) -> str:
        """The table's path as a pattern, which a stream takes for a file and for a folder."""
        return f"{self.root}/{{{name}.parquet}}"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))
