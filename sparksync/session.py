"""Session helpers: a local session for tests and bench, and the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "sparksync") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Recording the call site of every column operation doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session may fall back to a temporary folder, since executors on other
    machines could not read it.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root is None and sc.getCheckpointDir() is not None:
        root = sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="sparksync-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_superseded(spark: SparkSession, settle: float = 0.0) -> None:
    """Let Spark delete the shuffle files and checkpoints of earlier rounds.

    Spark deletes what nothing refers to any more, but looks only when the
    driver collects garbage, which an idle driver seldom does. Rounds that each
    write a new state would otherwise hold all of them on disk at once. What
    the very last step has left is still in Spark's own hands for a moment; with
    ``settle`` a second look follows after so many seconds.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if settle:
        time.sleep(settle)
        spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
