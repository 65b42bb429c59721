"""Session settings and the shared folder for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Deals tables of a few small files out to so many partitions when they are read; unset by
#: default, as a cluster reads large tables as they lie.
READ_PARTITIONS = "spark.critiq.read.partitions"


#: Rows of text that a Python worker is given at once.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Give Python workers at most ``BATCH_ROWS`` rows at once, as texts may be long.

    The session's limit is lowered for good, since it is read when a plan runs.
    """
    if not 0 < int(spark.conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def local_session(cores: int | str = 8, app_name: str = "critiq") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(READ_PARTITIONS, str(2 * int(cores)) if str(cores).isdigit() else "16")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the cluster; a temporary one only for local masters."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is not None:
        return current
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="critiq-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for intermediate tables under the shared one."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written copy.

    Used behind model calls, which must run once per row and whose output may
    differ between attempts.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
