"""Session set-up, table access and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = 8, memory: str = "8g", partitions: int = 8, name: str = "tracewright") -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter makes the session."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    spark = b.config("spark.driver.host", "127.0.0.1").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: the shared folder in spark.checkpoint.dir where it is set, otherwise a
    temporary folder, which only a session in local mode may use."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tracewright-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(folder)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one job's files beside the checkpoints, so that all executors see it."""
    use_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, so that later reads neither compute it again nor need the
    executors that made it."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
