"""Session helpers: a tuned local session for tests, and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tablemill.errors import SpecError

CHECKPOINT_SETTING = "spark.checkpoint.dir"


# Session settings the library is meant to run with. Adaptive execution sizes the shuffles
# and splits hot join partitions, also where that costs one more shuffle further on.
RECOMMENDED_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows with whole texts are large: smaller batches bound the memory of Python workers.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the recommended settings on a running session, and let its Python workers find this package.

    Workers on other hosts need it installed or sent with --py-files.
    """
    own = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if own not in known:
        environment["PYTHONPATH"] = os.pathsep.join([own, *filter(None, known)])
    for name, value in RECOMMENDED_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: str = "*", app: str = "tablemill", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    return apply_settings(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    A local session that names none gets a scratch folder of its own. A cluster session
    that names none is refused: a machine-local folder would be invisible to other hosts.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise SpecError(f"Set {CHECKPOINT_SETTING} to a folder that all executors share.")
        folder = tempfile.mkdtemp(prefix="tablemill-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a frame once as Parquet in the shared folder and read it back.

    Used where a result is needed by more than one action. The written table survives the
    loss of executors and keeps column statistics, so later filters still prune it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
