"""Session settings and durable scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "flowgauge", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster use the one spark-submit gives."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    defaults = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    A machine-local folder is used only in local mode, where driver and tasks
    share one disk; anywhere else a missing setting is an error.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="flowgauge-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def apart(df: DataFrame) -> DataFrame:
    """The same table in a session of its own with equal settings.

    A session that has observed a query once can no longer be sent to tasks, and
    fitted forests send theirs along with their training summary. Queries are
    therefore observed in a session that nothing else uses.
    """
    spark = df.sparkSession
    own = spark._jsparkSession.cloneSession()
    plan = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, df._jdf.logicalPlan())
    return DataFrame(plan, SparkSession(spark.sparkContext, own))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so a lost executor costs no recompute."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint(eager=True)
