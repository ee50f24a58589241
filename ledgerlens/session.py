"""Session settings and the shared scratch folder."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on; safe to set on a session someone else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even where the plan above it then needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(master: str | None = None, app: str = "ledgerlens", **conf: str) -> SparkSession:
    """Session with the settings above; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's ``spark.checkpoint.dir``.

    Only where that is unset on one machine (tests) a temporary folder is made and recorded; a cluster
    has to name its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder nobody else uses; grouped by application for clean-up."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage", **options: str) -> DataFrame:
    """Write once, read back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows from which a table is dealt anew, and bounds of the partitions it is dealt to.
ROWS_PER_PARTITION = 25_000
MOST_SMALL_PARTITIONS = 48
MOST_ROWS_PER_PARTITION = 500_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """The same rows dealt evenly over enough partitions to keep a cluster busy; ``rows`` is about their number.

    A file of one row group is read by one task however much work follows. Small tables stay as they are.
    """
    n = min(rows // ROWS_PER_PARTITION, MOST_SMALL_PARTITIONS)
    n = max(n, math.ceil(rows / MOST_ROWS_PER_PARTITION))
    return df.repartition(n) if n > 1 else df


def discard(spark: SparkSession, *stages: str | DataFrame) -> None:
    """Remove written stages nobody reads any more: paths of :func:`scratch_path`, or frames of :func:`materialize`.

    Only folders of this application below the shared folder are touched.
    """
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/"
    for stage in stages:
        if isinstance(stage, DataFrame):
            files = stage.inputFiles()
            stage = files[0].rsplit("/", 1)[0] if files else ""
        at = stage.find(own.split("://")[-1])
        if at < 0:
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(stage)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
