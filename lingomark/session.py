"""Session settings, scratch tables and input spreading shared by all jobs."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys (one clip name may hold a third of a manifest) are split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows of clips and long texts are large, so Arrow batches are cut by bytes, not only by rows. Each
    # task holds a batch several times: in the JVM on its way out and back, and in Python.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
}

_local_roots: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options the jobs of this package are planned for."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    if not spark.sparkContext.master.startswith("local"):
        # Start shuffles wide; the adaptive planner merges what turns out small.
        wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wide))
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder for staged tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of the machine; on a cluster the
    setting has to name storage that all executors share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="lingomark-")
        context.setCheckpointDir(_local_roots[context.applicationId])
    return _local_roots[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the scratch folder, unique per call."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/{app}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Cuts the lineage, so a lost executor replays a file read and not the job above it, and
    freezes values that depend on the partitioning (partition ids, row positions).
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Size of a result as the optimizer estimates it (file sizes for scans)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, bytes_per_task: int = 128 * 1024) -> DataFrame:
    """Give an input smaller than one scan split per core enough tasks for heavy expressions.

    A Parquet row group cannot be cut, so a small file is one task however many cores wait.
    Inputs with at least one split per core are returned unchanged: they need no shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = plan_bytes(df)
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    tasks = min(cores, math.ceil(size / bytes_per_task))
    if size >= cores * split or tasks <= 1:
        return df
    return df.repartition(tasks)
