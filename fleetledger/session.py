"""Session defaults and the shared scratch location."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join whose output is regrouped right away still splits its hot partitions.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "fleetledger", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the plans were tuned for; ``conf`` entries win over the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def sizing(shuffle_bytes: int, cores: int, partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Shuffle settings for a known data size: partitions of a bounded size, and enough of them for
    all cores. Pass them to ``build_session``; AQE merges partitions that turn out small."""
    partitions = max(2 * cores, -(-shuffle_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(2 * partition_bytes),
    }


def _shared_root(spark: SparkSession) -> str | None:
    """The folder of ``spark.checkpoint.dir``, or the one a caller set with ``setCheckpointDir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get() if known.isDefined() else None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder of the cluster.

    A local session without one gets a folder of its own, once, which goes when the process ends. On a cluster a machine-local path would be
    invisible to the other executors, so there the setting is required.
    """
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    root = _shared_root(spark)
    if not root:
        if not local:
            raise ValueError("spark.checkpoint.dir is not set: name a shared folder for intermediate tables")
        root = tempfile.mkdtemp(prefix="fleetledger-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared scratch folder and read back.

    For a small result that a plan reads several times: it is computed once, survives the loss of
    executors, and its real size is known to the joins that follow.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``scratch_path`` that no plan reads any more, such as the state an iteration has replaced."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
