"""Session defaults and written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH = "spark.redpen.scratch.dir"


def build_session(app: str = "redpen", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed around.

    ``conf`` entries override the defaults (underscores stand for dots).
    On a cluster ``spark.checkpoint.dir`` must name a shared folder.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    settings.update({k.replace("_", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread_scan(scan: DataFrame, key: str) -> DataFrame:
    """Hash a direct file scan over all cores if its files give fewer tasks.

    Large inputs already split into more tasks than cores and are left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediates: ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder; on
    a cluster a machine-local folder would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_SCRATCH, None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="redpen-")
    spark.conf.set(_SCRATCH, root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and continue from the table.

    Cuts lineage, survives lost executors, keeps column pruning, and gives the
    planner true sizes for later joins. Compressed by zstd: texts take less room than by the default.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
