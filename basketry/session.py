"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the plans in this library rely on. Skewed shuffle partitions are split by
# adaptive execution, also where that costs one more exchange further up.
ADAPTIVE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


_scratch_folders: set[str] = set()


def build_session(app_name: str = "basketry", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    # checkpoint files go when nothing refers to them any more
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Turn on the adaptive settings; every other setting stays the cluster's."""
    for key, value in ADAPTIVE_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder of this machine stands in only when the session runs in local mode.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="basketry-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared folder that belongs to this application and goes when its driver ends."""
    base = "/".join([shared_root(spark), "basketry", spark.sparkContext.applicationId])
    if base not in _scratch_folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _scratch_folders.add(base)
    return "/".join([base, *parts])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive lost executors and are computed once."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(os.path.join(shared_root(df.sparkSession), "checkpoints"))
    return df.checkpoint(eager=True)
