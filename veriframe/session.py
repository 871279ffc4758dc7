"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE re-plans joins from measured sizes, splits skewed partitions and merges small ones, so the
# initial partition count only has to be large enough for the biggest shuffle.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app="veriframe", master=None, shuffle_partitions=None, driver_memory=None):
    builder = SparkSession.builder.appName(app).config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark):
    """This application's folder below the cluster's shared checkpoint folder.

    Only a session inside one process may go without that setting; it then uses a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return os.path.join(base, f"veriframe-{spark.sparkContext.applicationId}")


def scratch_dir(spark, name):
    """A new folder for one intermediate table."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def clear_scratch(spark):
    """Delete the intermediate tables of this application; results that still read them must have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_WRITTEN = contextvars.ContextVar("written intermediates", default=None)


@contextlib.contextmanager
def intermediates():
    """A list of the folders that ``cut_lineage`` writes inside the block; a block around it lists them too."""
    written, outer = [], _WRITTEN.get()
    token = _WRITTEN.set(written)
    try:
        yield written
    finally:
        _WRITTEN.reset(token)
        if outer is not None:
            outer.extend(written)


def delete_intermediates(spark, paths):
    """Delete intermediate tables that no unwritten result reads any more."""
    for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df, name):
    """Write an intermediate to the shared folder and read it back, so lost executors cost no recomputation."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    if _WRITTEN.get() is not None:
        _WRITTEN.get().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark):
    """Let Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
