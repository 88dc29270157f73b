"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set, as in local tests."""
    context = spark.sparkContext
    named = context.getConf().get(SETTING)
    if named:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="genoquery-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    return context.getCheckpointDir()


#: How files are written in a shared folder that is mounted: Hadoop's usual class for local files adds a checksum file to each and, without
#: native code, starts a `chmod` for both, and until that process runs its executor's memory counts twice. Other file systems don't read these.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

#: A checkpoint's files: each still costs such a file system a `chmod`, and small ones add up. Up to so many per core are fine, and so is a
#: quarter of the session's shuffle partitions, which users set by the size of their data.
FILES_PER_CORE, SHARE_OF_SHUFFLE = 2, 4


def checkpoint(df: DataFrame, wide: bool = False) -> DataFrame:
    """The rows of df, written once to the shared folder: later stages don't compute them again, and a lost executor loses none. Unless
    `wide` (for rows that hold texts), more partitions than the bounds above are put together."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    if not wide:
        df = df.coalesce(
            max(
                FILES_PER_CORE * spark.sparkContext.defaultParallelism,
                -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARE_OF_SHUFFLE)
            )
        )
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = {k: conf.get(k) for k in PLAIN_FILES}
    try:
        for k, v in PLAIN_FILES.items():
            conf.set(k, v)
        return df.checkpoint(eager=True)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results are checkpointed: its cleaner follows the driver's garbage collection,
    which is otherwise too rare to bound the disk that a chain of jobs takes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
