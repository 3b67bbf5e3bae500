"""Intermediate tables in the folder that driver and executors share.

``materialize`` writes a DataFrame as Parquet and reads it back: the lineage
ends at files that outlive any executor, and a table that is used twice is
computed once.  The folder is the one that ``spark.checkpoint.dir`` names.
Only where that is unset (tests, a laptop) a temporary folder takes its place.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Writers hold a row group in memory; wide binary columns fill one at this size.
_ROW_GROUP = 32 << 20
#: A table of more bytes is never shuffled only to spread it.
_SPREAD_BYTES = 1 << 30
#: Rows of a narrow table that are worth a task and a file.
ROWS = 1 << 14
_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The base folder for this application's intermediate tables, without a trailing slash."""
    base = spark.conf.get(_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_SETTING} must name a shared folder on a cluster")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set(_SETTING, base)
    folder = f"{base.rstrip('/')}/millrace/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        # results may read these tables until the program ends
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        atexit.register(_remove, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)
    return folder


def _remove(files, path) -> None:
    """Delete an application's folder; a program that is killed leaves it behind."""
    try:
        files.delete(path, True)
    except Exception:  # the JVM may have gone first
        return


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the DataFrame that reads it."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("parquet.block.size", _ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gather(df: DataFrame, most: int, each: int = ROWS) -> DataFrame:
    """``df``, of at most ``most`` rows, in no more tasks of its last stage than there are ``each`` rows for.

    Many partitions of few rows are many small files.  On a local file system the JVM also starts two processes a file
    (its mode and its checksum's), which share the executor's memory until they run their program.
    """
    return df.coalesce(-(-most // max(each, 1)) or 1)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table just read to all cores if its files split into fewer parts.

    Only tables of up to ``_SPREAD_BYTES`` on disk are shuffled for that; on larger ones the scan's own splits stay.
    No result depends on how rows are dealt.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > _SPREAD_BYTES:
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """Write a small file by Spark's file systems, so that every node can read it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def create_once(spark: SparkSession, path: str, data: bytes) -> bool:
    """Write a small file that doesn't exist yet, whole or not at all; False if another writer was first."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    final = hadoop.Path(path)
    files = final.getFileSystem(conf)
    files.mkdirs(final.getParent())
    ready = write_bytes(spark, f"{path}.{uuid.uuid4().hex}.ready", data)
    if files.getScheme() == "file":
        # a link is made once, whatever else runs on this machine
        here, there = (files.makeQualified(hadoop.Path(p)).toUri().getPath() for p in (ready, path))
        try:
            os.link(here, there)
            return True
        except FileExistsError:
            return False
        finally:
            files.delete(hadoop.Path(ready), False)
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(final.toUri(), conf).rename(files.makeQualified(hadoop.Path(ready)), files.makeQualified(final), options)
        return True
    except Exception:
        files.delete(hadoop.Path(ready), False)
        if files.exists(final):
            return False
        raise
