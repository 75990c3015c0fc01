"""Sessions, tables of a data folder, and cutting a plan's lineage through the cluster's shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Shuffle files go when their query has ended, not when the driver happens to collect its garbage: loops would fill the disks.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PARTITIONS = "spark.sql.shuffle.partitions"
#: Bytes of input files for each partition where a shuffle is to keep to a bounded size.
PART_BYTES = 8 << 20


def session(name: str = "lodestone", **conf: str) -> SparkSession:
    """A session with the settings that all operators count on: UTC, adaptive execution."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def input_bytes(*dfs: DataFrame) -> int:
    """Bytes of all files that the plans read, each file once; what partitions are numbered by without a job."""
    files = {f: None for df in dfs for f in df.inputFiles()}
    if not files:
        return 0
    spark = dfs[0].sparkSession
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in (path(spark._jvm.java.net.URI(f)) for f in files))


def partitions(*dfs: DataFrame) -> int:
    """How many partitions the rows of dfs need: one for each PART_BYTES of input, and no fewer than any shuffle has."""
    return max(int(dfs[0].sparkSession.conf.get(PARTITIONS)), -(-input_bytes(*dfs) // PART_BYTES))


def spread(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """df dealt by keys over n (partitions() if not given) where these are more than any shuffle has, else as it is.

    Joins and groups by the keys then need no other shuffle, and what a task sorts or counts does not grow with the input.
    """
    n = n or partitions(df)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get(PARTITIONS)) else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where a local session names none (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^,\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialised(df: DataFrame, finely: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: loops start from a short plan, and lost executors cost nothing.

    finely: its shuffles have partitions(), put together up to 16 MB. The table goes when the driver ends, or before that with dropped().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    given = {CLEAN: "true"}
    if finely:
        given |= {PARTITIONS: str(partitions(df)), "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB"}
    before = {k: spark.conf.get(k, None) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    atexit.register(_drop, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._step = path
    return back


def dropped(*tables: DataFrame | None) -> None:
    """Removes tables of materialised() that no plan reads any more; other tables and None are left alone."""
    for df in tables:
        if path := getattr(df, "_step", None):
            _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before
        pass
