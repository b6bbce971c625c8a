"""Tables in the folder that driver and executors share, and positions over whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Unset on one machine (as in tests) it is one of our own, on a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by ``sweep``."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a table to the shared folder and read it again, so that lost executors cost no earlier work."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spindrift_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    mine = _written.get(spark.sparkContext.applicationId, [])
    if path in mine:
        mine.remove(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_spindrift_path", None):
            _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> int:
    """Delete every table that this application wrote here and still stands: for when its results have been read. Returns how many."""
    paths = list(_written.get(spark.sparkContext.applicationId, ()))
    for path in paths:
        _delete(spark, path)
    return len(paths)


def numbered(df: DataFrame, *by: str, name: str = "position") -> DataFrame:
    """df with its rows' positions from 0 in the order of ``by``, which should tell rows apart.

    The rows are dealt by ranges, sorted and written once with their partition
    and their place in it, so that counts and rows come from the same partitions
    however adaptive execution deals them. One row a partition is summed up in
    one task; nothing else is. Columns ``_m``, ``_p`` and ``_b`` are taken.
    """
    t = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    n = t.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    base = n.select("_p", F.coalesce(before, F.lit(0)).alias("_b"))
    out = t.withColumn("_p", part).join(F.broadcast(base), "_p").withColumn(name, F.col("_b") + row).drop("_p", "_b", "_m")
    out._spindrift_path = t._spindrift_path
    return out
