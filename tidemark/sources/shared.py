"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; where that is unset, a temporary folder for one local process only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def moved_into(spark: SparkSession, path: str, folder: str, name: str) -> None:
    """Put the folder ``path`` into ``folder`` as ``name``, by one rename."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place(folder))
    if not fs.rename(place(path), place(f"{folder}/{name}")):
        raise OSError(f"could not rename {path} to {folder}/{name}")


_STORED: dict[tuple, tuple] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of a table's files, so that a changed table is noticed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(folder)))


def stored(spark: SparkSession, name: str, inputs: list[str], build, day: str, order: list[str]) -> DataFrame:
    """The table that ``build`` gives, written once in a session by day partitions (sorted by ``order`` in each file) for as
    long as its ``inputs`` stay as they are, and read from there; ``day`` is the SQL expression of a row's day, which comes
    back as ``part_day``: filter by it to read some days only."""
    key = (spark.sparkContext.applicationId, name, *((path, _files(spark, path)) for path in inputs))
    path, schema = _STORED.get(key, (None, None))
    if path is not None:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):  # the shared folder was cleared
            path = None
    if path is None:
        rows, path = build().drop("part_day").withColumn("part_day", F.expr(day).cast("long")), shared_path(spark, name)
        rows.hint("rebalance", "part_day").sortWithinPartitions("part_day", *order).write.partitionBy("part_day").parquet(path)
        schema = rows.schema
        _STORED[key] = path, schema
    return spark.read.schema(schema).parquet(path)
