"""Tables kept by partition (survey B4, B5): an upsert reads and rewrites only what it touches.

A table is a folder of plain Parquet, partitioned by one column of few values (a date, a month, a
hash bucket). The partitions to rewrite follow from the incoming rows; every other file stays as
it is, so the bytes of a run follow from its batch and not from the table's history. Old and
incoming rows cross one range shuffle, by partition and key, that serves the upsert and clusters the
files alike. Merged partitions are written beside the table first and then put in place, without a
further shuffle, by Spark's dynamic partition overwrite. A driver that dies in between leaves the
merged rows, and the next run puts them in place again (``recover``): overwriting a partition with
the same rows changes nothing. Partitions that the table does not have yet are written in place at
once: there are no rows to lose.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import staging


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Only "no such folder" means absent; a folder that cannot be reached is an error."""
    p, fs = _path(spark, path)
    return fs.exists(p)


def _rows(path: str) -> str:
    return f"{path.rstrip('/')}/rows"


def read_partitioned(spark: SparkSession, path: str) -> DataFrame | None:
    """The table with its partition column first, or None before its first write."""
    if not exists(spark, _rows(path)):
        return None
    rows = spark.read.parquet(_rows(path))
    return rows.select(rows.columns[-1], *rows.columns[:-1])


def in_partitions(column: str, values) -> Column:
    """A condition on a bare partition column, so that the scan lists only these folders."""
    known = [v for v in values if v is not None]
    cond = F.col(column).isin(known) if known else F.lit(False)
    return cond | F.col(column).isNull() if len(known) < len(values) else cond


def write_snapshot(rows: DataFrame, path: str, part_col: str) -> None:
    """``staging.write_snapshot`` of rows whose tasks hold few partitions each already."""
    staging.write_snapshot(rows, path, part_col, clustered=True)


def merge_partitions(spark: SparkSession, path: str, incoming: DataFrame, keys, part_col: str, order=None,
                     written: bool = False) -> list:
    """Upsert ``incoming`` on ``keys`` (which include ``part_col``, or are unique within a partition).

    Without ``order`` an incoming row replaces the row of its key, as in B4; make ``incoming`` unique
    first. With ``order`` (columns, the last one deciding ties) the newest row of a key within its partition
    wins, whether it is old or incoming, so rows that come late or twice change nothing. Null keys are keys
    like any. ``written``: ``incoming`` only projects written rows, so it is read again rather than written once more.
    Returns the partitions rewritten: their number follows from the batch and is bounded by the calendar
    or the number of buckets.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    recover(spark, path, part_col)
    if not written:
        incoming = materialize(incoming, "incoming")  # read several times below
    values = [r[0] for r in incoming.select(part_col).distinct().collect()]
    if not values:
        return []
    old = None
    if exists(spark, _rows(path)):
        old = spark.read.schema(incoming.schema).parquet(_rows(path)).where(in_partitions(part_col, values))
        old = None if old.isEmpty() else old.select(*incoming.columns)
    if old is None and order is None:
        write_snapshot(incoming.hint("rebalance", part_col), _rows(path), part_col)
        return values
    # incoming rows before old ones of their key, or the newest first; equal ranks only without an order
    merged = incoming.withColumn("_new", F.lit(1))
    if old is not None:
        merged = old.withColumn("_new", F.lit(0)).unionByName(merged)
    by = list(dict.fromkeys([part_col, *keys]))
    newest = [F.desc("_new")] if order is None else [F.desc(c) for c in ([order] if isinstance(order, str) else order)]
    place = F.rank() if order is None else F.row_number()
    merged = merged.repartitionByRange(*by).withColumn("_place", place.over(Window.partitionBy(*by).orderBy(*newest)))
    merged = merged.where("_place = 1").drop("_new", "_place")
    if old is None:
        write_snapshot(merged, _rows(path), part_col)
    else:
        # the folders' column is one more, so that the partition column keeps its type
        merged.withColumn("_folder", F.col(part_col)).write.option("compression", staging.CODEC).partitionBy(
            "_folder").parquet(f"{path.rstrip('/')}/_merge/{uuid.uuid4().hex}")
        recover(spark, path, part_col)
    return values


def recover(spark: SparkSession, path: str, part_col: str) -> None:
    """Put merged partitions in place that a run has written, and drop what it left half-written."""
    p, fs = _path(spark, f"{path.rstrip('/')}/_merge")
    if not fs.exists(p):
        return
    for entry in fs.listStatus(p):
        folder = entry.getPath()
        if fs.exists(_path(spark, f"{folder}/_SUCCESS")[0]):
            write_snapshot(spark.read.parquet(str(folder)).drop("_folder"), _rows(path), part_col)
        fs.delete(folder, True)
