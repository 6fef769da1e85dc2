"""Staging, idempotent upsert, snapshot writes and the batch log (survey 2.B).

State lives in plain Parquet: there is no MERGE, so an upsert is
``target ANTI JOIN incoming-keys UNION incoming`` and the result is written to
a *new* version folder (never over the folder being read). "Last row per key"
is an aggregate (``max_by`` over a struct) rather than a window, so a hot key
is reduced inside each task before the shuffle instead of being sorted whole
in one task.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Of the files that jobs write: about a quarter smaller than Spark's default codec makes them.
CODEC = "zstd"

# ---- B1 / B2 --------------------------------------------------------------------
SUBSCRIPTION_STAGE_COLS = ("source_id", "customer_id", "package_id", "subscription_no", "start_date", "end_date",
                           "monthly_fee", "billing_day", "status", "source_updated_at")
INVOICE_STAGE_COLS = ("source_id", "customer_subscription_id", "invoice_number", "invoice_period", "invoice_date",
                      "due_date", "total_amount", "payment_status", "source_updated_at")
PAYMENT_STAGE_COLS = ("source_id", "sales_invoice_id", "payment_date", "amount", "payment_status",
                      "source_created_at")


def _stage(df: DataFrame, cols, batch_id: str, loaded_at) -> DataFrame:
    return df.select(
        *cols,
        F.lit(str(batch_id)).alias("batch_id"),
        F.lit(_ts_text(loaded_at)).cast("timestamp_ntz").alias("loaded_at"),
    )


def _ts_text(v) -> str:
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(v, dt.date):
        return f"{v.isoformat()} 00:00:00"
    return str(v)


def stage_subscriptions(records: DataFrame, batch_id: str, loaded_at) -> DataFrame:
    """B1: project the subscription record to staging columns plus batch metadata."""
    return _stage(records, SUBSCRIPTION_STAGE_COLS, batch_id, loaded_at)


def stage_invoices(records: DataFrame, batch_id: str, loaded_at) -> DataFrame:
    """B2: invoice staging (``paid_amount``, ``days_late``, ``customer_id`` are not staged)."""
    return _stage(records, INVOICE_STAGE_COLS, batch_id, loaded_at)


def stage_payments(records: DataFrame, batch_id: str, loaded_at) -> DataFrame:
    """B2: payment staging."""
    return _stage(records, PAYMENT_STAGE_COLS, batch_id, loaded_at)


# ---- B6 / B3 --------------------------------------------------------------------
def dedupe_last(df: DataFrame, keys, order, columns=None) -> DataFrame:
    """Keep the last row per ``keys`` by ``order`` (a column name or list).

    ``order`` must make rows unique within a key (add the natural id last). With ``columns`` (``keys``
    among them) only these are kept, so the order's columns cross the shuffle once and not twice.
    Implemented as ``groupBy(keys).agg(max_by(struct(row), struct(order)))``:
    partial aggregation keeps one row per key per task before the shuffle.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    columns = list(columns or df.columns)
    others = [c for c in columns if c not in keys]
    order_struct = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    if not others:
        return df.select(*keys).distinct()
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*others), order_struct).alias("_last"))
    return picked.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others]).select(*columns)


def dedupe_first(df: DataFrame, keys, order) -> DataFrame:
    """First row per key by ``order`` (``min_by``), e.g. the first package row of a batch."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    others = [c for c in df.columns if c not in keys]
    order_struct = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*others), order_struct).alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in others]).select(*df.columns)


def latest_by_source(stg: DataFrame, key: str = "source_id", order=("loaded_at", "batch_id")) -> DataFrame:
    """One row per source id, the newest load; repeated full loads no longer double totals.

    A row number rather than ``dedupe_last``: columns that the caller does not read are not shuffled
    (a struct would carry all of them), and each task still sends one row per key only.
    """
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return stg.withColumn("_newest", F.row_number().over(newest)).where("_newest = 1").drop("_newest")


# ---- B4 -------------------------------------------------------------------------
def upsert(target: DataFrame | None, incoming: DataFrame, keys, dedupe_order=None) -> DataFrame:
    """``INSERT ... ON CONFLICT (keys) DO UPDATE`` as a DataFrame.

    Rows of ``target`` whose key is in ``incoming`` are replaced; other target
    rows stay. ``incoming`` is made unique per key first when ``dedupe_order``
    is given (B6). The anti join shuffles only the key columns of ``incoming``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if dedupe_order is not None:
        incoming = dedupe_last(incoming, keys, dedupe_order)
    if target is None:
        return incoming
    kept = target.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(incoming.select(*target.columns))


# ---- B5 -------------------------------------------------------------------------
def write_snapshot(df: DataFrame, path: str, part_col: str, clustered: bool = False) -> None:
    """Replace only the date partitions present in ``df`` (dynamic overwrite).

    Rows are clustered by the partition column with a ``rebalance`` hint, not
    ``repartition(col)``: a plain hash repartition would send a whole snapshot
    date - often all of the rows - to one task, while AQE splits rebalanced
    partitions above the advisory size across tasks (and merges small ones),
    so each task writes few, evenly sized files. ``clustered`` rows need no such
    shuffle. Never point ``path`` at a folder the same plan reads
    (``partitioned.merge_partitions`` writes beside it first).
    """
    spark = df.sparkSession
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows = df if clustered else df.hint("rebalance", part_col)
        rows.write.mode("overwrite").option("compression", CODEC).partitionBy(part_col).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)


class StateStore:
    """The jobs' tables under one shared root folder.

    Facts and current staging rows grow with history and are kept by partition: ``merge(name, ...)``
    rewrites only the partitions of its rows. The small tables that a job replaces as a whole (the two
    dimensions, waiting invoices) are versioned: ``write(name, df)`` writes ``<root>/<name>/v=<n>`` and then appends a
    one-row pointer file under ``<root>/<name>/_current`` (written last, so a
    lost job leaves the previous version current). The pointer folder is
    append-only - the current version is the highest committed pointer - so
    no step ever deletes the pointer that readers follow. ``read(name)``
    follows it. Writing a new version never touches the version being read,
    so ``upsert`` on a table that feeds its own next version is safe.
    """

    def __init__(self, spark: SparkSession, root: str, period: str = "yyyy-MM"):
        """``period``: pattern of the periods that partition current staging rows. Months, so that a batch of
        recent changes rewrites little; longer ones where a month is only a few files' rows."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.period = period

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/_current"

    def _exists(self, path: str) -> bool:
        """Only "no such folder" means absent; a folder that cannot be reached is an error."""
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)

    def current_version(self, name: str) -> int | None:
        if not self._exists(self._pointer(name)):
            return None
        row = self.spark.read.schema("version int").json(self._pointer(name)).agg(F.max("version")).first()
        return None if row[0] is None else int(row[0])

    def merge(self, name: str, incoming: DataFrame, keys, part_col: str, order=None, written: bool = False) -> list:
        """``partitioned.merge_partitions`` on the table ``name``."""
        from .partitioned import merge_partitions

        return merge_partitions(self.spark, f"{self.root}/{name}", incoming, keys, part_col, order, written)

    def read(self, name: str) -> DataFrame | None:
        from .partitioned import read_partitioned

        merged = read_partitioned(self.spark, f"{self.root}/{name}")
        if merged is not None:
            return merged
        v = self.current_version(name)
        if v is None:
            return None
        return self.spark.read.parquet(f"{self.root}/{name}/v={v}")

    def write(self, name: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        v = (self.current_version(name) or 0) + 1
        path = f"{self.root}/{name}/v={v}"
        w = df.write.option("compression", CODEC).mode("errorifexists")  # a second writer of this version fails instead of mixing rows
        if self._exists(path) and not self._exists(f"{path}/_SUCCESS"):
            w = w.mode("overwrite")  # what a lost job left half-written
        if partition_by:
            w = w.partitionBy(partition_by)
        w.parquet(path)
        self.spark.createDataFrame([(v,)], "version int").coalesce(1).write.mode("append").json(
            self._pointer(name))
        return self.spark.read.parquet(path)

    def append(self, name: str, df: DataFrame) -> None:
        """Append-only tables (staging, logs): new files under ``<root>/<name>/log``."""
        df.write.mode("append").option("compression", CODEC).parquet(f"{self.root}/{name}/log")

    def read_log(self, name: str) -> DataFrame | None:
        path = f"{self.root}/{name}/log"
        return self.spark.read.parquet(path) if self._exists(path) else None


# ---- B7 / B8 --------------------------------------------------------------------
BATCH_LOG_SCHEMA = ("batch_id string, source_table string, watermark_start timestamp_ntz, "
                    "watermark_end timestamp_ntz, row_count long, status string, started_at timestamp_ntz, "
                    "finished_at timestamp_ntz, event_at timestamp_ntz")


def _marker(is_mock: bool) -> str:
    return " [MOCK]" if is_mock else " [LIVE]"


def _naive(v):
    if v is None:
        return None
    if isinstance(v, dt.datetime):
        if v.tzinfo is not None:
            v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return v
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day)
    return v


def start_batch(spark: SparkSession, source_table: str, watermark_start, watermark_end, is_mock: bool = False,
                now: dt.datetime | None = None, batch_id: str | None = None) -> DataFrame:
    """The RUNNING event row of a new batch (append it to the batch log)."""
    now = _naive(now or dt.datetime.now(dt.timezone.utc))
    bid = batch_id or str(uuid.uuid4())
    row = (bid, source_table, _naive(watermark_start), _naive(watermark_end), None,
           f"RUNNING{_marker(is_mock)}", now, None, now)
    return spark.createDataFrame([row], BATCH_LOG_SCHEMA)


def finish_batch(start_row: DataFrame, row_count, status: str = "SUCCESS", is_mock: bool = False,
                 now: dt.datetime | None = None, error: str | None = None) -> DataFrame:
    """The closing event row. ``row_count`` may be a Column (e.g. an observed count).

    Status is ``SUCCESS`` / ``FAILED: <whole message>`` plus the marker `` [MOCK]`` / `` [LIVE]``,
    never cut (``status_label`` shortens it for display). An empty extract still finishes
    ``SUCCESS`` with 0 rows.
    """
    now = _naive(now or dt.datetime.now(dt.timezone.utc))
    text = f"FAILED: {error}" if error is not None else status
    label = f"{text}{_marker(is_mock)}"
    rc = row_count if isinstance(row_count, Column) else F.lit(row_count)
    return start_row.select(
        "batch_id", "source_table", "watermark_start", "watermark_end",
        rc.cast("long").alias("row_count"),
        F.lit(label).alias("status"),
        "started_at",
        F.lit(now).cast("timestamp_ntz").alias("finished_at"),
        F.lit(now).cast("timestamp_ntz").alias("event_at"),
    )


def status_label(status: Column, width: int = 50) -> Column:
    """A status for display: at most ``width`` characters, the marker always whole."""
    mark = F.regexp_extract(status, r" \[(?:MOCK|LIVE)\]$", 0)
    return F.concat(F.substring(status, F.lit(1), F.least(F.length(status), F.lit(width)) - F.length(mark)), mark)


def batch_log_view(events: DataFrame) -> DataFrame:
    """Current state per batch: the newest event row of each ``batch_id``."""
    return dedupe_last(events, "batch_id", ["event_at", F.col("finished_at").isNotNull()]).drop("event_at")


def batch_history(log: DataFrame, limit: int | None = 20) -> DataFrame:
    """Newest batches first, ``is_mock`` flag, NULL row count -> 0."""
    out = log.select(
        "batch_id", "source_table", "watermark_start", "watermark_end", "status",
        F.col("status").endswith("[MOCK]").alias("is_mock_data"),
        F.coalesce(F.col("row_count"), F.lit(0)).cast("long").alias("row_count"),
        "started_at", "finished_at",
    ).orderBy(F.desc("started_at"), "batch_id")
    return out if limit is None else out.limit(limit)
