"""Sources and extraction (survey 2.A).

Extraction is a lazy DataFrame over the source tables: a time window on the
change column, the lookups the records need, and nothing collected. Filters
are written so that Catalyst can push a bare-column form to the scan (Parquet
row-group skipping or the JDBC ``WHERE``), even where the exact rule needs a
``COALESCE``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import as_date, days_between


def _ts(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, dt.datetime):
        v = v.strftime("%Y-%m-%d %H:%M:%S")
    elif isinstance(v, dt.date):
        v = f"{v.isoformat()} 00:00:00"
    return F.lit(str(v)).cast("timestamp_ntz")


# ---- A1 -----------------------------------------------------------------------
JDBC_DRIVERS = {
    "jdbc:postgresql:": "org.postgresql.Driver",
    "jdbc:mysql:": "com.mysql.cj.jdbc.Driver",
}


#: Rows that one task may read over JDBC, and that a partition of a larger table aims at.
ONE_TASK_ROWS, TASK_ROWS = 100_000, 1_000_000
MAX_PARTITIONS = 2_000


def range_predicates(column: str, low, high, parts: int) -> list[str]:
    """``parts`` (at most the span) half-open ranges of a whole-number key, as WHERE conditions. Every
    row meets exactly one: the first takes smaller keys and NULLs, the last larger ones, so rows
    that come after the probe are read too."""
    if low is None or high is None:
        return ["1 = 1"]  # no key is known: an empty table, or NULL keys only
    low, high = int(low), int(high)
    parts = max(1, min(parts, high - low + 1))
    cuts = [low + (high - low + 1) * i // parts for i in range(1, parts)]
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *inner, f"{column} >= {cuts[-1]}"]


# A whole-number hash of any column in the source's own SQL.
KEY_HASHES = {
    "jdbc:postgresql:": "ABS(HASHTEXT(CAST({c} AS TEXT))::BIGINT)",
    "jdbc:mysql:": "CRC32(CAST({c} AS CHAR))",
}


def hash_predicates(url: str, column: str, parts: int) -> list[str]:
    """``parts`` conditions on a hash of ``column``, for text keys and keys that cluster; NULLs are in the first."""
    form = next(f for p, f in KEY_HASHES.items() if url.startswith(p)).format(c=column)
    return [f"MOD({form}, {parts}) = {i}" + (f" OR {column} IS NULL" if i == 0 else "") for i in range(parts)]


def jdbc_plan(url: str, table: str, probe: Callable[[str], tuple], partition_column: str | None = None,
              hash_column: str | None = None, task_rows: int = TASK_ROWS) -> list[str] | None:
    """WHERE conditions of the tasks that read ``table``, or None for a table that one task may read.

    ``probe`` runs a query in the source that returns one row: the row count, and the smallest and
    largest key where a ``partition_column`` is given. A larger table without a column to split it
    by is refused instead of being pulled through one task.
    """
    keys = f", MIN({partition_column}), MAX({partition_column})" if partition_column else ""
    n, *ends = probe(f"SELECT COUNT(*){keys} FROM {table}")
    if n <= ONE_TASK_ROWS:
        return None
    parts = min(MAX_PARTITIONS, -(-n // task_rows))
    if partition_column:
        return range_predicates(partition_column, *ends, parts)
    if hash_column:
        return hash_predicates(url, hash_column, parts)
    raise ValueError(f"{table} has {n} rows: name a partition column or a hash column, one task would read them all")


def jdbc_options(opts: dict) -> dict:
    """The reader's options: the driver class by the URL's prefix (PostgreSQL or MySQL), rows a round trip."""
    driver = next((d for p, d in JDBC_DRIVERS.items() if opts.get("url", "").startswith(p)), None)
    if driver is None:
        raise ValueError(f"unsupported JDBC URL: {opts.get('url', '')[:20]}")
    return {"driver": driver, "fetchsize": "10000", **opts}


def read_source(spark: SparkSession, table: str, fmt: str = "parquet", opts: dict | None = None) -> DataFrame:
    """A1: read-only source table.

    ``fmt='jdbc'``: ``opts`` carries ``url`` and ``partitionColumn`` (a whole-number key) or ``hashColumn``
    (any other); the table's size and key range are asked for first, and the tasks read disjoint
    parts of about ``taskRows`` rows (``jdbc_plan``). With ``lowerBound``, ``upperBound`` and
    ``numPartitions`` given as well nothing is asked. ``table`` may be a name or a parenthesised
    query with an alias. Other formats: ``table`` is a path.
    """
    opts = dict(opts or {})
    if fmt != "jdbc":
        return spark.read.format(fmt).options(**opts).load(table)
    opts = jdbc_options(opts)
    if {"partitionColumn", "lowerBound", "upperBound", "numPartitions"} <= set(opts):
        return spark.read.format("jdbc").option("dbtable", table).options(**opts).load()
    column, hashed = opts.pop("partitionColumn", None), opts.pop("hashColumn", None)
    rows = int(opts.pop("taskRows", TASK_ROWS))

    def probe(query: str) -> tuple:
        return tuple(spark.read.format("jdbc").option("query", query).options(**opts).load().first())

    parts = jdbc_plan(opts["url"], table, probe, column, hashed, rows)
    if parts is None:
        return spark.read.format("jdbc").option("dbtable", table).options(**opts).load()
    properties = {k: v for k, v in opts.items() if k != "url"}
    return spark.read.jdbc(opts["url"], table, predicates=parts, properties=properties)


# ---- A2 / A3 ------------------------------------------------------------------
def last_watermark(batch_log: DataFrame, source_table: str) -> DataFrame:
    """A2: ``watermark_end`` of the newest successful batch (one row, may be NULL)."""
    ok = batch_log.where((F.col("source_table") == source_table) & F.col("status").like("SUCCESS%"))
    return ok.agg(F.max_by("watermark_end", "finished_at").alias("watermark_end"))


def effective_since(override, last_wm, full_refresh: bool = False):
    """A3: explicit override wins, then the last watermark; full refresh -> no bound."""
    if full_refresh:
        return None
    if override is not None:
        return override
    return last_wm


# ---- A4 -----------------------------------------------------------------------
def window_filter(df: DataFrame, since, until, ts_cols=("updated_at",), null_until_passes: bool = False) -> DataFrame:
    """A4: half-open change window ``(since, until]``.

    ``null_until_passes=True`` is the lenient form: a NULL change time passes the
    upper bound and the lower bound is tested on ``COALESCE(ts_cols...)``.
    A redundant bare-column predicate is added so the scan can skip row groups.
    """
    first = F.col(ts_cols[0])
    if null_until_passes:
        cond = first.isNull() | (first <= _ts(until))
        if since is not None:
            coalesced = F.coalesce(*[F.col(c).cast("timestamp_ntz") for c in ts_cols])
            cond = cond & (coalesced > _ts(since)) & (first.isNull() | (first > _ts(since)))
    else:
        cond = first <= _ts(until)
        if since is not None:
            cond = cond & (first > _ts(since))
    return df.where(cond)


def changed_in_window(df: DataFrame, since, until, ts_cols) -> DataFrame:
    """Rows whose first known time lies in ``(since, until]``, and rows without any time.

    The first disjunct is on a bare column, so row groups can be skipped where all are older.
    """
    first, known = F.col(ts_cols[0]), F.coalesce(*[F.col(c).cast("timestamp_ntz") for c in ts_cols])
    inside = known <= _ts(until)
    bare = first.isNull() | (first <= _ts(until))
    if since is not None:
        inside, bare = inside & (known > _ts(since)), bare & (first.isNull() | (first > _ts(since)))
    return df.where(bare & (known.isNull() | inside))


# ---- A5 -----------------------------------------------------------------------
def extract_subscriptions(sub: DataFrame, cust: DataFrame, pkg: DataFrame, since, until,
                          limit: int | None = None) -> DataFrame:
    """A5: subscription records with customer and package attributes.

    The window is applied on the subscriptions before the joins; the package
    catalogue is tiny and AQE broadcasts it by measured size. With ``limit`` the
    rows are the first by id (TakeOrderedAndProject, no global sort).
    """
    s = window_filter(sub, since, until, ("updated_at", "created_at", "start_date"), null_until_passes=True)
    c = cust.select(F.col("id").alias("customer_id"), "customer_name", "city", "installation_date")
    p = pkg.select(F.col("id").alias("package_id"), "package_name", "speed_mbps")
    out = s.join(c, "customer_id", "left").join(p, "package_id", "left").select(
        F.col("id").alias("source_id"),
        "customer_id",
        "customer_name",
        "city",
        "installation_date",
        "package_id",
        "package_name",
        "speed_mbps",
        "subscription_no",
        "start_date",
        "end_date",
        "monthly_fee",
        "billing_day",
        "status",
        F.coalesce(F.col("updated_at"), F.col("created_at"), _ts(until)).alias("source_updated_at"),
    )
    if limit is not None:
        out = out.orderBy("source_id").limit(limit)
    return out


# ---- A6 -----------------------------------------------------------------------
def extract_invoices(inv: DataFrame, sub: DataFrame, pay: DataFrame, since, until, as_of,
                     limit: int | None = None) -> DataFrame:
    """Invoice records with paid amount and days late.

    Successful payments are aggregated per invoice *before* the join (one row
    per invoice crosses the shuffle, whatever the number of payments).
    ``days_late``: last payment after due -> its delay; else open (OVERDUE /
    UNPAID) and past due at ``as_of`` -> days since due; else 0.
    """
    # a row without a change time is never lost: its creation time decides, without either it always passes
    times = [c for c in ("updated_at", "created_at") if c in inv.columns]
    i = changed_in_window(inv, since, until, times)
    paid = normalize_payment_status(pay).where(F.col("payment_status") == "SUCCESS").groupBy(F.col("sales_invoice_id").alias("id")).agg(
        F.sum("amount").alias("paid_sum"), F.max("payment_date").alias("last_paid")
    )
    s = sub.select(F.col("id").alias("customer_subscription_id"), "customer_id")
    j = i.drop("customer_id").join(s, "customer_subscription_id", "left").join(paid, "id", "left")
    asof = as_date(as_of)
    days_late = (
        F.when(F.col("last_paid").isNotNull() & (F.col("last_paid") > F.col("due_date")),
               days_between("last_paid", "due_date"))
        .when(F.col("payment_status").isin("OVERDUE", "UNPAID") & (asof > F.col("due_date")),
              days_between(asof, "due_date"))
        .otherwise(F.lit(0))
    )
    out = j.select(
        F.col("id").alias("source_id"),
        "customer_subscription_id",
        "customer_id",
        "invoice_number",
        "invoice_period",
        "invoice_date",
        "due_date",
        "total_amount",
        "payment_status",
        F.coalesce(F.col("paid_sum"), F.lit(0)).cast("decimal(18,2)").alias("paid_amount"),
        days_late.cast("int").alias("days_late"),
        F.coalesce(*[F.col(c).cast("timestamp_ntz") for c in times], _ts(until)).alias("source_updated_at"),
    )
    if limit is not None:
        out = out.orderBy("source_updated_at", "source_id").limit(limit)
    return out


# ---- A7 -----------------------------------------------------------------------
def extract_payments(pay: DataFrame, since, until, limit: int | None = None) -> DataFrame:
    """Append-only payments, windowed on ``created_at``; a payment without one always passes."""
    p = changed_in_window(normalize_payment_status(pay), since, until, ["created_at"])
    out = p.select(
        F.col("id").alias("source_id"),
        "sales_invoice_id",
        "payment_date",
        "amount",
        "payment_status",
        F.coalesce(F.col("created_at").cast("timestamp_ntz"), _ts(until)).alias("source_created_at"),
    )
    if limit is not None:
        out = out.orderBy("source_created_at", "source_id").limit(limit)
    return out


# ---- A8 / A9 ------------------------------------------------------------------
def normalize_types(df: DataFrame, schema: dict[str, str], session_tz: str = "UTC") -> DataFrame:
    """Cast listed columns to the target type; zone-aware times become naive UTC."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        target = schema.get(f.name)
        if f.dataType.typeName() == "timestamp" and (target in (None, "timestamp_ntz")):
            c = F.to_utc_timestamp(c, session_tz).cast("timestamp_ntz")
        elif target is not None:
            c = c.cast(target)
        cols.append(c.alias(f.name))
    return df.select(cols)


DEFAULT_PAYMENT_STATUS_MAP = {"PAID": "SUCCESS"}


def normalize_payment_status(df: DataFrame, mapping: dict | None = None, col: str = "payment_status") -> DataFrame:
    """Map source-specific success codes onto ``SUCCESS`` (default ``PAID -> SUCCESS``)."""
    mapping = DEFAULT_PAYMENT_STATUS_MAP if mapping is None else mapping
    expr = None
    for k, v in mapping.items():
        cond = F.upper(F.col(col)) == k.upper()
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    if expr is None:
        return df
    return df.withColumn(col, expr.otherwise(F.col(col)))


# ---- A11 / A12 ----------------------------------------------------------------
def extract_journal_lines(je: DataFrame, jel: DataFrame, acct: DataFrame, since, until) -> DataFrame:
    """Journal lines with entry date and account type, windowed on ``entry_date``."""
    e = je.select(F.col("id").alias("journal_entry_id"), "entry_no", "entry_date")
    if since is not None:
        e = e.where(F.col("entry_date") > as_date(since))
    e = e.where(F.col("entry_date") <= as_date(until))
    a = acct.select(F.col("id").alias("account_id"), "account_code", "account_type")
    return jel.join(e, "journal_entry_id").join(a, "account_id").select(
        F.col("id").alias("line_id"), "journal_entry_id", "entry_no", "entry_date", "account_id", "account_code",
        "account_type", "debit", "credit",
    )


def extract_stock(stock: DataFrame, since) -> DataFrame:
    """Stock rows changed after ``since``."""
    return stock if since is None else stock.where(F.col("last_updated") > _ts(since))


# ---- A13 ----------------------------------------------------------------------
def audit_tables(spark: SparkSession, names) -> DataFrame:
    """READY/MISSING and row count per expected table (catalog tables or views).

    The loop runs over table *names* (metadata); the counts themselves are one
    distributed aggregate per existing table, unioned into one result.
    """
    parts = []
    for n in names:
        if spark.catalog.tableExists(n):
            parts.append(spark.table(n).agg(F.count(F.lit(1)).alias("row_count"))
                         .select(F.lit(n).alias("table_name"), F.lit("READY").alias("status"), "row_count"))
        else:
            parts.append(spark.createDataFrame([(n, "MISSING", 0)], "table_name string, status string, row_count long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_summary(tables: DataFrame) -> DataFrame:
    """The rows of ``audit_tables`` with their total from one ``rollup``: rows altogether, tables
    checked, and the names of the missing ones (only tables' names are gathered)."""
    missing = F.array_sort(F.collect_list(F.when(F.col("status") == "MISSING", F.col("table_name"))))
    out = tables.withColumn("name", F.col("table_name")).rollup("name").agg(
        F.grouping("name").alias("_total"), F.max("status").alias("status"), F.sum("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("tables"), missing.alias("missing"))
    total = F.col("_total") == 1
    return out.select(
        F.when(total, "TOTAL").otherwise(F.col("name")).alias("table_name"),
        F.when(total, F.when(F.size("missing") == 0, "READY").otherwise("MISSING")).otherwise(F.col("status")).alias("status"),
        "row_count", "tables", F.array_join("missing", ",").alias("missing_tables"))
