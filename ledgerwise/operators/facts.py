"""Facts (survey 2.E): snapshot and monthly facts with idempotent upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_date, days_between
from .dims import lookup_current
from .staging import dedupe_last, upsert

SUB_SNAPSHOT_COLS = ("snapshot_date", "customer_key", "package_key", "subscription_status", "tenure_days",
                     "monthly_fee", "is_active", "batch_id")
BILLING_COLS = ("invoice_period", "customer_key", "invoiced_amount", "paid_amount", "payment_status", "days_late",
                "batch_id")


def fact_subscription_snapshot(recs: DataFrame, dimc: DataFrame, dimp: DataFrame, snapshot_date, batch_id: str,
                               target: DataFrame | None = None, order=("source_id",)) -> DataFrame:
    """Daily subscription snapshot per (snapshot_date, customer_key).

    Customer key via the current version (miss drops the record), package key
    left-joined; ``tenure_days = max(0, snapshot - coalesce(start, snapshot))``;
    ``is_active`` is a case-sensitive ``status == 'ACTIVE'`` (NULL -> false).
    The last record per key wins, then the result is upserted into ``target``.
    """
    snap = as_date(snapshot_date)
    order = [order] if isinstance(order, str) else list(order)
    r = recs.where(F.col("customer_id").isNotNull())
    r = lookup_current(r, dimc, "customer_id", "customer_key", "inner")
    pk = dimp.where(F.col("is_current")).select(F.col("package_id").cast("long").alias("package_id"), "package_key")
    r = r.withColumn("package_id", F.col("package_id").cast("long")).join(pk, "package_id", "left")
    rows = r.select(
        snap.alias("snapshot_date"),
        "customer_key",
        "package_key",
        F.col("status").alias("subscription_status"),
        F.greatest(F.lit(0), days_between(snap, F.coalesce("start_date", snap))).alias("tenure_days"),
        F.col("monthly_fee").cast("decimal(18,2)").alias("monthly_fee"),
        F.coalesce(F.col("status") == "ACTIVE", F.lit(False)).alias("is_active"),
        F.lit(str(batch_id)).alias("batch_id"),
        *order,
    )
    rows = dedupe_last(rows, ["snapshot_date", "customer_key"], order).select(*SUB_SNAPSHOT_COLS)
    return upsert(target, rows, ["snapshot_date", "customer_key"])


def fact_billing_monthly(inv: DataFrame, dimc: DataFrame, batch_id: str, target: DataFrame | None = None,
                         agg: str = "last", order=("source_updated_at", "source_id")) -> DataFrame:
    """Billing per (invoice_period, customer_key).

    ``agg='last'`` (default, as the source system): the last invoice of the
    period wins and a second subscription's amounts are lost.
    ``agg='sum'``: amounts summed, worst delay kept, status of the last invoice.
    """
    order = [order] if isinstance(order, str) else list(order)
    r = lookup_current(inv.where(F.col("customer_id").isNotNull()), dimc, "customer_id", "customer_key", "inner")
    rows = r.select(
        "invoice_period", "customer_key",
        F.col("total_amount").cast("decimal(18,2)").alias("invoiced_amount"),
        F.col("paid_amount").cast("decimal(18,2)").alias("paid_amount"),
        "payment_status", F.col("days_late").cast("int").alias("days_late"), *order,
    )
    keys = ["invoice_period", "customer_key"]
    if agg == "sum":
        o = F.struct(*[F.col(c) for c in order])
        rows = rows.groupBy(*keys).agg(
            F.sum("invoiced_amount").cast("decimal(18,2)").alias("invoiced_amount"),
            F.sum("paid_amount").cast("decimal(18,2)").alias("paid_amount"),
            F.max_by("payment_status", o).alias("payment_status"),
            F.max("days_late").alias("days_late"),
        )
    else:
        rows = dedupe_last(rows, keys, order, BILLING_COLS[:-1])
    rows = rows.withColumn("batch_id", F.lit(str(batch_id)))  # one for all: not shuffled
    return upsert(target, rows.select(*BILLING_COLS), keys)


# Account types of the chart of accounts and their sign in the cash-flow fact.
REVENUE, EXPENSE, ASSET, LIABILITY = "REVENUE", "EXPENSE", "ASSET", "LIABILITY"


def fact_cashflow_monthly(lines: DataFrame, batch_id: str, ar_code: str = "1101", ap_code: str = "2001") -> DataFrame:
    """Monthly revenue, expense, receivables, payables and net cash flow from journal lines.

    revenue = credit - debit on REVENUE accounts; expense = debit - credit on
    EXPENSE accounts; AR / AP = movement on the receivable / payable accounts;
    net = revenue - expense. One partial-aggregated pass grouped by month.
    """
    d = F.coalesce(F.col("debit"), F.lit(0))
    c = F.coalesce(F.col("credit"), F.lit(0))
    t = F.upper(F.col("account_type"))
    m = lines.groupBy(F.trunc(F.col("entry_date"), "month").alias("period_month")).agg(
        F.sum(F.when(t == REVENUE, c - d).otherwise(0)).alias("total_revenue"),
        F.sum(F.when(t == EXPENSE, d - c).otherwise(0)).alias("total_expense"),
        F.sum(F.when(F.col("account_code") == ar_code, d - c).otherwise(0)).alias("accounts_receivable"),
        F.sum(F.when(F.col("account_code") == ap_code, c - d).otherwise(0)).alias("accounts_payable"),
    )
    return m.select(
        "period_month",
        *[F.col(x).cast("decimal(18,2)").alias(x) for x in
          ("total_revenue", "total_expense", "accounts_receivable", "accounts_payable")],
        (F.col("total_revenue") - F.col("total_expense")).cast("decimal(18,2)").alias("net_cashflow"),
        F.lit(str(batch_id)).alias("batch_id"),
    )


def fact_inventory_snapshot(stock: DataFrame, snapshot_date, batch_id: str) -> DataFrame:
    """Quantity on hand per (snapshot_date, warehouse, item) from stock rows.

    The latest stock row per (warehouse, item) at or before the snapshot wins.
    """
    snap = as_date(snapshot_date)
    s = stock.where(F.to_date("last_updated") <= snap)
    last = dedupe_last(s.select("warehouse_id", "item_id", "quantity", "last_updated"),
                       ["warehouse_id", "item_id"], ["last_updated"])
    return last.select(
        snap.alias("snapshot_date"), "warehouse_id", "item_id",
        F.col("quantity").cast("long").alias("quantity_on_hand"), F.lit(str(batch_id)).alias("batch_id"),
    )
