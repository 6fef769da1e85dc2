"""Audit / follow-up tables (survey 2.I): joins plus top-k.

Pattern used throughout: aggregate the fact rows (invoices, payments) by the
join key *before* the join, so each join shuffles at most one row per
subscription or invoice, then join the small current-customer side and take
the top rows with ``orderBy(...).limit(n)`` (planned as
``TakeOrderedAndProject``: a per-task top-k, no global sort). Ties are broken
by the natural key so every run returns the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    ACTIVE,
    OVERDUE_STATUSES,
    SUCCESS,
    UNPAID_STATUSES,
    as_date,
    cust_code,
    day_text,
    days_between,
    days_text,
    rupiah,
    upper_eq,
    upper_in,
)

DEFAULT_LIMIT = 20
INVOICE_LIMIT = 25


def _current_customers(t: dict) -> DataFrame:
    return t["dim_customer"].where(F.col("is_current"))


def _subs(t: dict) -> DataFrame:
    return t["stg_customer_subscription"]


def _limit(df: DataFrame, n):
    return df if n is None else df.limit(n)


def revenue_at_risk(t: dict, as_of, limit=DEFAULT_LIMIT) -> DataFrame:
    """Customers with unpaid invoices past due: count, sum, max days late."""
    asof = as_date(as_of)
    inv = t["stg_sales_invoice"].where(
        upper_in("payment_status", *UNPAID_STATUSES) & F.col("due_date").isNotNull() & (F.col("due_date") < asof)
    )
    per_sub = inv.groupBy(F.col("customer_subscription_id").alias("source_id")).agg(
        F.count("id").alias("n"), F.sum("total_amount").alias("amt"), F.min("due_date").alias("oldest_due")
    )
    joined = per_sub.join(_subs(t).select("source_id", "customer_id"), "source_id").join(
        _current_customers(t).select("customer_id", "customer_name", "city"), "customer_id"
    )
    out = joined.groupBy("customer_id", "customer_name", "city").agg(
        F.sum("n").alias("overdue_invoices"),
        F.coalesce(F.sum("amt"), F.lit(0)).cast("double").alias("total_overdue"),
        F.coalesce(days_between(asof, F.min("oldest_due")), F.lit(0)).cast("bigint").alias("max_days_late"),
    ).select(
        "customer_id", "customer_name", F.coalesce("city", F.lit("N/A")).alias("city"),
        "overdue_invoices", "total_overdue", "max_days_late",
    )
    return _limit(out.orderBy(F.desc("total_overdue"), "customer_id"), limit)


def top_unpaid(t: dict, limit=DEFAULT_LIMIT) -> DataFrame:
    """Customers ranked by unpaid amount (no due-date filter), latest due date."""
    inv = t["stg_sales_invoice"].where(upper_in("payment_status", *UNPAID_STATUSES))
    per_sub = inv.groupBy(F.col("customer_subscription_id").alias("source_id")).agg(
        F.count("id").alias("n"), F.sum("total_amount").alias("amt"), F.max("due_date").alias("latest_due")
    )
    joined = per_sub.join(_subs(t).select("source_id", "customer_id"), "source_id").join(
        _current_customers(t).select("customer_id", "customer_name", "city"), "customer_id"
    )
    out = joined.groupBy("customer_id", "customer_name", "city").agg(
        F.sum("n").alias("unpaid_invoices"),
        F.coalesce(F.sum("amt"), F.lit(0)).cast("double").alias("total_unpaid_ar"),
        day_text(F.max("latest_due")).alias("latest_due_date"),
    )
    return _limit(out.orderBy(F.desc("total_unpaid_ar"), "customer_id"), limit)


def commercial_revenue_at_risk(t: dict, as_of, limit=DEFAULT_LIMIT) -> DataFrame:
    """ACTIVE subscriptions with UNPAID/OVERDUE invoices past due, with package and fee."""
    asof = as_date(as_of)
    inv = t["stg_sales_invoice"].where(
        upper_in("payment_status", *OVERDUE_STATUSES) & F.col("due_date").isNotNull() & (F.col("due_date") < asof)
    )
    per_sub = inv.groupBy(F.col("customer_subscription_id").alias("source_id")).agg(
        F.sum("total_amount").alias("amt"), F.min("due_date").alias("oldest_due")
    )
    subs = _subs(t).where(upper_eq("status", ACTIVE)).select("source_id", "customer_id", "package_id", "monthly_fee")
    pkg = t["dim_package"].where(F.col("is_current")).select("package_id", "package_name")
    joined = (
        per_sub.join(subs, "source_id")
        .join(_current_customers(t).select("customer_id", "customer_name"), "customer_id")
        .join(pkg, "package_id", "left")
    )
    out = joined.groupBy("customer_id", "customer_name", "package_name", "monthly_fee").agg(
        F.coalesce(F.sum("amt"), F.lit(0)).cast("double").alias("overdue_amount"),
        F.coalesce(days_between(asof, F.min("oldest_due")), F.lit(0)).cast("bigint").alias("days_overdue"),
    ).select(
        "customer_id",
        "customer_name",
        F.coalesce("package_name", F.lit("Broadband")).alias("package_name"),
        F.coalesce(F.col("monthly_fee").cast("double"), F.lit(0.0)).alias("monthly_fee"),
        "overdue_amount",
        "days_overdue",
    )
    return _limit(out.orderBy(F.desc("overdue_amount"), "customer_id", "package_name", "monthly_fee"), limit)


def customers_without_sub(t: dict, limit=DEFAULT_LIMIT) -> DataFrame:
    """I4: current customers with no ACTIVE subscription (anti join), by customer id."""
    active = _subs(t).where(upper_eq("status", ACTIVE)).select("customer_id")
    out = _current_customers(t).join(active, "customer_id", "left_anti").select(
        "customer_id",
        "customer_name",
        "city",
        F.col("status").alias("customer_status"),
        day_text("installation_date").alias("installation_date"),
    )
    return _limit(out.orderBy("customer_id"), limit)


def top_revenue(t: dict, limit=DEFAULT_LIMIT) -> DataFrame:
    """Customers by successful payments: subscriptions paid on, total paid."""
    pay = t["stg_sales_payment"].where(upper_eq("payment_status", SUCCESS))
    per_inv = pay.groupBy(F.col("sales_invoice_id").alias("inv_id")).agg(F.sum("amount").alias("paid"))
    inv = t["stg_sales_invoice"].select(F.col("source_id").alias("inv_id"), "customer_subscription_id")
    per_sub = per_inv.join(inv, "inv_id").groupBy(F.col("customer_subscription_id").alias("source_id")).agg(
        F.sum("paid").alias("paid")
    )
    joined = per_sub.join(_subs(t).select("source_id", "id", "customer_id"), "source_id").join(
        _current_customers(t).select("customer_id", "customer_name", "city"), "customer_id"
    )
    out = joined.groupBy("customer_id", "customer_name", "city").agg(
        F.count_distinct("id").alias("active_subs"),
        F.coalesce(F.sum("paid"), F.lit(0)).cast("double").alias("total_paid"),
    )
    return _limit(out.orderBy(F.desc("total_paid"), "customer_id"), limit)


def overdue_invoices(t: dict, as_of, limit=INVOICE_LIMIT) -> DataFrame:
    """UNPAID/OVERDUE invoices past due, largest first (NULL amounts first)."""
    asof = as_date(as_of)
    inv = t["stg_sales_invoice"].where(
        upper_in("payment_status", *OVERDUE_STATUSES) & F.col("due_date").isNotNull() & (F.col("due_date") < asof)
    )
    joined = inv.join(
        _subs(t).select(F.col("source_id").alias("customer_subscription_id"), "customer_id"),
        "customer_subscription_id",
    ).join(_current_customers(t).select("customer_id", "customer_name"), "customer_id")
    out = joined.select(
        "invoice_number",
        "customer_name",
        day_text("invoice_date").alias("invoice_date"),
        day_text("due_date").alias("due_date"),
        F.coalesce(F.col("total_amount").cast("double"), F.lit(0.0)).alias("total_amount"),
        F.coalesce(days_between(asof, "due_date"), F.lit(0)).cast("bigint").alias("days_overdue"),
        "payment_status",
        F.col("total_amount").alias("_raw_amount"),
        F.col("id").alias("_id"),
    )
    out = out.orderBy(F.desc_nulls_first("_raw_amount"), "_id")
    return _limit(out, limit).drop("_raw_amount", "_id")


def payment_discrepancies(t: dict, limit=INVOICE_LIMIT) -> DataFrame:
    """Invoices whose total exceeds their successful payments, by balance."""
    pay = t["stg_sales_payment"].where(upper_eq("payment_status", SUCCESS))
    per_inv = pay.groupBy(F.col("sales_invoice_id").alias("source_id")).agg(F.sum("amount").alias("paid"))
    inv = t["stg_sales_invoice"].select("id", "source_id", "invoice_number", "customer_subscription_id",
                                        "total_amount", "payment_status")
    joined = (
        inv.join(_subs(t).select(F.col("source_id").alias("customer_subscription_id"), "customer_id"),
                 "customer_subscription_id")
        .join(_current_customers(t).select("customer_id", "customer_name"), "customer_id")
        .join(per_inv, "source_id", "left")
    )
    paid = F.coalesce(F.col("paid"), F.lit(0))
    out = joined.where(F.col("total_amount") > paid).select(
        "invoice_number",
        "customer_name",
        F.coalesce(F.col("total_amount"), F.lit(0)).cast("double").alias("total_amount"),
        paid.cast("double").alias("paid_amount"),
        F.coalesce(F.col("total_amount") - paid, F.lit(0)).cast("double").alias("balance_due"),
        "payment_status",
        F.col("id").alias("_id"),
    )
    return _limit(out.orderBy(F.desc("balance_due"), "_id"), limit).drop("_id")


def quality_audit_table(dq_log: DataFrame, limit=DEFAULT_LIMIT) -> DataFrame:
    """Newest data-quality checks for display."""
    out = dq_log.select(
        "check_name",
        "table_name",
        "status",
        F.coalesce("details", F.lit("Semua baris memenuhi aturan validasi")).alias("details"),
        F.date_format("checked_at", "yyyy-MM-dd HH:mm").alias("checked_at"),
        F.col("checked_at").alias("_ts"),
        F.col("id").alias("_id"),
    )
    return _limit(out.orderBy(F.desc("_ts"), F.desc("_id")), limit).drop("_ts", "_id")


# Fixed values (I9): table name aliases per domain (trimmed, lower-cased); unknown -> domain default.
AUDIT_ALIASES = {
    "overview": {
        "default": "revenue_at_risk_overview",
        "data_quality": "data_quality", "data_quality_alerts": "data_quality", "alerts": "data_quality",
    },
    "commercial": {
        "default": "top_unpaid",
        "revenue_at_risk": "revenue_at_risk_commercial", "risk": "revenue_at_risk_commercial",
        "no_sub": "customers_without_sub", "customers_without_sub": "customers_without_sub",
        "without_sub": "customers_without_sub",
        "top_revenue": "top_revenue", "top_revenue_customers": "top_revenue",
    },
    "finance": {
        "default": "overdue_invoices",
        "discrepancies": "payment_discrepancies", "payment_completeness": "payment_discrepancies",
        "completeness": "payment_discrepancies",
    },
}


def resolve_audit_table(domain: str, name: str | None) -> str:
    aliases = AUDIT_ALIASES[domain]
    key = (name or "").strip().lower()
    return aliases.get(key, aliases["default"])


def audit_table(t: dict, domain: str, name: str | None, as_of, dq_log: DataFrame | None = None) -> DataFrame:
    """Pick an audit table by domain and (alias) name."""
    which = resolve_audit_table(domain, name)
    if which == "revenue_at_risk_overview":
        return revenue_at_risk(t, as_of)
    if which == "data_quality":
        if dq_log is None:
            raise ValueError("data_quality table needs the quality log")
        return quality_audit_table(dq_log)
    if which == "revenue_at_risk_commercial":
        return commercial_revenue_at_risk(t, as_of)
    if which == "customers_without_sub":
        return customers_without_sub(t)
    if which == "top_revenue":
        return top_revenue(t)
    if which == "top_unpaid":
        return top_unpaid(t)
    if which == "payment_discrepancies":
        return payment_discrepancies(t)
    return overdue_invoices(t, as_of)


def display_top_unpaid(t: dict, limit=DEFAULT_LIMIT) -> DataFrame:
    """I2 with display columns (``CUST-0001``, ``Rp 1,234``, ``N/A``)."""
    df = top_unpaid(t, limit)
    return df.select(
        cust_code("customer_id").alias("customer_id"),
        "customer_name",
        "city",
        "unpaid_invoices",
        rupiah("total_unpaid_ar").alias("total_unpaid_ar"),
        F.coalesce("latest_due_date", F.lit("N/A")).alias("latest_due_date"),
    )


def display_revenue_at_risk(t: dict, as_of, limit=DEFAULT_LIMIT) -> DataFrame:
    """I1 with display columns (``n hari``)."""
    df = revenue_at_risk(t, as_of, limit)
    return df.select(
        cust_code("customer_id").alias("customer_id"),
        "customer_name",
        "city",
        "overdue_invoices",
        rupiah("total_overdue").alias("total_overdue"),
        days_text("max_days_late").alias("max_days_late"),
    )
