"""Chart datasets (survey 2.H): grouped aggregates over the warehouse tables.

Group keys here have few values (months, packages, cities, buckets), so one
key can hold a large share of all rows. Every plan aggregates partially inside
each task before the shuffle, and dimension lookups happen *after* the
aggregation, on the reduced rows, so no hot key is ever shuffled row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    ACTIVE,
    OVERDUE_STATUSES,
    SUCCESS,
    UNPAID_STATUSES,
    VAT_RATE,
    as_date,
    days_between,
    money_sum,
    month_key,
    upper_eq,
    upper_in,
)

# Bucket labels of the charts (as shown to the user).
AGING_LABELS_3 = ("0–30 Hari", "31–60 Hari", "60+ Hari")
AGING_LABELS_4 = ("0–30 Hari", "31–60 Hari", "61–90 Hari", "90+ Hari")
TENURE_LABELS = ("< 6 Bulan", "6–12 Bulan", "1–2 Tahun", "> 2 Tahun")
PAYMENT_METHODS_BY_ID_MOD3 = ("Bank Transfer", "Virtual Account", "Auto-Debit")
OTHER_CITY = "Lainnya"
PACKAGE_FALLBACK_PREFIX = "Paket "
BILLING_DAY_PREFIX = "Tgl "


def revenue_vs_payment(t: dict) -> DataFrame:
    """H1: monthly invoiced FULL OUTER monthly collected, missing side = 0."""
    inv = (
        t["stg_sales_invoice"].where(F.col("invoice_date").isNotNull())
        .groupBy(month_key("invoice_date").alias("month"))
        .agg(F.sum("total_amount").alias("invoiced"))
    )
    pay = (
        t["stg_sales_payment"].where(F.col("payment_date").isNotNull() & upper_eq("payment_status", SUCCESS))
        .groupBy(month_key("payment_date").alias("month"))
        .agg(F.sum("amount").alias("collected"))
    )
    return (
        inv.join(pay, "month", "full")
        .select(
            "month",
            F.coalesce(F.col("invoiced"), F.lit(0)).cast("double").alias("invoiced"),
            F.coalesce(F.col("collected"), F.lit(0)).cast("double").alias("collected"),
        )
        .orderBy("month")
    )


def customer_growth(t: dict) -> DataFrame:
    """H2: current customers per month of installation (or validity start)."""
    d = t["dim_customer"].where(F.col("is_current"))
    return (
        d.groupBy(month_key(F.coalesce("installation_date", "valid_from")).alias("month"))
        .agg(F.count("customer_id").alias("new_customers"))
        .orderBy("month")
    )


def customer_growth_cumulative(t: dict) -> DataFrame:
    """H3: H2 plus the running total in month order.

    The window has no partition key, but it runs on the grouped result,
    which holds one row per month (bounded by the calendar, not the data).
    """
    g = customer_growth(t)
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.withColumn("cumulative_customers", F.sum("new_customers").over(w)).orderBy("month")


def package_mix(t: dict) -> DataFrame:
    """H4: ACTIVE subscriptions per current package (name or ``Paket <id>``).

    Subscriptions are aggregated per package id first; the package dimension
    is joined to that handful of rows, so the hot package keys never shuffle.
    """
    s = t["stg_customer_subscription"].where(upper_eq("status", ACTIVE))
    per_id = s.groupBy("package_id").agg(
        F.count("id").alias("subscriptions"), F.sum("monthly_fee").alias("total_mrr")
    )
    p = t["dim_package"].where(F.col("is_current")).select("package_id", "package_name")
    named = per_id.join(p, "package_id", "left").select(
        F.coalesce(
            F.col("package_name"), F.concat(F.lit(PACKAGE_FALLBACK_PREFIX), F.col("package_id").cast("string"))
        ).alias("package_name"),
        "subscriptions",
        "total_mrr",
    )
    return (
        named.groupBy("package_name")
        .agg(
            F.sum("subscriptions").alias("subscriptions"),
            F.coalesce(F.sum("total_mrr"), F.lit(0)).cast("double").alias("total_mrr"),
        )
        .orderBy(F.desc("subscriptions"), "package_name")
    )


def mrr_per_package(t: dict) -> DataFrame:
    """H5: projection of H4."""
    return package_mix(t).select("package_name", "total_mrr")


def customers_per_city(t: dict) -> DataFrame:
    """H6: current customers per city; unknown city -> ``Lainnya``."""
    d = t["dim_customer"].where(F.col("is_current"))
    return (
        d.groupBy(F.coalesce("city", F.lit(OTHER_CITY)).alias("city"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "city")
    )


def ar_aging(t: dict, as_of, bounds=(30, 60), labels=AGING_LABELS_3, split_current: bool = False) -> DataFrame:
    """H7 (bounds 30, 60) / H8 (bounds 30, 60, 90): unpaid invoices by age since due date.

    Age is ``as_of - due_date``; not-yet-due invoices fall in the first bucket
    unless ``split_current`` gives them their own ``Belum Jatuh Tempo`` bucket.
    """
    if len(labels) != len(bounds) + 1:
        raise ValueError("need one label more than bounds")
    i = t["stg_sales_invoice"].where(upper_in("payment_status", *UNPAID_STATUSES) & F.col("due_date").isNotNull())
    age = days_between(as_date(as_of), "due_date")
    bucket = None
    for b, lab in zip(bounds, labels):
        bucket = F.when(age <= b, lab) if bucket is None else bucket.when(age <= b, lab)
    bucket = bucket.otherwise(labels[-1])
    if split_current:
        bucket = F.when(age < 0, F.lit("Belum Jatuh Tempo")).otherwise(bucket)
    return (
        i.groupBy(bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("count"), money_sum("total_amount").alias("amount"))
        .orderBy("bucket")
    )


def installations_per_month(t: dict) -> DataFrame:
    """H9: current customers with an installation date, per month."""
    d = t["dim_customer"].where(F.col("is_current") & F.col("installation_date").isNotNull())
    return d.groupBy(month_key("installation_date").alias("month")).agg(F.count(F.lit(1)).alias("count")).orderBy("month")


def billing_day_concentration(t: dict) -> DataFrame:
    """ACTIVE subscriptions per billing day, label ``Tgl n``, numeric order."""
    s = t["stg_customer_subscription"].where(F.col("billing_day").isNotNull() & upper_eq("status", ACTIVE))
    return (
        s.groupBy(F.col("billing_day").alias("day_num"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            F.concat(F.lit(BILLING_DAY_PREFIX), F.col("day_num").cast("string")).alias("billing_day"),
            "day_num",
            "count",
        )
        .orderBy("day_num")
    )


def tenure_distribution(t: dict, as_of) -> DataFrame:
    """ACTIVE subscriptions by age since start (<180, <365, <730 days, else)."""
    s = t["stg_customer_subscription"].where(F.col("start_date").isNotNull() & upper_eq("status", ACTIVE))
    age = days_between(as_date(as_of), "start_date")
    bucket = (
        F.when(age < 180, TENURE_LABELS[0]).when(age < 365, TENURE_LABELS[1])
        .when(age < 730, TENURE_LABELS[2]).otherwise(TENURE_LABELS[3])
    )
    return (
        s.groupBy(bucket.alias("tenure_bucket"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "tenure_bucket")
    )


def overdue_trend(t: dict) -> DataFrame:
    """UNPAID/OVERDUE invoices by due month: amount and count."""
    i = t["stg_sales_invoice"].where(upper_in("payment_status", *OVERDUE_STATUSES) & F.col("due_date").isNotNull())
    return (
        i.groupBy(month_key("due_date").alias("due_month"))
        .agg(money_sum("total_amount").alias("overdue_amount"), F.count(F.lit(1)).alias("count"))
        .orderBy("due_month")
    )


def tax_trend(t: dict) -> DataFrame:
    """VAT share of the invoiced amount per invoice month.

    ``sum(total) * 0.11 / 1.11`` equals the per-row form exactly in real
    arithmetic and is independent of summation order.
    """
    i = t["stg_sales_invoice"].where(F.col("invoice_date").isNotNull())
    return (
        i.groupBy(month_key("invoice_date").alias("month"))
        .agg((money_sum("total_amount") * F.lit(VAT_RATE) / F.lit(1.0 + VAT_RATE)).alias("tax_amount"))
        .orderBy("month")
    )


def payment_method_mix(t: dict, method_col: str | None = None) -> DataFrame:
    """Successful payments per method.

    Without ``method_col`` the method is derived from ``source_id % 3`` as the
    dashboards do; pass ``method_col='payment_method'`` for the real column.
    """
    p = t["stg_sales_payment"].where(upper_eq("payment_status", SUCCESS))
    if method_col is None:
        m = F.pmod(F.col("source_id"), F.lit(3))
        method = (
            F.when(m == 0, PAYMENT_METHODS_BY_ID_MOD3[0]).when(m == 1, PAYMENT_METHODS_BY_ID_MOD3[1])
            .otherwise(PAYMENT_METHODS_BY_ID_MOD3[2])
        )
    else:
        method = F.col(method_col)
    return (
        p.groupBy(method.alias("method"))
        .agg(F.count(F.lit(1)).alias("transactions"), money_sum("amount").alias("total_amount"))
        .orderBy(F.desc("total_amount"), "method")
    )


def to_long(df: DataFrame, id_cols, value_cols, variable: str = "tipe", value: str = "amount") -> DataFrame:
    """Wide -> long for grouped bars (``DataFrame.unpivot``)."""
    return df.unpivot(list(id_cols), list(value_cols), variable, value)
