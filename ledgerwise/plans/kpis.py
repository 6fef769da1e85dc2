"""KPI plans (survey 2.G).

Each table is scanned once per domain: all KPIs over one table share one
global aggregate (partial aggregation per task, one tiny final merge). KPIs
that need two tables are combined through scalar subqueries, each of which is
a one-value result, so no row-level data ever meets across tables here.

``t`` is a dict of DataFrames with the keys produced by
``ledgerwise.sources.bridge.warehouse_tables`` (or by the sync jobs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    ACTIVE,
    CHURN_PROXY_STATUSES,
    SUCCESS,
    UNPAID_STATUSES,
    VAT_RATE,
    as_date,
    days_between,
    money_sum,
    safe_ratio,
    upper_eq,
    upper_in,
)


def customer_kpis(t: dict) -> DataFrame:
    """G1: distinct current customers whose (subscription) status is ACTIVE."""
    d = t["dim_customer"]
    return d.where(upper_eq("status", ACTIVE) & F.col("is_current")).agg(
        F.count_distinct("customer_id").alias("active_customers")
    )


def subscription_kpis(t: dict, as_of) -> DataFrame:
    """G2, G3, G9, G10 in one pass over the subscriptions."""
    s = t["stg_customer_subscription"]
    active = upper_eq("status", ACTIVE)
    tenure = F.when(active & F.col("start_date").isNotNull(), days_between(as_of_col(as_of), "start_date"))
    return s.agg(
        F.count(F.when(active, 1)).alias("active_subscriptions"),
        money_sum(F.when(active, F.col("monthly_fee"))).alias("mrr"),
        (F.coalesce(F.avg(tenure), F.lit(0.0)) / F.lit(30.0)).alias("avg_tenure_months"),
        F.count(F.when(upper_in("status", *CHURN_PROXY_STATUSES), 1)).alias("churn_proxy"),
    )


def invoice_kpis(t: dict) -> DataFrame:
    """G4, G11 in one pass over the invoices."""
    i = t["stg_sales_invoice"]
    return i.agg(
        F.count(F.lit(1)).alias("count_invoices"),
        money_sum("total_amount").alias("total_invoiced"),
        F.count(F.when(upper_eq("payment_status", "PARTIAL"), 1)).alias("partial_invoices"),
        money_sum(F.when(upper_in("payment_status", *UNPAID_STATUSES), F.col("total_amount"))).alias("unpaid_ar"),
    )


def payment_kpis(t: dict) -> DataFrame:
    """Successful payments (count and sum)."""
    p = t["stg_sales_payment"]
    return p.where(upper_eq("payment_status", SUCCESS)).agg(
        F.count(F.lit(1)).alias("count_payments"),
        money_sum("amount").alias("total_paid"),
    )


def unpaid_customers(t: dict) -> DataFrame:
    """Distinct customers owning a subscription with an unpaid invoice.

    The invoice side is reduced to its distinct subscription ids before the
    join, so the shuffle carries one row per subscription, not per invoice.
    """
    inv = t["stg_sales_invoice"].where(upper_in("payment_status", *UNPAID_STATUSES))
    subs_with_debt = inv.select(F.col("customer_subscription_id").alias("source_id")).distinct()
    s = t["stg_customer_subscription"].select("source_id", "customer_id")
    return subs_with_debt.join(s, "source_id").agg(F.count_distinct("customer_id").alias("unpaid_customers"))


def dso(t: dict) -> DataFrame:
    """Mean days from invoice to successful payment (payment weighted)."""
    p = t["stg_sales_payment"].where(
        upper_eq("payment_status", SUCCESS) & F.col("payment_date").isNotNull()
    ).select(F.col("sales_invoice_id").alias("source_id"), "payment_date")
    i = t["stg_sales_invoice"].where(F.col("invoice_date").isNotNull()).select("source_id", "invoice_date")
    return p.join(i, "source_id").agg(
        F.coalesce(F.avg(days_between("payment_date", "invoice_date")), F.lit(0.0)).alias("dso_days")
    )


def as_of_col(as_of):
    return as_date(as_of)


def _scalar(df: DataFrame, name: str):
    return df.select(name).scalar().alias(name)


def health_score(rate):
    """``round(clamp(rate*0.8+15, 50, 100), 1)``."""
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(50.0), rate * 0.8 + 15.0)), 1)


def overview_kpis(t: dict, as_of) -> DataFrame:
    """G1, G3, G4, G5, G6, G7 as one row."""
    inv = invoice_kpis(t)
    pay = payment_kpis(t)
    base = subscription_kpis(t, as_of).select("mrr")
    row = base.select(
        _scalar(customer_kpis(t), "active_customers"),
        "mrr",
        _scalar(pay, "total_paid").alias("net_cashflow"),
        _scalar(inv, "unpaid_ar"),
        _scalar(inv, "total_invoiced"),
    )
    row = row.withColumn("collection_rate", safe_ratio(F.col("net_cashflow"), F.col("total_invoiced"), 100.0))
    return row.withColumn("health_score", health_score(F.col("collection_rate")))


def commercial_kpis(t: dict, as_of) -> DataFrame:
    """G1, G2, G3, G8, G9, G10 as one row."""
    base = subscription_kpis(t, as_of)
    return base.select(
        _scalar(customer_kpis(t), "active_customers"),
        "active_subscriptions",
        "mrr",
        _scalar(unpaid_customers(t), "unpaid_customers"),
        "avg_tenure_months",
        "churn_proxy",
    )


def finance_kpis(t: dict) -> DataFrame:
    """G4, G5, G6, G11, G12, G13, G14 as one row."""
    inv = invoice_kpis(t)
    pay = payment_kpis(t)
    row = inv.select(
        "count_invoices",
        "total_invoiced",
        "partial_invoices",
        F.col("unpaid_ar").alias("outstanding_ar"),
        _scalar(pay, "count_payments"),
        _scalar(pay, "total_paid"),
        _scalar(dso(t), "dso_days"),
    )
    return row.select(
        "*",
        F.col("total_paid").alias("net_cashflow"),
        safe_ratio(F.col("total_paid"), F.col("total_invoiced"), 100.0).alias("collection_rate"),
        (F.col("total_invoiced") * F.lit(VAT_RATE) / F.lit(1.0 + VAT_RATE)).alias("tax_collected"),
        safe_ratio(F.col("partial_invoices"), F.col("count_invoices"), 100.0).alias("partial_payment_rate"),
    )


# Status thresholds of the KPI cards.
AR_WARNING_ABOVE = 50_000_000
COLLECTION_GOOD_FROM = 80.0
UNPAID_CUSTOMERS_WARNING_ABOVE = 5
CHURN_PROXY_GOOD_BELOW = 10
DSO_GOOD_UPTO = 30
HIGH_RISK_CRITICAL_ABOVE = 10
ARPU_WARNING_BELOW = 300_000


def kpi_status(key: str, value):
    """Status of one KPI value (a Column) by the card thresholds."""
    good, warning, critical = F.lit("good"), F.lit("warning"), F.lit("critical")
    if key in ("unpaid_ar", "outstanding_ar"):
        return F.when(value > AR_WARNING_ABOVE, warning).otherwise(good)
    if key == "collection_rate":
        return F.when(value >= COLLECTION_GOOD_FROM, good).otherwise(warning)
    if key == "unpaid_customers":
        return F.when(value > UNPAID_CUSTOMERS_WARNING_ABOVE, warning).otherwise(good)
    if key == "churn_proxy":
        return F.when(value < CHURN_PROXY_GOOD_BELOW, good).otherwise(warning)
    if key == "dso":
        return F.when(value <= DSO_GOOD_UPTO, good).otherwise(warning)
    if key == "high_churn_risk_count":
        return F.when(value > HIGH_RISK_CRITICAL_ABOVE, critical).when(value > 0, warning).otherwise(good)
    if key == "arpu":
        return F.when(value < ARPU_WARNING_BELOW, warning).otherwise(good)
    return good


# ---- G18 / G19 -------------------------------------------------------------------
# Labels and units of the overview cards.
OVERVIEW_CARDS = [
    ("health_score", "Indeks Kesehatan Operasional", "score"),
    ("active_customers", "Pelanggan Aktif", "customers"),
    ("mrr", "Monthly Recurring Revenue", "IDR"),
    ("net_cashflow", "Net Operating Cash Flow", "IDR"),
    ("unpaid_ar", "Total Piutang Belum Tertagih", "IDR"),
    ("collection_rate", "Tingkat Penagihan (Collection Rate)", "%"),
]


def kpi_rows(wide: DataFrame, cards=OVERVIEW_CARDS) -> DataFrame:
    """One wide KPI row -> long rows (key, label, value, formatted, unit, status)."""
    parts = []
    for key, label, unit in cards:
        v = F.col(key).cast("double")
        if unit == "IDR":
            text = F.concat(F.lit("Rp "), F.format_number(v, 0))
        elif unit == "%":
            text = F.concat(F.format_number(v, 1), F.lit("%"))
        elif unit == "score":
            text = F.concat(F.format_number(v, 1), F.lit(" / 100"))
        else:
            text = F.format_number(v, 0)
        parts.append(F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), v.alias("value"),
                              text.alias("formatted_value"), F.lit(unit).alias("unit"),
                              kpi_status(key, v).alias("status")))
    return wide.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def period_change(monthly: DataFrame, value_col: str, month_col: str = "month") -> DataFrame:
    """Month-over-month change in percent (NULL for the first month or a zero base).

    The window runs over the monthly series (one row per month), not over data rows.
    """
    w = Window.orderBy(month_col)
    prev = F.lag(value_col).over(w)
    return monthly.select(month_col, value_col, prev.alias("previous"),
                          F.when(prev != 0, (F.col(value_col) - prev) / F.abs(prev) * 100.0).alias("change_pct"))


# ---- G17, G18: cards with change and trend ---------------------------------------
# Fixed values: (key, column of the wide row, label, unit, what follows the number, has thresholds).
COMMERCIAL_CARDS = [
    ("active_customers", "active_customers", "Pelanggan Aktif", "customers", " Akun", False),
    ("active_subscriptions", "active_subscriptions", "Langganan Aktif", "subscriptions", " Layanan", False),
    ("mrr", "mrr", "Monthly Recurring Revenue (MRR)", "IDR", "", False),
    ("unpaid_customers", "unpaid_customers", "Pelanggan Menunggak", "customers", " Pelanggan", True),
    ("avg_tenure", "avg_tenure_months", "Rata-Rata Lama Berlangganan (Tenure)", "months", " Bulan", False),
    ("churn_proxy", "churn_proxy", "Churn / Nonaktif Proxy", "subscriptions", " Layanan", True),
]
FINANCE_CARDS = [
    ("net_cashflow", "net_cashflow", "Net Operating Cash Flow", "IDR", "", False),
    ("total_invoiced", "total_invoiced", "Total Tagihan Diterbitkan", "IDR", "", False),
    ("total_paid", "total_paid", "Total Penerimaan Kas Masuk", "IDR", "", False),
    ("outstanding_ar", "outstanding_ar", "Outstanding Piutang (AR)", "IDR", "", True),
    ("collection_rate", "collection_rate", "Collection Rate", "%", "%", False),
    ("dso", "dso_days", "Days Sales Outstanding (DSO)", "days", " Hari", True),
    ("tax_collected", "tax_collected", "Estimasi Pajak PPN (11%)", "IDR", "", False),
    ("partial_payment_rate", "partial_payment_rate", "Rasio Pembayaran Sebagian", "%", "%", False),
]
OVERVIEW_TREND_CARDS = [
    ("health_score", "health_score", "Indeks Kesehatan Operasional", "score", " / 100", False),
    ("active_customers", "active_customers", "Pelanggan Aktif", "customers", " Pelanggan", False),
    ("mrr", "mrr", "Monthly Recurring Revenue", "IDR", "", False),
    ("net_cashflow", "net_cashflow", "Net Operating Cash Flow", "IDR", "", False),
    ("unpaid_ar", "unpaid_ar", "Total Piutang Belum Tertagih", "IDR", "", True),
    ("collection_rate", "collection_rate", "Tingkat Penagihan (Collection Rate)", "%", "%", True),
]
# Digits shown by unit; all others show whole numbers.
DIGITS = {"%": 1, "days": 1, "months": 1, "score": 1}


def known_by(t: dict, day) -> dict:
    """The tables cut to rows dated until ``day``: customers by installation, subscriptions by
    start, invoices and payments by their date. Undated rows stay; statuses are today's, as
    the source keeps no status history."""
    dated = {"dim_customer": "installation_date", "stg_customer_subscription": "start_date",
             "stg_sales_invoice": "invoice_date", "stg_sales_payment": "payment_date"}
    return t | {name: t[name].where(F.col(col).isNull() | (F.col(col) <= as_date(day))) for name, col in dated.items()}


def card_rows(now: DataFrame, before: DataFrame, cards) -> DataFrame:
    """Cards of one wide KPI row, with the change in percent and the trend against an
    earlier row (change NULL where the earlier value is zero or missing; trend ``up``, ``down`` or ``flat``).
    Two one-row tables meet here, whatever the size of the data."""
    def long(wide, is_now):
        return wide.select(F.posexplode(F.array(*[F.col(c).cast("double") for _, c, *_ in cards])).alias("pos", "v"),
                           F.lit(is_now).alias("is_now"))

    both = long(now, True).unionByName(long(before, False)).groupBy("pos").agg(
        F.max(F.when(F.col("is_now"), F.col("v"))).alias("v"), F.max(F.when(~F.col("is_now"), F.col("v"))).alias("was"))

    def pick(of):
        return F.element_at(F.array(*[of(c) for c in cards]), F.col("pos") + 1)

    v, was = F.col("v"), F.col("was")
    unit = pick(lambda c: F.lit(c[3]))
    digits = pick(lambda c: F.lit(DIGITS.get(c[3], 0)))
    shown = F.when(digits == 1, F.bround(v, 1)).otherwise(F.when(pick(lambda c: F.lit(c[0])) == "tax_collected",
                                                               F.bround(v, 0)).otherwise(v))
    return both.select(
        F.col("pos").alias("position"),
        pick(lambda c: F.lit(c[0])).alias("key"),
        pick(lambda c: F.lit(c[2])).alias("label"),
        shown.alias("value"),
        F.concat(F.when(unit == "IDR", F.lit("Rp ")).otherwise(F.lit("")),
                 F.when(digits == 1, F.format_number(v, 1)).otherwise(F.format_number(v, 0)),
                 pick(lambda c: F.lit(c[4]))).alias("formatted_value"),
        unit.alias("unit"),
        F.when(was != 0, (v - was) / F.abs(was) * 100.0).alias("change_percentage"),
        F.when(v > was, F.lit("up")).when(v < was, F.lit("down")).otherwise(F.lit("flat")).alias("trend"),
        pick(lambda c: kpi_status(c[0], v) if c[5] else F.lit("good")).alias("status"),
    )


def commercial_cards(t: dict, as_of) -> DataFrame:
    """G18, commercial: every card, against the rows known one month earlier."""
    day = F.add_months(as_date(as_of), -1)
    return card_rows(commercial_kpis(t, as_of), commercial_kpis(known_by(t, day), day), COMMERCIAL_CARDS)


def finance_cards(t: dict, as_of) -> DataFrame:
    """G18, finance: every card, against the rows known one month earlier."""
    return card_rows(finance_kpis(t), finance_kpis(known_by(t, F.add_months(as_date(as_of), -1))), FINANCE_CARDS)


def overview_cards(t: dict, as_of) -> DataFrame:
    """G18, overview: every card, against the rows known one month earlier."""
    day = F.add_months(as_date(as_of), -1)
    return card_rows(overview_kpis(t, as_of), overview_kpis(known_by(t, day), day), OVERVIEW_TREND_CARDS)
