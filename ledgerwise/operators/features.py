"""Features, labels and the train/validation split (survey 2.F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import PAID, as_date
from ..functions.ordering import global_position, running_totals
from .staging import upsert

# Fixed values of the churn features and synthetic labels.
HISTORY_BILLS = 6
RECENT_BILLS = 3
DEFAULT_SPEED_MBPS = 30
TREND_WORSENING, TREND_STABLE, TREND_IMPROVING = "WORSENING", "STABLE", "IMPROVING"
LABEL_WINDOW_DAYS = 30

FEATURE_COLS = ("snapshot_date", "customer_id", "tenure_months", "monthly_fee_current", "package_speed_mbps",
                "late_payment_count_3m", "late_payment_count_6m", "avg_payment_delay_days_3m",
                "payment_status_trend", "downgrade_flag_6m", "batch_id")


def last_n_bills(bills: DataFrame, key: str = "customer_id", n: int = HISTORY_BILLS) -> DataFrame:
    """newest ``n`` billing rows per customer by ``invoice_period`` (rows, not months).

    ``row_number() <= n`` is planned as a partial ``WindowGroupLimit`` before the
    shuffle, so even a customer with a huge history sends at most ``n`` rows
    per task across the network.
    """
    w = Window.partitionBy(key).orderBy(F.desc("invoice_period"), F.desc("customer_key"))
    return bills.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def is_late() -> "F.Column":
    """late = positive delay, or status not exactly ``PAID`` (NULL status is late)."""
    return (F.coalesce(F.col("days_late"), F.lit(0)) > 0) | ~F.col("payment_status").eqNullSafe(PAID)


def bill_features(last_bills: DataFrame, key: str = "customer_id") -> DataFrame:
    """F2-F4 per customer from the (<= 6) newest bills."""
    recent = F.col("rn") <= RECENT_BILLS
    delay = F.when(recent & (F.col("days_late") > 0), F.col("days_late"))
    agg = last_bills.groupBy(key).agg(
        F.count(F.when(recent & is_late(), 1)).alias("late_payment_count_3m"),
        F.count(F.when(is_late(), 1)).alias("late_payment_count_6m"),
        F.coalesce(F.round(F.avg(delay), 1), F.lit(0.0)).alias("avg_payment_delay_days_3m"),
    )
    return agg.withColumn("payment_status_trend", payment_trend(F.col("late_payment_count_3m")))


def payment_trend(late_3m) -> "F.Column":
    """more than one late of the last 3 -> WORSENING, none -> STABLE, one -> IMPROVING."""
    return (F.when(late_3m > 1, TREND_WORSENING).when(late_3m == 0, TREND_STABLE).otherwise(TREND_IMPROVING))


def tenure_months(tenure_days) -> "F.Column":
    """``round(days / 30, 1)`` (NULL days -> 0)."""
    return F.round(F.coalesce(tenure_days, F.lit(0)) / F.lit(30.0), 1)


def package_speed(speed) -> "F.Column":
    """unknown or zero speed -> 30 Mbps."""
    return F.coalesce(F.nullif(speed, F.lit(0)), F.lit(DEFAULT_SPEED_MBPS))


def build_churn_features(snap: DataFrame, dimc: DataFrame, dimp: DataFrame, bills: DataFrame, snapshot_date,
                         batch_id: str, target: DataFrame | None = None, key: str = "natural",
                         downgrades: DataFrame | None = None) -> DataFrame:
    """churn features of one snapshot, upserted on (snapshot_date, customer_id).

    ``key='natural'`` (default) finds a customer's bills through any version of
    the customer, so history survives SCD2 changes; ``key='surrogate'`` uses
    only the snapshot's customer key, as the source system did.
    ``downgrades`` (from ``downgrade_flags``) fills F7; otherwise it is False.
    """
    d = as_date(snapshot_date)
    s = snap.where(F.col("snapshot_date") == d).select("customer_key", "package_key", "tenure_days", "monthly_fee")
    s = s.join(dimc.select("customer_key", "customer_id"), "customer_key")
    s = s.join(dimp.select("package_key", "speed_mbps"), "package_key", "left")
    b = bills.select("customer_key", "invoice_period", "days_late", "payment_status")
    if key == "natural":
        b = b.join(dimc.select("customer_key", "customer_id"), "customer_key")
        feats = bill_features(last_n_bills(b, "customer_id"), "customer_id")
        s = s.join(feats, "customer_id", "left")
    else:
        feats = bill_features(last_n_bills(b.withColumn("ck", F.col("customer_key")), "ck"), "ck")
        s = s.join(feats.withColumnRenamed("ck", "customer_key"), "customer_key", "left")
    if downgrades is not None:
        s = s.join(downgrades.where(F.col("snapshot_date") == d).select("customer_id", "downgrade_flag_6m"),
                   "customer_id", "left")
    else:
        s = s.withColumn("downgrade_flag_6m", F.lit(None).cast("boolean"))
    rows = s.select(
        d.alias("snapshot_date"),
        F.col("customer_id").cast("long").alias("customer_id"),
        tenure_months(F.col("tenure_days")).alias("tenure_months"),
        F.col("monthly_fee").cast("decimal(18,2)").alias("monthly_fee_current"),
        package_speed(F.col("speed_mbps")).cast("int").alias("package_speed_mbps"),
        F.coalesce("late_payment_count_3m", F.lit(0)).cast("int").alias("late_payment_count_3m"),
        F.coalesce("late_payment_count_6m", F.lit(0)).cast("int").alias("late_payment_count_6m"),
        F.coalesce("avg_payment_delay_days_3m", F.lit(0.0)).alias("avg_payment_delay_days_3m"),
        F.coalesce("payment_status_trend", F.lit(TREND_STABLE)).alias("payment_status_trend"),
        F.coalesce("downgrade_flag_6m", F.lit(False)).alias("downgrade_flag_6m"),
        F.lit(str(batch_id)).alias("batch_id"),
        F.col("customer_key").alias("_ck"),
    )
    # One row per (snapshot, customer): the highest customer key wins on a tie.
    rows = rows.groupBy("snapshot_date", "customer_id").agg(F.max_by(F.struct(*FEATURE_COLS[2:]), "_ck").alias("r"))
    rows = rows.select("snapshot_date", "customer_id", "r.*")
    return upsert(target, rows.select(*FEATURE_COLS), ["snapshot_date", "customer_id"])


def downgrade_flags(snapshots: DataFrame, dimc: DataFrame, dimp: DataFrame, months: int = 6,) -> DataFrame:
    """did the customer's package speed fall within the last ``months`` months (30 days each)?

    Without a window per customer: each snapshot gets its position in the
    customer's history from a range-split running count, the previous
    snapshot's speed comes from an equi-join on (customer, position - 1), and a
    range-split running max carries the day of the latest drop forward; the
    flag holds when that day is within the period. (The snapshot fact has one
    row per customer and day.)
    """
    s = snapshots.select("snapshot_date", "customer_key", "package_key").join(
        dimc.select("customer_key", "customer_id"), "customer_key").join(
        dimp.select("package_key", "speed_mbps"), "package_key", "left")
    s = s.select("snapshot_date", "customer_id", "customer_key", "speed_mbps",
                 F.datediff("snapshot_date", F.lit("1970-01-01").cast("date")).alias("_day"), F.lit(1).alias("_one"))
    order = ["_day", "customer_key"]
    n = running_totals(s, order, ["_one"], keys=["customer_id"]).withColumnRenamed(
        "cum__one", "_n")
    prev = n.select(F.col("customer_id").alias("_c"), (F.col("_n") + 1).alias("_m"),
                    F.col("speed_mbps").alias("_prev"))
    j = n.join(prev, F.col("customer_id").eqNullSafe(F.col("_c")) & (F.col("_n") == F.col("_m")), "left")
    dropped = F.coalesce(F.col("speed_mbps") < F.col("_prev"), F.lit(False))
    j = j.select("snapshot_date", "customer_id", "customer_key", "_day",
                 F.when(dropped, F.col("_day")).alias("_drop_day"))
    last = running_totals(j, order, ["_drop_day"], keys=["customer_id"], how="max")
    recent = F.coalesce(F.col("_day") - F.col("cum__drop_day") <= F.lit(months * 30 - 1), F.lit(False))
    return last.select("snapshot_date", F.col("customer_id").cast("long").alias("customer_id"),
                       recent.alias("downgrade_flag_6m"))


def make_churn_labels(feat: DataFrame, snapshot_date, days: int = LABEL_WINDOW_DAYS,
                      target: DataFrame | None = None) -> DataFrame:
    """deterministic synthetic churn labels in ``[snapshot+1, snapshot+days]``.

    Fixed values, rules in order (first match decides): (1) two or more late of the last 3
    and WORSENING, or mean delay >= 20 -> churn if ``id % 10`` in 1..7, on
    ``start + id % 25 + 2``; (2) one late and WORSENING -> ``id % 10 == 8``, +15;
    (3) tenure < 3 months and a late bill -> ``id % 10 == 9``, +20.
    Missing or zero tenure counts as 1.0.
    """
    d = as_date(snapshot_date)
    f = feat.where(F.col("snapshot_date") == d)
    start = F.date_add(d, 1)
    late3 = F.coalesce(F.col("late_payment_count_3m"), F.lit(0))
    delay = F.coalesce(F.col("avg_payment_delay_days_3m"), F.lit(0.0))
    tenure = F.coalesce(F.nullif(F.col("tenure_months"), F.lit(0.0)), F.lit(1.0))
    worsening = F.col("payment_status_trend").eqNullSafe(TREND_WORSENING)
    cid = F.col("customer_id")
    r1 = ((late3 >= 2) & worsening) | (delay >= 20.0)
    r2 = (late3 == 1) & worsening
    r3 = (tenure < 3.0) & (late3 >= 1)
    m10 = F.pmod(cid, F.lit(10))
    churned = (F.when(r1, m10.between(1, 7)).when(r2, m10 == 8).when(r3, m10 == 9).otherwise(F.lit(False)))
    churn_date = (
        F.when(r1 & m10.between(1, 7), F.date_add(start, (F.pmod(cid, F.lit(25)) + 2).cast("int")))
        .when(~r1 & r2 & (m10 == 8), F.date_add(start, 15))
        .when(~r1 & ~r2 & r3 & (m10 == 9), F.date_add(start, 20))
    )
    rows = f.select(
        cid.alias("customer_id"),
        d.alias("feature_snapshot_date"),
        start.alias("label_window_start"),
        F.date_add(d, days).alias("label_window_end"),
        churned.alias("churned"),
        churn_date.alias("churn_date"),
    )
    return upsert(target, rows, ["customer_id", "feature_snapshot_date"])


def feature_label_join(feat: DataFrame, lab: DataFrame) -> DataFrame:
    """features joined to labels of the same snapshot, leakage gate, NULL fills."""
    lab2 = lab.select(F.col("customer_id").alias("_cid"), F.col("feature_snapshot_date").alias("_sd"),
                      "label_window_start", "churned")
    j = feat.join(lab2, (feat.customer_id == lab2._cid) & (feat.snapshot_date == lab2._sd)).where(
        F.col("label_window_start") >= F.col("snapshot_date"))
    return j.select(
        "snapshot_date", "customer_id",
        F.coalesce("tenure_months", F.lit(0.0)).alias("tenure_months"),
        F.coalesce(F.col("monthly_fee_current").cast("double"), F.lit(0.0)).alias("monthly_fee_current"),
        F.coalesce("package_speed_mbps", F.lit(0)).alias("package_speed_mbps"),
        F.coalesce("late_payment_count_3m", F.lit(0)).alias("late_payment_count_3m"),
        F.coalesce("late_payment_count_6m", F.lit(0)).alias("late_payment_count_6m"),
        F.coalesce("avg_payment_delay_days_3m", F.lit(0.0)).alias("avg_payment_delay_days_3m"),
        F.coalesce("payment_status_trend", F.lit(TREND_STABLE)).alias("payment_status_trend"),
        F.coalesce("downgrade_flag_6m", F.lit(False)).alias("downgrade_flag_6m"),
        F.coalesce(F.col("churned").cast("int"), F.lit(0)).alias("label"),
    )


def temporal_split(df: DataFrame, ratio: float = 0.2, order=("snapshot_date", "customer_id"),) -> DataFrame:
    """first ``max(int(n * (1 - ratio)), 1)`` rows (by snapshot, customer) train, rest validation.

    Positions come from ``global_position`` (range sort, no single-task
    window). If validation would be empty it reuses the training rows, which
    then appear twice (once per split), as the source system did.
    """
    pos = global_position(df, list(order), "_pos")
    n = pos.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()  # scalar subquery: one value
    j = pos.withColumn("n", n).withColumn(
        "cut", F.greatest(F.floor(F.col("n") * F.lit(1.0 - ratio)).cast("long"), F.lit(1)))
    split = F.when(F.col("_pos") < F.col("cut"), F.lit("train")).otherwise(F.lit("val"))
    out = j.withColumn("split", split)
    extra = j.where(F.col("n") <= F.col("cut")).withColumn("split", F.lit("val"))
    return out.unionByName(extra).drop("_pos", "n", "cut")


def split_profile(split_df: DataFrame, label: str = "label") -> DataFrame:
    """rows, positives and churn rate (4 dp) per split."""
    return split_df.groupBy("split").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col(label).cast("long")).alias("positives"),
    ).withColumn("churn_rate", F.when(F.col("total") > 0, F.round(F.col("positives") / F.col("total"), 4))
                 .otherwise(F.lit(0.0)))


def build_cashflow_features(cash: DataFrame, invoices: DataFrame, snapshot_date, batch_id: str) -> DataFrame:
    """F8: cash-flow features at a snapshot.

    Current revenue / expense / net = the month of the snapshot (latest month
    at or before it); ``revenue_trend_3m`` = least-squares slope of revenue over
    the newest three months (4 dp); receivables by age at the snapshot:
    <= 30 days (incl. not yet due), 31-90, > 90. The monthly fact has one row
    per month, so the month window is bounded by the calendar.
    """
    d = as_date(snapshot_date)
    months = cash.where(F.col("period_month") <= d)
    w = Window.orderBy(F.desc("period_month"))
    last3 = months.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= 3)
    cur = last3.where(F.col("_k") == 1)
    trend = last3.agg(F.round(F.regr_slope(F.col("total_revenue").cast("double"), (-F.col("_k")).cast("double")), 4)
                      .alias("revenue_trend_3m"))
    age = F.datediff(d, F.col("due_date"))
    open_inv = invoices.where(F.upper("payment_status").isin("UNPAID", "OVERDUE", "PARTIAL")
                              & F.col("due_date").isNotNull())
    ar = open_inv.agg(
        F.coalesce(F.sum(F.when(age <= 30, F.col("total_amount"))), F.lit(0)).cast("double").alias("ar_aging_30"),
        F.coalesce(F.sum(F.when((age > 30) & (age <= 90), F.col("total_amount"))), F.lit(0)).cast("double")
        .alias("ar_aging_60"),
        F.coalesce(F.sum(F.when(age > 90, F.col("total_amount"))), F.lit(0)).cast("double").alias("ar_aging_90plus"))
    return cur.select(
        d.alias("snapshot_date"),
        F.col("total_revenue").cast("double").alias("total_revenue_current"),
        F.col("total_expense").cast("double").alias("total_expense_current"),
        F.col("net_cashflow").cast("double").alias("net_cashflow_current"),
        trend.select("revenue_trend_3m").scalar().alias("revenue_trend_3m"),
        ar.select("ar_aging_30").scalar().alias("ar_aging_30"),
        ar.select("ar_aging_60").scalar().alias("ar_aging_60"),
        ar.select("ar_aging_90plus").scalar().alias("ar_aging_90plus"),
        F.lit(str(batch_id)).alias("batch_id"),
    )
