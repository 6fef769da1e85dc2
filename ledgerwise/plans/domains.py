"""Other business domains (survey 2.L): finance ratios, procurement, inventory, assets, tickets.

The source system only documents these formulas (its code returns constants);
here they run on tables derived from the driver data (``domain_tables``):
vendor = supplier, purchase line = lineitem (ordered on the order date,
received on the ship date), stock ledger = lineitem (out = quantity, returned
lines come back in; item = part, warehouse = supplier % 5), asset = part
(size as the temperature reading), ticket = event (type as category,
value / 60 as hours).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import ACTIVE, SUCCESS, UNPAID_STATUSES, as_date, days_between, upper_eq, upper_in
from ..functions.ordering import running_totals
from ..sources import bridge

# Targets and cut-offs of the domain KPIs.
PO_TARGET_DAYS = 30          # target receipt = order date + 30 days
VENDOR_RISK_DEVIATION = 14   # mean deviation above 14 days flags a vendor
OTD_TARGET = 90.0
STOCKOUT_CRITICAL_DAYS = 14
OVER_TEMPERATURE_C = 35
MTTR_TARGET_HOURS = 3.0
SLA_HOURS = 4.0
SLA_TARGET = 95.0
WAREHOUSES = 5
OPENING_STOCK = 20.0     # units on hand per (warehouse, item) before the first ledger row


def domain_tables(spark: SparkSession, sf_dir: str) -> dict:
    li = bridge.read_raw(spark, sf_dir, "lineitem")
    orders = bridge.read_raw(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    po_lines = li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("po_id"), F.col("l_suppkey").alias("vendor_id"), F.col("l_partkey").alias("item_id"),
        F.to_date("o_orderdate").alias("order_date"), F.to_date("l_shipdate").alias("receipt_date"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("line_total"))
    ledger = li.select(
        F.pmod(F.col("l_suppkey"), F.lit(WAREHOUSES)).cast("int").alias("warehouse_id"),
        F.col("l_partkey").alias("item_id"),
        F.to_date("l_shipdate").alias("day"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(F.lit(0.0)).alias("qty_in"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(F.lit(0.0)).alias("qty_out"),
        F.col("l_orderkey"), F.col("l_linenumber"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
    )
    return {"po_lines": po_lines, "ledger": ledger, "part": bridge.read_raw(spark, sf_dir, "part"),
            "events": bridge.read_raw(spark, sf_dir, "events"), "supplier": bridge.read_raw(spark, sf_dir, "supplier")}


# ---- L1-L3: finance --------------------------------------------------------------
def composite_health(scores: DataFrame, weights: dict | None = None) -> DataFrame:
    """L1: ``sum(w * score) / sum(w)`` over the domain score columns present (equal weights by default)."""
    cols = list(weights) if weights else scores.columns
    w = weights or {c: 1.0 for c in cols}
    num = sum((F.coalesce(F.col(c), F.lit(0.0)) * F.lit(float(w[c])) for c in cols), F.lit(0.0))
    den = sum((F.when(F.col(c).isNotNull(), F.lit(float(w[c]))).otherwise(F.lit(0.0)) for c in cols), F.lit(0.0))
    return scores.select("*", F.when(den > 0, num / den).otherwise(F.lit(None)).alias("health_index"))


# Weights of the six domains in the health index; the source leaves them open, so they are a parameter.
DOMAIN_WEIGHTS = {"finance": 0.25, "commercial": 0.20, "procurement": 0.15, "inventory": 0.15, "assets": 0.10, "service": 0.15}


def domain_scores(t: dict, dt: dict, as_of) -> DataFrame:
    """L1: one row with a score from 0 to 100 for each domain, NULL for a domain without rows.

    finance: collected share of what is due; commercial: active share of the subscriptions;
    procurement: lines received on time; inventory: items not about to run out; assets: healthy
    share; service: tickets solved in time. Each is an aggregate of its own tables, put side
    by side as scalars.
    """
    def share(df, part, whole, name):
        p, w = F.sum(part).cast("double"), F.sum(whole).cast("double")
        return df.agg(F.when(w > 0, p / w * 100.0).alias(name))

    one = F.lit(1)
    active = F.when(upper_eq("status", ACTIVE), 1).otherwise(0)
    sound = F.when(F.col("stockout_risk"), 0).otherwise(1)
    done = vendor_performance(dt["po_lines"])
    tickets = sla_compliance(dt["events"])
    scores = [
        share(t["stg_customer_subscription"], active, one, "commercial"),
        share(done, F.col("on_time_lines"), F.col("completed_lines"), "procurement"),
        share(stockout_runway(dt["ledger"], as_of), sound, one, "inventory"),
        asset_health(dt["part"]).agg(F.max("healthy_asset_ratio").alias("assets")),
        share(tickets, F.col("met"), F.col("met") + F.col("breached"), "service"),
    ]
    finance = collection_efficiency(t, as_of).select(
        F.when(F.col("amount_due") > 0, F.col("collection_efficiency")).alias("finance"))
    return finance.select("finance", *[s.scalar().alias(s.columns[0]) for s in scores])


def collection_efficiency(t: dict, as_of) -> DataFrame:
    """L2: collected on invoices already due / amount of invoices already due x 100."""
    due = t["stg_sales_invoice"].where(F.col("due_date") <= as_date(as_of)).select("source_id", "total_amount")
    paid = t["stg_sales_payment"].where(upper_eq("payment_status", SUCCESS)).groupBy(
        F.col("sales_invoice_id").alias("source_id")).agg(F.sum("amount").alias("paid"))
    j = due.join(paid, "source_id", "left")
    agg = j.agg(F.coalesce(F.sum("paid"), F.lit(0)).cast("double").alias("collected_due"),
                F.coalesce(F.sum("total_amount"), F.lit(0)).cast("double").alias("amount_due"))
    return agg.withColumn("collection_efficiency", F.when(F.col("amount_due") > 0,
                                                          F.col("collected_due") / F.col("amount_due") * 100.0)
                          .otherwise(F.lit(0.0)))


def ar_aging_60_ratio(t: dict, as_of) -> DataFrame:
    """L3: receivables older than 60 days past due / all receivables x 100."""
    i = t["stg_sales_invoice"].where(upper_in("payment_status", *UNPAID_STATUSES))
    old = F.when(days_between(as_date(as_of), "due_date") > 60, F.col("total_amount"))
    agg = i.agg(F.coalesce(F.sum(old), F.lit(0)).cast("double").alias("ar_over_60"),
                F.coalesce(F.sum("total_amount"), F.lit(0)).cast("double").alias("ar_total"))
    return agg.withColumn("ar_aging_60_ratio", F.when(F.col("ar_total") > 0,
                                                      F.col("ar_over_60") / F.col("ar_total") * 100.0)
                          .otherwise(F.lit(0.0)))


# ---- L4-L6: procurement --------------------------------------------------------------
def po_lead_times(po_lines: DataFrame, target_days: int = PO_TARGET_DAYS) -> DataFrame:
    """L4: per purchase order: mean lead time (receipt - order) and deviation of the last receipt from target."""
    return po_lines.groupBy("po_id").agg(
        F.avg(days_between("receipt_date", "order_date")).alias("avg_lead_time_days"),
        days_between(F.max("receipt_date"), F.date_add(F.min("order_date"), target_days)).alias("deviation_days"),
    )


def vendor_performance(po_lines: DataFrame, target_days: int = PO_TARGET_DAYS) -> DataFrame:
    """Per vendor: on-time rate of received lines (target 90 %), mean deviation, risk flag (> 14 d)."""
    dev = days_between("receipt_date", F.date_add(F.col("order_date"), target_days))
    done = po_lines.where(F.col("receipt_date").isNotNull())
    g = done.groupBy("vendor_id").agg(
        F.count(F.lit(1)).alias("completed_lines"),
        F.count(F.when(dev <= 0, 1)).alias("on_time_lines"),
        F.avg(dev).alias("avg_deviation_days"),
    )
    return g.select(
        "vendor_id", "completed_lines", "on_time_lines",
        (F.col("on_time_lines") / F.col("completed_lines") * 100.0).alias("otd_rate"),
        "avg_deviation_days",
        (F.col("on_time_lines") / F.col("completed_lines") * 100.0 >= OTD_TARGET).alias("meets_target"),
        (F.col("avg_deviation_days") > VENDOR_RISK_DEVIATION).alias("vendor_risk"),
    )


# ---- L7-L11: inventory ----------------------------------------------------------------
def consumption_rate(ledger: DataFrame, as_of, window_days: int = 365) -> DataFrame:
    """Mean daily ``qty_out`` per (warehouse, item) over a calendar window (days without movement count as 0)."""
    end = as_date(as_of)
    w = ledger.where((F.col("day") > F.date_sub(end, window_days)) & (F.col("day") <= end))
    return w.groupBy("warehouse_id", "item_id").agg(
        (F.sum("qty_out") / F.lit(float(window_days))).alias("daily_rate"))


def stock_on_hand(ledger: DataFrame, as_of) -> DataFrame:
    """Stock per (warehouse, item) at ``as_of``: opening stock of the item plus ins minus outs."""
    led = ledger.where(F.col("day") <= as_date(as_of))
    return led.groupBy("warehouse_id", "item_id").agg(
        (F.lit(OPENING_STOCK) + F.sum("qty_in") - F.sum("qty_out")).alias("stock_qty"),
        F.max_by("unit_price", F.struct("day", "l_orderkey", "l_linenumber")).alias("last_unit_price"))


def stockout_runway(ledger: DataFrame, as_of, window_days: int = 365) -> DataFrame:
    """Days of stock left = stock / daily rate (rate 0 -> NULL); <= 14 days -> critical.

    Stock on hand (L10's inputs too) and the consumption rate of L7 come from
    one grouped pass over the ledger - the window rows are a conditional sum -
    instead of two aggregations of the same rows joined on the item key.
    """
    end = as_date(as_of)
    led = ledger.where(F.col("day") <= end)
    in_window = F.col("day") > F.date_sub(end, window_days)
    s = led.groupBy("warehouse_id", "item_id").agg(
        (F.lit(OPENING_STOCK) + F.sum("qty_in") - F.sum("qty_out")).alias("stock_qty"),
        F.max_by("unit_price", F.struct("day", "l_orderkey", "l_linenumber")).alias("last_unit_price"),
        (F.sum(F.when(in_window, F.col("qty_out"))) / F.lit(float(window_days))).alias("daily_rate"))
    runway = F.try_divide(F.greatest(F.col("stock_qty"), F.lit(0.0)), F.nullif(F.col("daily_rate"), F.lit(0.0)))
    return s.select("warehouse_id", "item_id", "stock_qty", F.coalesce("daily_rate", F.lit(0.0)).alias("daily_rate"),
                    runway.alias("runway_days"),
                    F.coalesce(runway <= STOCKOUT_CRITICAL_DAYS, F.lit(False)).alias("stockout_risk"),
                    "last_unit_price")


def depletion_projection(runway: DataFrame, horizon_days: int = 30, safety_stock: float = 0.0) -> DataFrame:
    """Projected stock per future day (floored at 0) for at-risk items, against a safety stock."""
    r = runway.where(F.col("stockout_risk"))
    days = r.select("warehouse_id", "item_id", "stock_qty", "daily_rate",
                    F.explode(F.sequence(F.lit(1), F.lit(horizon_days))).alias("day_ahead"))
    remaining = F.greatest(F.lit(0.0), F.col("stock_qty") - F.col("daily_rate") * F.col("day_ahead"))
    return days.select("warehouse_id", "item_id", "day_ahead", remaining.alias("projected_qty"),
                       (remaining < F.lit(safety_stock)).alias("below_safety"))


def inventory_value(runway: DataFrame) -> DataFrame:
    """Stock value at the last unit price; number of SKUs at stock-out risk."""
    return runway.agg(
        F.sum(F.greatest(F.col("stock_qty"), F.lit(0.0)) * F.col("last_unit_price")).alias("inventory_value"),
        F.count(F.when(F.col("stockout_risk"), 1)).alias("skus_at_risk"))


def ledger_balance(ledger: DataFrame, keys=("warehouse_id", "item_id"), order=("day", "l_orderkey", "l_linenumber"),) -> DataFrame:
    """Running ``in - out`` per (warehouse, item) in ledger order.

    A window partitioned by item would put a hot item's whole history into one
    task. ``running_totals`` with keys range-sorts on (item, order) instead, so
    a hot item is split over as many tasks as its rows need, and each piece
    starts from the totals of the item's earlier pieces. ``order`` must make
    rows unique within an item.
    """
    d = ledger.withColumn("_delta", F.col("qty_in") - F.col("qty_out"))
    return running_totals(d, list(order), ["_delta"], keys=list(keys)).withColumnRenamed(
        "cum__delta", "balance_qty").drop("_delta")


# ---- L12, L13: assets --------------------------------------------------------------------
def asset_status(part: DataFrame) -> DataFrame:
    size = F.col("p_size")
    status = (F.when(size <= 5, "RETIRED").when(size % 7 == 0, "FAULTY").when(size % 5 == 0, "MAINTENANCE")
              .otherwise("NORMAL"))
    return part.select(F.col("p_partkey").alias("asset_id"), status.alias("status"),
                       size.cast("double").alias("reading_c"))


def asset_health(part: DataFrame) -> DataFrame:
    """Count per status and the healthy ratio (NORMAL / active x 100, active = not RETIRED)."""
    a = asset_status(part)
    by = a.groupBy("status").agg(F.count(F.lit(1)).alias("assets"))
    w = Window.partitionBy()  # over the handful of status rows only
    active = F.sum(F.when(F.col("status") != "RETIRED", F.col("assets")).otherwise(0)).over(w)
    normal = F.sum(F.when(F.col("status") == "NORMAL", F.col("assets")).otherwise(0)).over(w)
    return by.select("status", "assets", F.when(active > 0, normal / active * 100.0).otherwise(0.0)
                     .alias("healthy_asset_ratio"))


def over_temperature(part: DataFrame, limit_c: float = OVER_TEMPERATURE_C) -> DataFrame:
    """Devices whose highest reading exceeds the limit."""
    a = asset_status(part)
    return a.groupBy("asset_id").agg(F.max("reading_c").alias("max_reading_c")).where(
        F.col("max_reading_c") > limit_c)


# ---- L14-L16: tickets ----------------------------------------------------------------------
def _tickets(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("ticket_id"), F.col("event_type").alias("category"),
                         (F.col("value") / 60.0).alias("hours"))


def mttr(events: DataFrame) -> DataFrame:
    """Mean time to repair = total hours / resolved tickets (hours known); target <= 3 h."""
    t = _tickets(events).where(F.col("hours").isNotNull() & (F.col("hours") >= 0))
    agg = t.agg(F.sum("hours").alias("total_hours"), F.count(F.lit(1)).alias("resolved"))
    m = F.when(F.col("resolved") > 0, F.col("total_hours") / F.col("resolved"))
    return agg.select("total_hours", "resolved", m.alias("mttr_hours"),
                      F.coalesce(m <= MTTR_TARGET_HOURS, F.lit(False)).alias("meets_target"))


def sla_compliance(events: DataFrame, sla_hours: float = SLA_HOURS) -> DataFrame:
    """Per category: met / breached counts and compliance (target >= 95 %)."""
    t = _tickets(events).withColumn("met", F.coalesce(F.col("hours") <= sla_hours, F.lit(False)))
    g = t.groupBy("category").agg(F.count(F.when(F.col("met"), 1)).alias("met"),
                                  F.count(F.when(~F.col("met"), 1)).alias("breached"))
    rate = F.col("met") / (F.col("met") + F.col("breached")) * 100.0
    return g.select("category", "met", "breached", rate.alias("compliance"), (rate >= SLA_TARGET).alias("meets_target"))


def root_cause_breakdown(events: DataFrame) -> DataFrame:
    """Tickets per cause (the category), most frequent first."""
    return _tickets(events).groupBy(F.col("category").alias("root_cause")).agg(
        F.count(F.lit(1)).alias("tickets")).orderBy(F.desc("tickets"), "root_cause")
