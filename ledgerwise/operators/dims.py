"""Dimensions (survey 2.D): SCD2 customer, type-1 package, calendar, key lookups.

The SCD2 merge is one full outer join of the *current* rows with the batch
(history rows are passed through without a shuffle), producing up to two
output rows per joined row through ``explode(array(...))`` in a single pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_date
from ..functions.ordering import running_totals
from .staging import dedupe_first, dedupe_last

DIM_CUSTOMER_SCHEMA = ("customer_key long, customer_id long, customer_name string, city string, "
                       "installation_date date, status string, valid_from date, valid_to date, "
                       "is_current boolean, source_updated_at timestamp_ntz")
DIM_PACKAGE_SCHEMA = ("package_key long, package_id long, package_name string, speed_mbps int, "
                      "monthly_price decimal(18,2), valid_from date, valid_to date, is_current boolean")
OPEN_END = "9999-12-31"


def empty_dim_customer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DIM_CUSTOMER_SCHEMA)


def empty_dim_package(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DIM_PACKAGE_SCHEMA)


# ---- D4 -------------------------------------------------------------------------
def surrogate_key(*cols) -> "F.Column":
    """Surrogate key of a version, ``xxhash64(natural key, valid_from)``.

    A hash needs no global sort or max-key lookup, so new versions get keys in
    parallel; equal inputs give equal keys, which keeps re-runs idempotent.
    """
    return F.xxhash64(*cols)


def assign_surrogate(df: DataFrame, key_col: str, cols) -> DataFrame:
    return df.withColumn(key_col, surrogate_key(*cols))


# ---- D1 -------------------------------------------------------------------------
def _null_safe_changed(a: str, b: str):
    return ~F.col(a).eqNullSafe(F.col(b))


def scd2_merge(dim: DataFrame | None, batch: DataFrame, snapshot_date, order=("source_id",)) -> DataFrame:
    """Type-2 merge of a batch of customer records into ``dim_customer``.

    Per customer the last batch row (by ``order``) is compared with the current
    version on status, city and name (null-safe: NULL equals NULL).

    * new customer -> version 1, ``valid_from = installation_date or snapshot``;
    * changed -> old version closed at ``snapshot`` and a new version opened
      that keeps the old installation date;
    * unchanged -> only ``source_updated_at`` moves.

    Two guards the source system lacked: a change on the same day as the
    current version's start overwrites that version (no zero-length version),
    and a batch row older than the current version (``source_updated_at``)
    is ignored (late data cannot reopen history).
    """
    snap = as_date(snapshot_date)
    order = [order] if isinstance(order, str) else list(order)
    attrs = ["customer_name", "city", "installation_date", "status", "source_updated_at"]
    b = batch.where(F.col("customer_id").isNotNull()).select("customer_id", *attrs, *order)
    b = dedupe_last(b, "customer_id", order)
    if dim is None:
        # First load: every customer opens version 1 (no join against an empty dimension).
        inst = F.coalesce(F.col("installation_date"), snap)
        return b.select(
            surrogate_key(F.col("customer_id"), inst).cast("long").alias("customer_key"),
            F.col("customer_id").cast("long").alias("customer_id"), "customer_name", "city",
            inst.cast("date").alias("installation_date"), "status", inst.cast("date").alias("valid_from"),
            F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"),
            F.col("source_updated_at").cast("timestamp_ntz").alias("source_updated_at"),
        )
    b = b.select("customer_id", *[F.col(c).alias(f"b_{c}") for c in attrs], F.lit(True).alias("_in_b"))
    hist = dim.where(~F.col("is_current"))
    cur = dim.where(F.col("is_current")).select(
        "customer_id", *[F.col(c).alias(f"c_{c}") for c in dim.columns if c != "customer_id"],
        F.lit(True).alias("_in_c"),
    )
    j = cur.join(b, "customer_id", "full")
    in_b = F.coalesce(F.col("_in_b"), F.lit(False))
    in_c = F.coalesce(F.col("_in_c"), F.lit(False))
    stale = (in_b & in_c & (F.col("b_source_updated_at") < F.col("c_source_updated_at")))
    stale = F.coalesce(stale, F.lit(False))
    live = in_b & in_c & ~stale
    changed = live & (
        _null_safe_changed("c_status", "b_status")
        | _null_safe_changed("c_city", "b_city")
        | _null_safe_changed("c_customer_name", "b_customer_name")
    )
    # a version that starts on the snapshot day or later is overwritten: closing it would end it before it starts
    same_day = changed & (F.col("c_valid_from") >= snap)

    def row(key, name, city, inst, status, vfrom, vto, current, upd):
        return F.struct(
            key.cast("long").alias("customer_key"), F.col("customer_id").cast("long").alias("customer_id"),
            name.alias("customer_name"), city.alias("city"), inst.cast("date").alias("installation_date"),
            status.alias("status"), vfrom.cast("date").alias("valid_from"), vto.cast("date").alias("valid_to"),
            current.alias("is_current"), upd.cast("timestamp_ntz").alias("source_updated_at"),
        )

    c = {k: F.col(f"c_{k}") for k in ["customer_key", "customer_name", "city", "installation_date", "status",
                                      "valid_from", "valid_to", "is_current", "source_updated_at"]}
    bb = {k: F.col(f"b_{k}") for k in attrs}
    null_date = F.lit(None).cast("date")
    new_inst = F.coalesce(bb["installation_date"], snap)
    brand_new = row(surrogate_key(F.col("customer_id"), new_inst), bb["customer_name"], bb["city"], new_inst,
                    bb["status"], new_inst, null_date, F.lit(True), bb["source_updated_at"])
    overwrite = row(c["customer_key"], bb["customer_name"], bb["city"], c["installation_date"], bb["status"],
                    c["valid_from"], null_date, F.lit(True), bb["source_updated_at"])
    closed = row(c["customer_key"], c["customer_name"], c["city"], c["installation_date"], c["status"],
                 c["valid_from"], snap, F.lit(False), c["source_updated_at"])
    touched = row(c["customer_key"], c["customer_name"], c["city"], c["installation_date"], c["status"],
                  c["valid_from"], c["valid_to"], c["is_current"],
                  F.when(live, bb["source_updated_at"]).otherwise(c["source_updated_at"]))
    new_version = row(surrogate_key(F.col("customer_id"), snap), bb["customer_name"], bb["city"],
                      c["installation_date"], bb["status"], snap, null_date, F.lit(True), bb["source_updated_at"])
    first = (F.when(~in_c, brand_new).when(same_day, overwrite).when(changed, closed).otherwise(touched))
    second = F.when(changed & ~same_day, new_version)
    merged = j.select(F.explode(F.array(first, second)).alias("r")).where(F.col("r").isNotNull()).select("r.*")
    return hist.select(*merged.columns).unionByName(merged)


def scd2_inserted(new_dim: DataFrame, snapshot_date) -> DataFrame:
    """Number of versions opened by a merge on ``snapshot_date`` (one-row DF)."""
    return new_dim.where(F.col("is_current") & (F.col("valid_from") == as_date(snapshot_date))).agg(
        F.count(F.lit(1)).alias("inserted"))


# ---- D2 -------------------------------------------------------------------------
def upsert_package(dim: DataFrame | None, batch: DataFrame, snapshot_date, order=("source_id",)) -> DataFrame:
    """Type-1 package upsert from subscription records.

    The *first* record per package id wins; its subscription fee becomes the
    package price (as in the source system). Existing current rows are
    overwritten in place; unknown packages open with ``valid_from = snapshot``.
    """
    snap = as_date(snapshot_date)
    order = [order] if isinstance(order, str) else list(order)
    b = batch.where(F.col("package_id").isNotNull()).select(
        F.col("package_id").cast("long").alias("package_id"), "package_name", "speed_mbps",
        F.col("monthly_fee").alias("monthly_price"), *order)
    b = dedupe_first(b, "package_id", order)
    if dim is None:
        return b.select(
            surrogate_key(F.col("package_id"), snap).alias("package_key"), "package_id", "package_name",
            F.col("speed_mbps").cast("int").alias("speed_mbps"),
            F.col("monthly_price").cast("decimal(18,2)").alias("monthly_price"), snap.alias("valid_from"),
            F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"))
    b = b.select(
        "package_id", *[F.col(c).alias(f"b_{c}") for c in ("package_name", "speed_mbps", "monthly_price")],
        F.lit(True).alias("_in_b"))
    hist = dim.where(~F.col("is_current"))
    cur = dim.where(F.col("is_current"))
    j = cur.join(b, "package_id", "full")
    in_b = F.coalesce(F.col("_in_b"), F.lit(False))
    is_new = F.col("package_key").isNull()
    out = j.select(
        F.when(is_new, surrogate_key(F.col("package_id"), snap)).otherwise(F.col("package_key")).alias("package_key"),
        "package_id",
        F.when(in_b, F.col("b_package_name")).otherwise(F.col("package_name")).alias("package_name"),
        F.when(in_b, F.col("b_speed_mbps")).otherwise(F.col("speed_mbps")).cast("int").alias("speed_mbps"),
        F.when(in_b, F.col("b_monthly_price")).otherwise(F.col("monthly_price")).cast("decimal(18,2)")
        .alias("monthly_price"),
        F.when(is_new, snap).otherwise(F.col("valid_from")).alias("valid_from"),
        F.col("valid_to"),
        F.lit(True).alias("is_current"),
    )
    return hist.select(*out.columns).unionByName(out)


# ---- D3 -------------------------------------------------------------------------
def build_dim_date(df: DataFrame, date_col: str, billing_cycle_day: int | None = None) -> DataFrame:
    """D3: calendar covering ``min..max`` of ``date_col`` in ``df``.

    The span is bounded by the calendar (days), not by the data volume; one
    aggregate finds the bounds, then ``sequence`` + ``explode`` lays out the days.
    ``is_billing_cycle_end`` marks month ends (the billing cycle closes then)
    unless a fixed cycle day is given.
    """
    bounds = df.agg(F.min(F.to_date(date_col)).alias("lo"), F.max(F.to_date(date_col)).alias("hi"))
    days = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("d"))
    month_end = F.col("d") == F.last_day("d")
    cycle_end = month_end if billing_cycle_day is None else (F.dayofmonth("d") == billing_cycle_day)
    return days.select(
        F.col("d").alias("date_key"),
        F.year("d").alias("year"),
        F.month("d").alias("month"),
        F.quarter("d").alias("quarter"),
        F.weekofyear("d").alias("week_of_year"),
        F.dayofweek("d").alias("day_of_week"),
        month_end.alias("is_month_end"),
        cycle_end.alias("is_billing_cycle_end"),
    )


# ---- D5 / D6 / D7 -----------------------------------------------------------------
def lookup_current(fact: DataFrame, dim: DataFrame, nk: str, sk: str, how: str = "inner") -> DataFrame:
    """Natural key -> surrogate key of the current version.

    ``how='inner'`` drops facts without a current version (customers);
    ``how='left'`` keeps them with a NULL key (packages).
    """
    d = dim.where(F.col("is_current")).select(nk, sk)
    return fact.join(d, nk, how)


def lookup_asof(fact: DataFrame, dim: DataFrame, date_col: str, nk: str, cols) -> DataFrame:
    """Attributes of the version valid at ``fact[date_col]`` (NULL when none is).

    An as-of join without pairs: facts and version starts are put in one
    stream ordered by (key, date, versions before facts), and a running max of
    the version start gives each fact the start of the version in force at its
    date. The running max is ``running_totals(how='max')``, which range-splits
    a hot key over tasks. An equi-join on (key, version start) - one version
    per pair - then brings the attributes, and the fact date must fall before
    the version's end. A join on the key with the interval as a condition
    would instead compare every fact of a key with every version of it.
    """
    fcols = fact.columns
    t_type = fact.schema[date_col].dataType
    if not isinstance(t_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        t_type = T.DateType()
    facts = fact.select(*fcols, F.col(nk).alias("_k"), F.col(date_col).cast(t_type).alias("_t"),
                        F.lit(1).alias("_kind"), F.lit(None).cast("date").alias("_vf"),
                        # facts of one key and date are told apart, so the range sort can split them
                        F.monotonically_increasing_id().alias("_tie"))
    starts = dim.select(*[F.lit(None).cast(fact.schema[c].dataType).alias(c) for c in fcols],
                        F.col(nk).alias("_k"), F.col("valid_from").cast(t_type).alias("_t"),
                        F.lit(0).alias("_kind"), F.col("valid_from").cast("date").alias("_vf"),
                        F.lit(0).cast("long").alias("_tie"))
    scan = running_totals(facts.unionByName(starts), ["_t", "_kind", "_tie"], ["_vf"], keys=["_k"], how="max")
    hits = scan.where(F.col("_kind") == 1).select(*fcols, "_k", F.col("cum__vf").alias("_asof"))
    d = dim.select(F.col(nk).alias("_dk"), F.col("valid_from").cast("date").alias("_dvf"),
                   F.coalesce("valid_to", as_date(OPEN_END)).alias("_vto"), *cols)
    cond = (F.col("_k") == F.col("_dk")) & (F.col("_asof") == F.col("_dvf")) & (F.col(date_col) < F.col("_vto"))
    return hits.join(d, cond, "left").drop("_k", "_asof", "_dk", "_dvf", "_vto")


def version_history(dim: DataFrame, customer_id=None) -> DataFrame:
    """Numbered versions, with the invariant check ``next version's valid_from == valid_to``.

    The version number is a running count per customer (``running_totals``,
    which range-splits a customer with a very long history over tasks instead
    of one window task), and the next version comes from an equi-join on
    (customer, version + 1): one partner per row.
    """
    d = dim if customer_id is None else dim.where(F.col("customer_id") == customer_id)
    v = running_totals(d.withColumn("_one", F.lit(1)), ["valid_from", "customer_key"], ["_one"],
                       keys=["customer_id"])
    v = v.withColumn("version", F.col("cum__one").cast("int")).drop("_one", "cum__one")
    nxt = v.select(F.col("customer_id").alias("_c"), (F.col("version") - 1).alias("_v"),
                   F.col("valid_from").alias("_next_from"))
    j = v.join(nxt, F.col("customer_id").eqNullSafe(F.col("_c")) & (F.col("version") == F.col("_v")), "left")
    chain_ok = (F.when(F.col("_next_from").isNull(), F.col("valid_to").isNull() & F.col("is_current"))
                .otherwise(F.coalesce(F.col("_next_from") == F.col("valid_to"), F.lit(False))))
    return j.withColumn("chain_ok", chain_ok).drop("_c", "_v", "_next_from")
