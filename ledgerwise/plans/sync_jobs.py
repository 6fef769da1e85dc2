"""Batch sync jobs (survey B9, B10): one driver function per job, one lineage per step.

Each step's output is written to the ``StateStore`` and re-read, so the next step starts from
written rows: a lost executor re-runs at most one step, and no step re-computes the extract.
Facts, features and current staging rows are merged partition by partition: a run rewrites the
snapshot dates, invoice periods and months of its own rows and no others.
Extracted records are landed once per batch (``_extract/<table>/batch_id=``)
and every later step reads them; row counts, quality measures and the highest change time are
observed while they are landed, so the source is scanned once.

The watermark is the ``watermark_end`` of the newest successful batch in the
batch log (A2); an explicit ``since`` wins, a full refresh has no lower bound
(A3). The logged ``watermark_end`` is the window's upper bound because the
extract is never capped (the source system's cap skipped rows).
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import dims, facts, features, quality, staging
from ..session import materialize
from ..sources import erp

SUB_REQUIRED = ["source_id", "customer_id", "subscription_no"]
SUB_NON_NEGATIVE = ["monthly_fee"]
INV_REQUIRED = ["source_id", "invoice_number", "customer_subscription_id"]
INV_NON_NEGATIVE = ["total_amount", "paid_amount"]
PAY_REQUIRED = ["source_id", "sales_invoice_id"]
PAY_NON_NEGATIVE = ["amount"]

BILLING_EMPTY = ("invoice_period date, customer_key long, invoiced_amount decimal(18,2), "
                 "paid_amount decimal(18,2), payment_status string, days_late int, batch_id string")


def _since(store: staging.StateStore, source_table: str, since, full_refresh: bool):
    log = store.read_log("etl_batch_log")
    last = None
    if log is not None and since is None and not full_refresh:
        last = erp.last_watermark(staging.batch_log_view(log), source_table).first()[0]
    return erp.effective_since(since, last, full_refresh)


def _land(store: staging.StateStore, table: str, batch_id: str, records: DataFrame, change_time: str,
          not_null, non_negative) -> tuple[DataFrame, dict, DataFrame]:
    """Write the extracted records of one batch once and continue from the written rows.

    Returns them, what was observed on the way (``rows``, ``last_change``), and the quality checks.
    """
    path = f"{store.root}/_extract/{table}/batch_id={batch_id}"
    seen = Observation()
    measures = [*quality.check_measures(not_null, non_negative), F.max(change_time).alias("_last")]
    records.observe(seen, *measures).write.mode("overwrite").option("compression", staging.CODEC).parquet(path)
    got = seen.get
    names = [f"_null_{c}" for c in not_null] + [f"_neg_{c}" for c in non_negative]
    one = store.spark.createDataFrame([tuple([got.get("_n", 0), *[got.get(c) for c in names]])],
                                      ", ".join(f"{c} long" for c in ["_n", *names]))
    checks = quality.check_rows(one, f"stg_{table}", not_null, non_negative)
    return store.spark.read.parquet(path), {"rows": got.get("_n", 0), "last_change": got.get("_last")}, checks


#: Current staging rows: table -> (date whose period partitions it, order of its versions).
CURRENT = {
    "stg_customer_subscription": ("start_date", ("source_updated_at", "loaded_at", "batch_id")),
    "stg_sales_invoice": ("invoice_date", ("source_updated_at", "loaded_at", "batch_id")),
    "stg_sales_payment": ("payment_date", ("source_created_at", "loaded_at", "batch_id")),
}


def _stage(store: staging.StateStore, table: str, rows: DataFrame) -> None:
    """Append the batch, a projection of landed records, to the staging log, and merge it into the current rows of its periods."""
    store.append(table, rows)
    date, order = CURRENT[table]
    store.merge(f"current_{table}", rows.withColumn("period", F.date_format(date, store.period)), ["source_id"], "period", list(order),
                written=True)


def _clock(now: dt.datetime | None) -> dt.datetime:
    """The injected time (tests), else the time right now."""
    return now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _log_quality(store, checks: DataFrame, batch_id: str, now: dt.datetime) -> None:
    store.append("data_quality_log", quality.record_quality(checks, batch_id, now))


def run_subscription_sync(spark: SparkSession, src: dict, store: staging.StateStore, until: dt.datetime,
                          snapshot_date: dt.date, since=None, full_refresh: bool = False, is_mock: bool = False,
                          now: dt.datetime | None = None, finished: dt.datetime | None = None) -> dict:
    """A5 -> C1, C2 -> B1 -> D2 -> D1 -> E1 -> F6 -> B7. Returns row counts. An empty extract
    finishes early and rewrites nothing."""
    now = _clock(now)
    lower = _since(store, "customer_subscription", since, full_refresh)
    bid = str(uuid.uuid4())
    start = staging.start_batch(spark, "customer_subscription", lower, until, is_mock, now, bid)
    store.append("etl_batch_log", start)
    try:
        recs = erp.extract_subscriptions(src["customer_subscription"], src["customer"], src["internet_package"],
                                         lower, until)
        recs_w, seen, checks = _land(store, "customer_subscription", bid, recs, "source_updated_at", SUB_REQUIRED, SUB_NON_NEGATIVE)
        n = seen["rows"]
        if not n:
            store.append("etl_batch_log", staging.finish_batch(start, 0, "SUCCESS", is_mock, _clock(finished)))
            return {"batch_id": bid, "rows": 0}
        _log_quality(store, checks, bid, now)
        dimp = store.write("dim_package", dims.upsert_package(store.read("dim_package"), recs_w, snapshot_date))
        dimc = store.write("dim_customer", dims.scd2_merge(store.read("dim_customer"), recs_w, snapshot_date))
        store.merge("fact_subscription_snapshot", facts.fact_subscription_snapshot(recs_w, dimc, dimp, snapshot_date, bid),
                    ["snapshot_date", "customer_key"], "snapshot_date")
        fact = store.read("fact_subscription_snapshot")  # F6 reads this snapshot's partition of it
        bills = store.read("fact_billing_monthly")
        if bills is None:
            bills = spark.createDataFrame([], BILLING_EMPTY)
        store.merge("feature_customer_churn", features.build_churn_features(fact, dimc, dimp, bills, snapshot_date, bid),
                    ["snapshot_date", "customer_id"], "snapshot_date")
        _replay(store, dimc, bid)
        # staged last: a batch that failed and runs again has staged nothing yet
        _stage(store, "stg_customer_subscription", staging.stage_subscriptions(recs_w, bid, now))
    except Exception as e:
        store.append("etl_batch_log", staging.finish_batch(start, 0, is_mock=is_mock, now=_clock(finished), error=str(e)))
        raise
    store.append("etl_batch_log", staging.finish_batch(start, n, "SUCCESS", is_mock, _clock(finished)))
    return {"batch_id": bid, **seen}


def _known(dimc: DataFrame) -> DataFrame:
    return dimc.where("is_current").select("customer_id").distinct()


def _split_known(inv: DataFrame, dimc: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """Invoices whose customer the dimension knows, and the others."""
    if dimc is None:
        return None, inv
    return inv.join(_known(dimc), "customer_id", "left_semi"), inv.join(_known(dimc), "customer_id", "left_anti")


def _load_bills(store: staging.StateStore, inv: DataFrame, dimc: DataFrame | None, batch_id: str) -> None:
    """Facts of known customers; invoices of unknown ones wait in ``pending_invoice``, newest version each."""
    waiting = store.read("pending_invoice")
    if waiting is None:
        known, unknown = _split_known(inv, dimc)
    else:
        both = staging.latest_by_source(
            waiting.withColumn("_now", F.lit(0)).unionByName(inv.withColumn("_now", F.lit(1))), "source_id",
            ["source_updated_at", "_now"]).drop("_now")
        if dimc is None:
            known, unknown = None, both
        else:  # newest versions and what is known of them: one pass, written once, read by both sides
            both = materialize(both.join(_known(dimc).withColumn("_known", F.lit(True)), "customer_id", "left"), "invoices")
            known, unknown = (both.where(c).drop("_known") for c in ("_known", "_known IS NULL"))
    if known is not None:
        store.merge("fact_billing_monthly", facts.fact_billing_monthly(known, dimc, batch_id),
                    ["invoice_period", "customer_key"], "invoice_period")
    if waiting is not None or not unknown.isEmpty():
        store.write("pending_invoice", unknown)


def _replay(store: staging.StateStore, dimc: DataFrame, batch_id: str) -> None:
    """After new customers: load the invoices that waited for them."""
    waiting = store.read("pending_invoice")
    if waiting is not None and not _split_known(waiting, dimc)[0].isEmpty():
        _load_bills(store, waiting.limit(0), dimc, batch_id)


def run_billing_sync(spark: SparkSession, src: dict, store: staging.StateStore, until: dt.datetime, as_of,
                     since=None, full_refresh: bool = False, is_mock: bool = False,
                     now: dt.datetime | None = None, finished: dt.datetime | None = None) -> dict:
    """A6, A7 -> C1, C2 -> B2 -> E2 -> B7. Returns row counts. Invoices of customers that no
    subscription sync has loaded yet wait and are loaded by the sync that brings the customer."""
    now = _clock(now)
    lower = _since(store, "sales_invoice", since, full_refresh)
    bid = str(uuid.uuid4())
    start = staging.start_batch(spark, "sales_invoice", lower, until, is_mock, now, bid)
    store.append("etl_batch_log", start)
    try:
        inv = erp.extract_invoices(src["sales_invoice"], src["customer_subscription"], src["sales_payment"],
                                   lower, until, as_of)
        pay = erp.extract_payments(src["sales_payment"], lower, until)
        inv_w, inv_seen, checks = _land(store, "sales_invoice", bid, inv, "source_updated_at", INV_REQUIRED, INV_NON_NEGATIVE)
        pay_w, pay_seen, more = _land(store, "sales_payment", bid, pay, "source_created_at", PAY_REQUIRED, PAY_NON_NEGATIVE)
        n_inv, n_pay = inv_seen["rows"], pay_seen["rows"]
        _log_quality(store, checks.unionByName(more), bid, now)
        if n_inv:
            _load_bills(store, inv_w, store.read("dim_customer"), bid)
        _stage(store, "stg_sales_invoice", staging.stage_invoices(inv_w, bid, now))
        _stage(store, "stg_sales_payment", staging.stage_payments(pay_w, bid, now))
    except Exception as e:
        store.append("etl_batch_log", staging.finish_batch(start, 0, is_mock=is_mock, now=_clock(finished), error=str(e)))
        raise
    store.append("etl_batch_log", staging.finish_batch(start, n_inv + n_pay, "SUCCESS", is_mock, _clock(finished)))
    return {"batch_id": bid, "invoices": n_inv, "payments": n_pay}


# ---- B3: analytics over what the jobs have written ---------------------------------------------
def written_tables(store: staging.StateStore) -> dict:
    """The tables that the KPI, chart and audit plans read, as the jobs have left them.

    Staging tables are the current rows, one per source id however often it was loaded. Current rows are
    kept by the period of a business date; should the source move that date, the newest version still wins.
    """
    out = {"dim_customer": store.read("dim_customer"), "dim_package": store.read("dim_package")}
    for table, (_, order) in CURRENT.items():
        rows = store.read(f"current_{table}")
        if rows is None:
            raise LookupError(f"no batch has loaded {table} yet")
        out[table] = staging.latest_by_source(rows.drop("period"), "source_id", order).withColumn("id", F.col("source_id"))
    return out
