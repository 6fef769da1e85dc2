"""Snapshot writes, versioned state, model registry and re-runnable sync jobs on the seed."""

import datetime as dt
import tempfile

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from conftest import AS_OF
from ledgerwise.operators import churn, staging
from ledgerwise.plans import findings, sync_jobs


def _scratch():
    return tempfile.mkdtemp(prefix="lw-test-", dir="/tmp")


def test_write_snapshot_replaces_only_touched_dates(spark):
    path = _scratch() + "/fact"
    a = spark.createDataFrame([("2026-01-01", 1), ("2026-02-01", 2)], "d string, v int")
    staging.write_snapshot(a, path, "d")
    staging.write_snapshot(spark.createDataFrame([("2026-02-01", 9)], "d string, v int"), path, "d")
    got = sorted((r["d"], r["v"]) for r in spark.read.parquet(path).collect())
    assert [(str(d), v) for d, v in got] == [("2026-01-01", 1), ("2026-02-01", 9)]


def test_write_snapshot_splits_one_hot_date(spark):
    import glob

    path = _scratch() + "/fact"
    df = spark.range(0, 200000, numPartitions=8).select(F.lit("2026-03-01").alias("d"), (F.col("id") * 7).alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        staging.write_snapshot(df, path, "d")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = glob.glob(f"{path}/d=2026-03-01/*.parquet")
    assert len(files) > 1  # one date, yet written by several tasks
    assert spark.read.parquet(path).count() == 200000


def test_state_store_versions(spark):
    store = staging.StateStore(spark, _scratch())
    assert store.read("t") is None
    store.write("t", spark.range(3))
    store.write("t", store.read("t").where("id > 0"))
    assert store.current_version("t") == 2 and store.read("t").count() == 2


def test_sync_jobs_rerun_idempotent(spark, seed):
    store = staging.StateStore(spark, _scratch())
    until = dt.datetime(2026, 9, 1)
    r1 = sync_jobs.run_subscription_sync(spark, seed, store, until, AS_OF, now=dt.datetime(2026, 9, 1, 0, 5))
    sync_jobs.run_billing_sync(spark, seed, store, until, AS_OF, now=dt.datetime(2026, 9, 1, 0, 30))
    assert r1["rows"] == 8
    # features of the first run had no bills yet; a full re-run now sees them
    sync_jobs.run_subscription_sync(spark, seed, store, until, AS_OF, full_refresh=True,
                                    now=dt.datetime(2026, 9, 1, 0, 45))
    dims1 = store.read("dim_customer").count()
    feats1 = sorted(map(tuple, store.read("feature_customer_churn").drop("batch_id").collect()))
    assert [f for f in feats1 if f[1] == 1004][0][8] == "WORSENING"
    # the same window again (full refresh): no duplicates, same values
    sync_jobs.run_subscription_sync(spark, seed, store, until, AS_OF, full_refresh=True,
                                    now=dt.datetime(2026, 9, 1, 1, 5))
    assert store.read("dim_customer").count() == dims1 == 8
    assert store.read("fact_subscription_snapshot").count() == 8
    assert sorted(map(tuple, store.read("feature_customer_churn").drop("batch_id").collect())) == feats1
    # incremental run after the watermark: nothing new
    r3 = sync_jobs.run_subscription_sync(spark, seed, store, dt.datetime(2026, 9, 2), AS_OF,
                                         now=dt.datetime(2026, 9, 2, 0, 5))
    assert r3["rows"] == 0
    log = staging.batch_history(staging.batch_log_view(store.read_log("etl_batch_log")), limit=None).collect()
    assert len(log) == 5 and all(r["status"] == "SUCCESS [LIVE]" for r in log)
    assert store.read_log("data_quality_log").where("status = 'FAIL'").count() == 0


def test_model_registry_and_tuning(spark):
    rows = [(float(i % 7), float(i % 3) * 1000, 30, i % 4, i % 5, float(i % 9), "STABLE", False, int(i % 4 >= 2))
            for i in range(120)]
    df = spark.createDataFrame(rows, "tenure_months double, monthly_fee_current double, package_speed_mbps int, "
                                     "late_payment_count_3m int, late_payment_count_6m int, "
                                     "avg_payment_delay_days_3m double, payment_status_trend string, "
                                     "downgrade_flag_6m boolean, label int")
    model = churn.fit_churn(df, preset="fast_prototype", overrides={"n_estimators": 3})
    reg = churn.ModelRegistry(spark, _scratch())
    reg.save(model, "1.0.0", {"roc_auc": 0.9})
    reg.save(model, "1.0.1", {"roc_auc": 0.8}, activate=False)
    assert reg.active_version() == "1.0.0"
    listed = {r["version"]: r["is_active"] for r in reg.list().collect()}
    assert listed == {"1.0.0": True, "1.0.1": False}
    reg.activate("1.0.1")
    assert reg.active_version() == "1.0.1"
    reg.activate("1.0.0")  # rolling back: the newest activation wins, not the highest version
    assert reg.active_version() == "1.0.0"
    again = reg.load()
    p = churn.churn_probability(again, df).agg(F.min("churn_probability"), F.max("churn_probability")).first()
    assert 0.0 <= p[0] <= p[1] <= 1.0
    tvs = churn.tuning_search(df, BinaryClassificationEvaluator(), grid={"max_depth": [2, 3]})
    assert len(tvs.getEstimatorParamMaps()) == 2


def test_no_invoice_is_lost(spark, seed):
    """Billing before its customers, NULL change times, a failed mock batch, an unreadable pointer."""
    from pyspark.sql import functions as F

    store = staging.StateStore(spark, _scratch())
    until = dt.datetime(2026, 9, 1)
    no_times = dict(seed)
    no_times["sales_invoice"] = seed["sales_invoice"].withColumn(
        "updated_at", F.when(F.col("id") % 2 == 0, F.col("updated_at")))
    r = sync_jobs.run_billing_sync(spark, no_times, store, until, AS_OF, now=until, finished=until + dt.timedelta(minutes=3))
    assert r["invoices"] == 14 and store.read("fact_billing_monthly") is None
    assert store.read("pending_invoice").count() == 14
    sync_jobs.run_subscription_sync(spark, seed, store, until, AS_OF, now=until)
    assert store.read("pending_invoice").count() == 0
    n = store.read("fact_billing_monthly").count()
    sync_jobs.run_billing_sync(spark, seed, store, until, AS_OF, full_refresh=True, now=until)
    assert store.read("fact_billing_monthly").count() == n > 0
    log = staging.batch_log_view(store.read_log("etl_batch_log")).where(f"batch_id = '{r['batch_id']}'").first()
    assert log["finished_at"] - log["started_at"] == dt.timedelta(minutes=3)

    broken = dict(seed, sales_invoice=seed["sales_invoice"].withColumn("invoice_number", F.raise_error(F.lit("x" * 300))))
    with pytest.raises(Exception):
        sync_jobs.run_billing_sync(spark, broken, store, until, AS_OF, full_refresh=True, is_mock=True, now=until)
    failed = staging.batch_history(staging.batch_log_view(store.read_log("etl_batch_log")), limit=None).where(
        "status LIKE 'FAILED%'").withColumn("label", staging.status_label(F.col("status"))).first()
    assert failed["is_mock_data"] and "x" * 300 in failed["status"]
    assert len(failed["label"]) <= 50 and failed["label"].endswith(" [MOCK]")
    with pytest.raises(Exception):
        staging.StateStore(spark, "nosuchfs://x/y").read("t")


def test_version_starting_after_the_snapshot_is_overwritten(spark):
    from ledgerwise.operators import dims

    row = "source_id long, customer_id long, customer_name string, city string, installation_date date, status string, source_updated_at timestamp_ntz"
    first = spark.createDataFrame([(1, 1, "A", "X", dt.date(2026, 9, 20), "ACTIVE", dt.datetime(2026, 8, 1))], row)
    dim = dims.scd2_merge(None, first, dt.date(2026, 8, 1))
    later = spark.createDataFrame([(1, 1, "A", "Y", dt.date(2026, 9, 20), "ACTIVE", dt.datetime(2026, 8, 2))], row)
    out = dims.scd2_merge(dim, later, dt.date(2026, 8, 2)).collect()
    assert len(out) == 1 and out[0]["city"] == "Y" and out[0]["valid_to"] is None


def test_snapshot_revenue_counts_a_customer_once_after_a_status_change(spark, seed):
    store = staging.StateStore(spark, _scratch() + "/store")
    sync_jobs.run_subscription_sync(spark, seed, store, dt.datetime(2026, 9, 1), dt.date(2026, 9, 1),
                                    now=dt.datetime(2026, 9, 1, 1))
    revenue = lambda: tuple(findings.snapshot_revenue(
        store.read("fact_subscription_snapshot"), store.read("dim_customer")).first())
    n, mrr, _ = revenue()
    src = dict(seed)
    changed = F.lit("2026-09-02 08:00:00").cast(seed["customer_subscription"].schema["updated_at"].dataType)
    for table in ("customer_subscription", "customer"):
        mine = F.col("customer_id" if table == "customer_subscription" else "id") == 1002
        src[table] = seed[table].withColumn("status", F.when(mine, "TERMINATED").otherwise(F.col("status"))).withColumn(
            "updated_at", F.when(mine, changed).otherwise(F.col("updated_at")))
    sync_jobs.run_subscription_sync(spark, src, store, dt.datetime(2026, 9, 3), dt.date(2026, 9, 3),
                                    now=dt.datetime(2026, 9, 3, 1))
    assert store.read("dim_customer").where("customer_id = 1002").count() == 2
    assert revenue()[:2] == (n - 1, mrr - 550000)


def _files(root):
    import os

    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root)
            for f in fs if f.endswith(".parquet")}


FACT = "day date, id long, v string"


def test_upsert_rewrites_only_touched_partitions(spark):
    from ledgerwise.operators import partitioned

    path = _scratch() + "/fact"
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(days=n)
    merge = lambda rows, order=None: partitioned.merge_partitions(
        spark, path, spark.createDataFrame(rows, FACT), ["day", "id"], "day", order)
    merge([(day(n), i, "old") for n in range(20) for i in range(10)] + [(None, 1, "none")])
    before = _files(path + "/rows")
    written = {}
    for history in (20, 40):  # the same batch into a table twice as long costs the same bytes
        if history == 40:
            merge([(day(n), i, "old") for n in range(20, 40) for i in range(10)])
            before = _files(path + "/rows")
        touched = merge([(day(3), 1, "new"), (day(3), 99, "new"), (None, 1, "changed")])
        assert sorted(touched, key=str) == [day(3), None]
        after = _files(path + "/rows")
        changed = {p for p, t in after.items() if before.get(p) != t}
        assert changed and all("day=2026-01-04" in p or "__HIVE_DEFAULT" in p for p in changed)
        import os

        written[history] = sum(os.path.getsize(p) for p in changed)
    assert abs(written[20] - written[40]) < 0.02 * written[20]
    got = {(r.day, r.id): r.v for r in partitioned.read_partitioned(spark, path).collect()}
    assert len(got) == 402 and got[day(3), 1] == got[day(3), 99] == "new" and got[None, 1] == "changed" and got[day(4), 1] == "old"
    assert merge([]) == []


def test_a_driver_lost_while_publishing_loses_nothing(spark, monkeypatch):
    from ledgerwise.operators import partitioned

    path = _scratch() + "/fact"
    merge = lambda rows: partitioned.merge_partitions(spark, path, spark.createDataFrame(rows, FACT), ["day", "id"], "day")
    d = dt.date(2026, 1, 1)
    merge([(d, i, "old") for i in range(5)])

    def lost(df, to, part):
        import shutil

        shutil.rmtree(f"{to}/day=2026-01-01")  # the old partition is gone, the new one not in place yet
        raise RuntimeError("driver lost")

    monkeypatch.setattr(partitioned, "write_snapshot", lost)
    with pytest.raises(RuntimeError):
        merge([(d, 9, "new")])
    monkeypatch.undo()
    assert merge([(dt.date(2026, 1, 2), 1, "later")])  # the next run puts the merged rows in place first
    got = sorted((r.id, r.v) for r in partitioned.read_partitioned(spark, path).where("day = DATE '2026-01-01'").collect())
    assert got == [(i, "old") for i in range(5)] + [(9, "new")]


def test_second_sync_leaves_other_snapshots_alone(spark, seed):
    root = _scratch()
    store = staging.StateStore(spark, root)
    kept = ("fact_subscription_snapshot", "feature_customer_churn")
    run = lambda day: sync_jobs.run_subscription_sync(
        spark, seed, store, dt.datetime(2026, 9, day), dt.date(2026, 9, day), full_refresh=True, now=dt.datetime(2026, 9, day, 1))
    got = run(1)
    assert got["rows"] == 8 and got["last_change"] is not None
    before = {n: _files(f"{root}/{n}/rows") for n in kept}
    run(2)
    for n in kept:
        after = _files(f"{root}/{n}/rows")
        assert before[n].items() <= after.items() and all("snapshot_date=2026-09-02" in p for p in set(after) - set(before[n]))
        assert store.read(n).count() == 16
    # The log holds every row twice, the current rows once
    assert store.read_log("stg_customer_subscription").count() == 16
    with pytest.raises(LookupError):
        sync_jobs.written_tables(store)
    for hour in (2, 3):
        sync_jobs.run_billing_sync(spark, seed, store, dt.datetime(2026, 9, 2), AS_OF, full_refresh=True, now=dt.datetime(2026, 9, 2, hour))
    tables = sync_jobs.written_tables(store)
    assert {n: tables[n].count() for n in sync_jobs.CURRENT} == {
        "stg_customer_subscription": 8, "stg_sales_invoice": 14, "stg_sales_payment": 11}
    assert store.read_log("stg_sales_invoice").count() == 28


def test_landing_observes_counts_and_checks(spark):
    """The measures taken while rows are landed equal those of a pass of their own, empty batches too."""
    from ledgerwise.operators import quality

    rows = [(1, "a", -5.0), (2, None, 3.0), (None, None, None)]
    schema = "source_id long, name string, fee double"
    for part in (rows, []):
        df = spark.createDataFrame(part, schema).withColumn("changed", F.lit("2026-01-01").cast("timestamp_ntz"))
        store = staging.StateStore(spark, _scratch())
        back, seen, checks = sync_jobs._land(store, "t", "b", df, "changed", ["source_id", "name"], ["fee"])
        assert seen["rows"] == back.count() == len(part)
        assert checks.collect() == quality.quality_checks(df, "stg_t", ["source_id", "name"], ["fee"]).collect()


def _shuffles(spark, run):
    """The number of exchanges in the plan of each Parquet write of ``run``."""
    from pyspark.sql import DataFrameWriter

    plans, real = [], DataFrameWriter.parquet

    def parquet(self, *args, **more):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return real(self, *args, **more)

    DataFrameWriter.parquet = parquet
    try:
        run()
    finally:
        DataFrameWriter.parquet = real
    return [p.count("Exchange ") for p in plans]


@pytest.mark.parametrize("order", [None, ["v"]])
def test_upsert_shuffles_the_rows_once(spark, order):
    """old and incoming rows cross one shuffle on their way in place, and written rows are not written again."""
    from ledgerwise.operators import partitioned

    path = _scratch() + "/fact"
    rows = lambda v: spark.createDataFrame([(dt.date(2026, 1, 1 + i % 3), i, v) for i in range(30)], FACT)
    batches = [rows("a"), rows("b").where("id < 20")]
    merge = lambda df: partitioned.merge_partitions(spark, path, df, ["day", "id"], "day", order, written=True)
    assert _shuffles(spark, lambda: merge(batches[0])) == [1]  # a new partition is written in place
    assert _shuffles(spark, lambda: merge(batches[1])) == [1, 0]  # merged beside the table, put in place as it is
    got = {r.id: r.v for r in partitioned.read_partitioned(spark, path).collect()}
    assert got == {i: "b" if i < 20 else "a" for i in range(30)}


def test_upsert_keeps_what_an_incoming_key_holds(spark):
    """Without an order all incoming rows of a key replace all old ones, null keys too; partition values keep their text."""
    from ledgerwise.operators import partitioned

    path = _scratch() + "/fact"
    merge = lambda rows: partitioned.merge_partitions(
        spark, path, spark.createDataFrame(rows, "part string, id long, v string"), ["part", "id"], "part")
    merge([("x07", 1, "a"), ("x07", 1, "b"), ("x07", None, "c"), ("x08", 1, "d"), (None, 1, "e")])
    merge([("x07", None, "f"), ("x07", None, "g"), (None, 2, "h")])
    got = sorted(map(str, (tuple(r) for r in partitioned.read_partitioned(spark, path).collect())))
    assert got == sorted(map(str, [("x07", 1, "a"), ("x07", 1, "b"), ("x07", None, "f"), ("x07", None, "g"),
                                   ("x08", 1, "d"), (None, 1, "e"), (None, 2, "h")]))


def test_newest_load_shuffles_only_columns_that_are_read(spark):
    """the current rows' other columns are not carried through the shuffle."""
    rows = spark.createDataFrame([(1, "x" * 9, 5.0, 1), (1, "y" * 9, 7.0, 2), (2, "z" * 9, 1.0, 1)],
                                 "source_id long, invoice_number string, amount double, loaded_at int")
    rows.write.parquet(path := _scratch() + "/log")
    got = staging.latest_by_source(spark.read.parquet(path), "source_id", ["loaded_at"])
    assert sorted(got.select("source_id", "invoice_number").collect()) == [(1, "y" * 9), (2, "z" * 9)]
    total = got.agg(F.sum("amount"))
    assert total.first()[0] == 8.0
    assert "invoice_number" not in total._jdf.queryExecution().executedPlan().toString()


def test_waiting_invoices_are_split_in_one_pass(spark, seed, monkeypatch):
    """known and waiting invoices come from one written pass, not from one plan each."""
    store = staging.StateStore(spark, _scratch())
    until, made = dt.datetime(2026, 9, 1), []
    real = sync_jobs.materialize
    monkeypatch.setattr(sync_jobs, "materialize", lambda df, name: made.append(name) or real(df, name))
    sync_jobs.run_billing_sync(spark, seed, store, until, AS_OF, now=until)
    assert made == [] and store.read("pending_invoice").count() == 14
    sync_jobs.run_subscription_sync(spark, seed, store, until, AS_OF, now=until)
    assert made == ["invoices"] and store.read("pending_invoice").count() == 0
    assert store.read("fact_billing_monthly").count() > 0


def test_each_query_of_the_written_tables_runs_the_jobs(spark, monkeypatch):
    """What a query costs does not depend on the queries before it."""
    from ledgerwise import registry

    runs = []
    for job in ("run_subscription_sync", "run_billing_sync"):
        monkeypatch.setattr(sync_jobs, job, lambda s, src, store, *a, job=job, **k: runs.append((job, store.root)))
    stores = [registry._loaded_twice(spark, "/tables").root for _ in range(2)]
    assert stores[0] != stores[1]
    assert runs == [(job, root) for root in stores for job in ("run_subscription_sync", "run_billing_sync") * 2]
