"""Extraction -> dims -> facts -> features -> labels -> drivers on the seed, plus state invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF
from ledgerwise.operators import churn, dims, facts, features, staging
from ledgerwise.sources import erp

UNTIL = dt.datetime(2026, 9, 1)


@pytest.fixture(scope="module")
def chain(seed):
    recs = erp.extract_subscriptions(seed["customer_subscription"], seed["customer"], seed["internet_package"],
                                     None, UNTIL)
    dimp = dims.upsert_package(None, recs, AS_OF)
    dimc = dims.scd2_merge(None, recs, AS_OF)
    snap = facts.fact_subscription_snapshot(recs, dimc, dimp, AS_OF, "b1")
    invs = erp.extract_invoices(seed["sales_invoice"], seed["customer_subscription"], seed["sales_payment"],
                                None, UNTIL, AS_OF)
    bills = facts.fact_billing_monthly(invs, dimc, "b1")
    feats = features.build_churn_features(snap, dimc, dimp, bills, AS_OF, "b1")
    labels = features.make_churn_labels(feats, AS_OF)
    return {"recs": recs, "dimc": dimc, "dimp": dimp, "snap": snap, "invs": invs, "bills": bills, "feats": feats,
            "labels": labels}


def test_days_late(chain):
    late = {r["source_id"]: r["days_late"] for r in chain["invs"].where("days_late != 0").collect()}
    assert late == {10: 5, 11: 48, 12: 17, 14: 29}


def test_features(chain):
    f = {r["customer_id"]: r for r in chain["feats"].collect()}
    r = f[1004]
    assert (r["late_payment_count_3m"], r["late_payment_count_6m"], r["avg_payment_delay_days_3m"],
            r["payment_status_trend"], r["tenure_months"]) == (3, 3, 23.3, "WORSENING", 27.4)
    r = f[1005]
    assert (r["late_payment_count_3m"], r["late_payment_count_6m"], r["avg_payment_delay_days_3m"],
            r["payment_status_trend"], r["tenure_months"]) == (1, 1, 29.0, "IMPROVING", 29.8)
    others = [f[c] for c in f if c not in (1004, 1005)]
    assert all(o["late_payment_count_3m"] == 0 and o["avg_payment_delay_days_3m"] == 0.0
               and o["payment_status_trend"] == "STABLE" for o in others)


def test_labels(chain):
    churned = {r["customer_id"]: r["churn_date"] for r in chain["labels"].where("churned").collect()}
    assert churned == {1004: dt.date(2026, 9, 8), 1005: dt.date(2026, 9, 9)}


def test_drivers(chain):
    d = churn.risk_drivers(chain["feats"]).where("customer_id = 1004").first()["top_risk_factors"]
    assert [x["feature"] for x in d] == ["late_payment_count_3m", "payment_status_trend", "avg_payment_delay_days_3m"]
    assert [x["importance_weight"] for x in d] == [0.35, 0.28, 0.22]
    assert all(len(r["top_risk_factors"]) <= 3 for r in churn.risk_drivers(chain["feats"]).collect())


def test_reference_driver_fixture(spark):
    df = spark.createDataFrame([(3, 4, 18.5, "WORSENING", 4.0, 1250000.0)],
                               "late_payment_count_3m int, late_payment_count_6m int, "
                               "avg_payment_delay_days_3m double, payment_status_trend string, "
                               "tenure_months double, monthly_fee_current double")
    d = churn.risk_drivers(df).first()["top_risk_factors"]
    assert [x["feature"] for x in d] == ["late_payment_count_3m", "payment_status_trend", "avg_payment_delay_days_3m"]


def test_fact_snapshot(chain):
    s = chain["snap"]
    assert s.count() == 8
    assert s.where("is_active").count() == 6
    assert s.where("tenure_days < 0").count() == 0


def test_scd2_two_versions(spark):
    b1 = spark.createDataFrame([(1, 7, "A", "X", dt.date(2026, 1, 1), "ACTIVE", dt.datetime(2026, 1, 1))],
                               "source_id long, customer_id long, customer_name string, city string, "
                               "installation_date date, status string, source_updated_at timestamp_ntz")
    d1 = dims.scd2_merge(None, b1, dt.date(2026, 1, 1))
    b2 = b1.withColumn("status", F.lit("SUSPENDED")).withColumn("source_updated_at",
                                                                  F.lit("2026-06-01 00:00:00").cast("timestamp_ntz"))
    d2 = dims.scd2_merge(d1, b2, dt.date(2026, 6, 1))
    rows = dims.version_history(d2, 7).orderBy("version").collect()
    assert [(r["status"], r["valid_to"], r["is_current"]) for r in rows] == [
        ("ACTIVE", dt.date(2026, 6, 1), False), ("SUSPENDED", None, True)]
    assert all(r["chain_ok"] for r in rows)
    # same batch again: no new version (idempotent)
    d3 = dims.scd2_merge(d2, b2, dt.date(2026, 6, 1))
    assert d3.count() == 2
    # a second change on the same day overwrites instead of opening a zero-length version
    b3 = b2.withColumn("city", F.lit("Y"))
    d4 = dims.scd2_merge(d2, b3, dt.date(2026, 6, 1))
    assert d4.count() == 2 and d4.where("is_current").first()["city"] == "Y"
    # a late (older) batch cannot reopen history
    old = b1.withColumn("status", F.lit("ACTIVE")).withColumn("source_updated_at",
                                                               F.lit("2025-12-01 00:00:00").cast("timestamp_ntz"))
    d5 = dims.scd2_merge(d2, old, dt.date(2026, 7, 1))
    assert d5.where("is_current").first()["status"] == "SUSPENDED" and d5.count() == 2


def test_upsert_idempotent_and_last_wins(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    inc = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, o int")
    once = staging.upsert(t, inc, ["k"], dedupe_order=["o"]).drop("o") if False else None
    inc2 = staging.dedupe_last(inc, ["k"], ["o"]).drop("o")
    once = staging.upsert(t, inc2, ["k"])
    twice = staging.upsert(once, inc2, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_latest_by_source(spark):
    stg = spark.createDataFrame([(1, 10.0, "b1", dt.datetime(2026, 1, 1)), (1, 12.0, "b2", dt.datetime(2026, 2, 1)),
                                 (2, 5.0, "b1", dt.datetime(2026, 1, 1))],
                                "source_id int, amount double, batch_id string, loaded_at timestamp_ntz")
    out = {r["source_id"]: r["amount"] for r in staging.latest_by_source(stg).collect()}
    assert out == {1: 12.0, 2: 5.0}
