"""Bounded parallel JDBC reads (no server), exact quantiles, the scoring job, tuning by time, table audit."""

import datetime as dt
import itertools
import json
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwise.functions.quantiles import exact_quantiles
from ledgerwise.operators import churn, staging
from ledgerwise.plans import scoring_job
from ledgerwise.sources import erp

PG, MY = "jdbc:postgresql://host/db", "jdbc:mysql://host/db"


# -- A1 ----------------------------------------------------------------------------------
@pytest.mark.parametrize("low,high,parts", [(0, 99, 7), (-50, 50, 10), (5, 5, 4), (1, 3, 8), (0, 10**12, 16), (None, None, 4)])
def test_range_predicates_read_every_row_once(spark, low, high, parts):
    preds = erp.range_predicates("id", low, high, parts)
    assert len(preds) <= parts
    a, b = (0, 9) if low is None else (low, high)
    ids = sorted({a, b, a - 5, b + 7, (a + b) // 2, *range(a, min(b, a + 200) + 1)})
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "id long")
    hits = [r[0] for r in df.select(sum(F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in preds)).collect()]
    assert hits == [1] * len(hits)  # keys outside the probed range and NULLs too


def test_hash_predicates_speak_the_source_dialect():
    my = erp.hash_predicates(MY, "code", 3)
    assert my == ["MOD(CRC32(CAST(code AS CHAR)), 3) = 0 OR code IS NULL", "MOD(CRC32(CAST(code AS CHAR)), 3) = 1",
                  "MOD(CRC32(CAST(code AS CHAR)), 3) = 2"]
    pg = erp.hash_predicates(PG, "code", 2)
    assert pg[1] == "MOD(ABS(HASHTEXT(CAST(code AS TEXT))::BIGINT), 2) = 1" and len(pg) == 2


def test_jdbc_plan_probes_once_and_refuses_one_task_reads():
    asked = []

    def probe(n, *ends):
        return lambda q: (asked.append(q), (n, *ends))[1]

    assert erp.jdbc_plan(PG, "invoice", probe(100)) is None  # small: one task may read it
    parts = erp.jdbc_plan(PG, "invoice", probe(5_000_000, 1, 5_000_000), partition_column="id")
    assert len(parts) == 5 and parts[1] == "id >= 1000001 AND id < 2000001"
    assert asked[-1] == "SELECT COUNT(*), MIN(id), MAX(id) FROM invoice" and len(asked) == 2
    assert len(erp.jdbc_plan(MY, "invoice", probe(10**12), hash_column="code")) == erp.MAX_PARTITIONS
    with pytest.raises(ValueError, match="partition column"):
        erp.jdbc_plan(PG, "invoice", probe(5_000_000))


def test_jdbc_options():
    assert erp.jdbc_options({"url": MY, "user": "u"}) == {
        "url": MY, "user": "u", "driver": "com.mysql.cj.jdbc.Driver", "fetchsize": "10000"}
    assert erp.jdbc_options({"url": PG, "fetchsize": "5"})["fetchsize"] == "5"
    with pytest.raises(ValueError):
        erp.jdbc_options({"url": "jdbc:oracle:x"})


# -- J2, J3 ------------------------------------------------------------------------------
def test_exact_quantiles_against_numpy(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=501), rng.integers(0, 4, 501).astype(float)
    rows = [(float(x), float(y) if i % 5 else None, None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r["column"]: r for r in exact_quantiles(df, ["a", "b", "c"], probs).collect()}
    assert got["a"].quantiles == pytest.approx(np.quantile(a, probs).tolist(), rel=1e-12)
    assert got["b"].quantiles == pytest.approx(np.quantile([y for _, y, _ in rows if y is not None], probs).tolist())
    assert (got["a"].n, got["b"].n, got["c"].n, got["c"].quantiles) == (501, 400, 0, None)
    empty = exact_quantiles(df.limit(0), {"twice": F.col("a") * 2}, [0.5]).collect()
    assert [(r["column"], r.n, r.quantiles) for r in empty] == [("twice", 0, None)]
    one = exact_quantiles(df.limit(1), {"k": F.lit(3)}, [0.25, 0.5]).first()
    assert one.quantiles == [3.0, 3.0]
    with pytest.raises(ValueError):
        exact_quantiles(df, ["a"], [1.5])


# -- J14, C7 -----------------------------------------------------------------------------
FEATURES = ("snapshot_date date, customer_id long, tenure_months double, monthly_fee_current decimal(18,2), package_speed_mbps int, "
            "late_payment_count_3m int, late_payment_count_6m int, avg_payment_delay_days_3m double, payment_status_trend string, "
            "downgrade_flag_6m boolean, batch_id string")


def feature_rows(days, n, rng):
    return [(d, i, float(rng.integers(1, 40)), None, 30, int(rng.integers(0, 4)), int(rng.integers(0, 7)), float(rng.integers(0, 30)),
             ["STABLE", "WORSENING", "IMPROVING"][i % 3], bool(i % 2), "b") for d in days for i in range(n)]


def test_scoring_job_writes_once_per_snapshot(spark):
    store = staging.StateStore(spark, tempfile.mkdtemp(prefix="lw-test-", dir="/tmp"))
    score = lambda f: f.withColumn("p", F.col("customer_id") / F.lit(20.0))
    with pytest.raises(LookupError):
        scoring_job.run_scoring(store, score)
    days = [dt.date(2026, 1, 1), dt.date(2026, 2, 1)]
    feat = spark.createDataFrame(feature_rows(days, 20, np.random.default_rng(1)), FEATURES)
    store.merge("feature_customer_churn", feat, ["snapshot_date", "customer_id"], "snapshot_date")
    now = dt.datetime(2026, 2, 1, 3)
    got = scoring_job.run_scoring(store, score, "1.0.0", now=now)
    assert got["snapshot_date"] == days[1] and got["total_evaluated"] == got["rows_saved"] == 20
    assert (got["high_risk_count"], got["medium_risk_count"], got["low_risk_count"], got["status"]) == (6, 8, 6, "PASS")
    once = sorted(map(str, store.read(scoring_job.PREDICTIONS).collect()))
    assert scoring_job.run_scoring(store, score, "1.0.0", now=now) == got
    assert sorted(map(str, store.read(scoring_job.PREDICTIONS).collect())) == once  # a second run changes nothing
    audit = store.read_log("data_quality_log").collect()
    assert len(audit) == 1 and audit[0].check_name == "batch_churn_prediction_audit"
    assert audit[0].details == "Evaluated 20 customers. High=6, Med=8, Low=6, MeanProb=0.475"
    # another snapshot leaves this one alone; one that lost customers keeps no stale rows
    scoring_job.run_scoring(store, score, "1.0.0", days[0], now)
    staging.write_snapshot(feat.where("snapshot_date = DATE '2026-01-01' AND customer_id < 5"),
                           f"{store.root}/feature_customer_churn/rows", "snapshot_date")
    scoring_job.run_scoring(store, score, "1.1.0", days[0], now)
    n = {r["snapshot_date"]: r["count"] for r in store.read(scoring_job.PREDICTIONS).groupBy("snapshot_date").count().collect()}
    assert n == {days[0]: 5, days[1]: 20}
    none = scoring_job.run_scoring(store, score, "1.0.0", dt.date(2030, 1, 1), now)
    assert none["total_evaluated"] == 0 and none["average_churn_probability"] == 0.0 and none["status"] == "PASS"


# -- J8 ----------------------------------------------------------------------------------
def test_folds_follow_time_and_auc_per_group(spark):
    days = [dt.date(2026, m, 1) for m in (1, 2, 3, 4)]
    rows = feature_rows(days, 12, np.random.default_rng(2))
    df = spark.createDataFrame(rows, FEATURES).withColumn("label", (F.col("late_payment_count_3m") >= 2).cast("int"))
    assert churn.temporal_folds(df, 2) == days[2:] and churn.temporal_folds(df, 9) == days[1:]
    for day in churn.temporal_folds(df, 9):
        train, val = churn.fold_sides(df, day)
        assert train.agg(F.max("snapshot_date")).first()[0] < day and val.select("snapshot_date").distinct().count() == 1
    rng = np.random.default_rng(3)
    scored = [(g, float(rng.integers(0, 5)), int(rng.integers(0, 2))) for g in range(3) for _ in range(60)] + [(9, 1.0, 1)]
    got = {r.g: r.auc for r in churn.auc_by(spark.createDataFrame(scored, "g int, score double, label int"), ["g"]).collect()}
    for g in range(3):
        pos, neg = ([s for h, s, y in scored if h == g and y == k] for k in (1, 0))
        assert got[g] == pytest.approx(np.mean([(p > n) + (p == n) / 2 for p, n in itertools.product(pos, neg)]))
    assert got[9] is None


def test_temporal_tuning_finds_the_best_point(spark):
    rows = feature_rows([dt.date(2026, 1, 1), dt.date(2026, 2, 1)], 60, np.random.default_rng(5))
    df = spark.createDataFrame(rows, FEATURES).withColumn(
        "label", ((F.col("late_payment_count_3m") + F.col("customer_id") % 3) >= 3).cast("int"))
    grid = {"max_depth": [1, 4], "n_estimators": [2]}
    got = churn.temporal_tuning(df, grid, folds=2, preset="fast_prototype").collect()
    train, val = churn.fold_sides(df, dt.date(2026, 2, 1))
    brute = {}
    for depth in (1, 4):
        model = churn.fit_churn(train, "fast_prototype", {"max_depth": depth, "n_estimators": 2})
        scored = [(r.s, r.label) for r in churn.churn_probability(model, val, "s").collect()]
        pos, neg = ([s for s, y in scored if y == k] for k in (1, 0))
        brute[depth] = np.mean([(p > n) + (p == n) / 2 for p, n in itertools.product(pos, neg)])
    assert {json.loads(r.params)["max_depth"]: r.auc for r in got} == pytest.approx(brute)
    assert json.loads(got[0].params)["max_depth"] == max(brute, key=brute.get) and got[0].folds == 1
    with pytest.raises(ValueError):
        churn.temporal_tuning(df.where("snapshot_date = DATE '2026-01-01'"), grid)


# -- A13 ---------------------------------------------------------------------------------
def test_audit_summary_totals_and_missing(spark):
    rows = [("b", "READY", 5), ("a", "MISSING", 0), ("c", "MISSING", 0)]
    got = {r.table_name: (r.status, r.row_count, r.tables, r.missing_tables)
           for r in erp.audit_summary(spark.createDataFrame(rows, "table_name string, status string, row_count long")).collect()}
    assert got == {"a": ("MISSING", 0, 1, "a"), "b": ("READY", 5, 1, ""), "c": ("MISSING", 0, 1, "c"), "TOTAL": ("MISSING", 5, 3, "a,c")}
