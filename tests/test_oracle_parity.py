"""Registered queries against their DuckDB oracle on the smallest driver tables.

The full gate over every query is ``tools/parity.py`` (sf0.01); this keeps one
query per survey section in the test suite, compared the same way (column
names, then rows sorted, floats to 6 dp).
"""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "a06_extract_invoices", "a10_stream_invoice_sync", "b04_upsert_billing", "c01_c03_quality_checks",
    "d01_scd2_two_batches", "d06_lookup_asof", "d07_version_history", "e02_fact_billing_monthly",
    "f06_churn_features", "f07_downgrade_flags",
    "f11_temporal_split", "g_finance_kpis", "g19_period_change", "h01_revenue_vs_payment", "h08_ar_aging",
    "i07_payment_discrepancies", "j10_j12_metrics_fixed_score", "j17_risk_drivers",
    "j15_j16_tier_rank_fixed_score", "k04_parse_replies", "l11_ledger_balance", "l09_depletion_projection",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from parity import TABLES

    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_DIR}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    yield con
    con.close()


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    from parity import rows_of

    sdf = E.queries()[name](spark, SF_DIR)
    scols, srows = sdf.columns, [tuple(r) for r in sdf.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    ocols, orows = rel.columns, rel.fetchall()
    assert sorted(scols) == sorted(ocols)
    order = sorted(scols)
    a = rows_of([tuple(r[scols.index(c)] for c in order) for r in srows])
    b = rows_of([tuple(r[ocols.index(c)] for c in order) for r in orows])
    assert len(a) == len(b)
    assert a == b


def test_every_query_has_an_oracle_but_the_fitted_model():
    from ledgerwise import oracle, registry

    missing = sorted(set(registry.QUERIES) - set(oracle.SQL))
    assert missing == ["j12_validation_metrics", "j13_feature_importance", "j14_score_batch"]


def test_plan_audit_flags_bad_plans_and_passes_bounded_ones(spark):
    from plan_audit import audit, plan_text
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    one_task = orders.withColumn("rn", F.row_number().over(Window.orderBy("o_orderdate")))
    assert any("single partition" in n for n in audit(plan_text(one_task)))
    pairs = orders.select("o_orderkey").crossJoin(orders.select(F.col("o_custkey").alias("c")))
    assert audit(plan_text(pairs))
    monthly = orders.groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    assert audit(plan_text(monthly.withColumn("cum", F.sum("n").over(Window.orderBy("m"))))) == []


def test_registered_plans_pass_the_audit(spark):
    from plan_audit import audit, plan_text

    from ledgerwise import registry

    # the sample by default; LEDGERWISE_FULL_AUDIT=1 audits every query (tools/plan_audit.py does too)
    names = SAMPLE if not os.environ.get("LEDGERWISE_FULL_AUDIT") else list(registry.QUERIES)
    flagged = {}
    for name in names:
        if name in ("j12_validation_metrics", "j13_feature_importance", "j14_score_batch"):  # fit a model
            continue
        fn = registry.QUERIES[name]
        notes = audit(plan_text(fn(spark, SF_DIR)))
        if notes:
            flagged[name] = notes
    assert flagged == {}
