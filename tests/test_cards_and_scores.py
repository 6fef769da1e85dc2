"""Cards with change and trend, and the six domain scores with a domain missing."""

import datetime as dt

import pytest

from ledgerwise.plans import domains, kpis


def test_cards_change_trend_and_missing_base(spark):
    cols = "a double, b double, c double, d double"
    cards = [("unpaid_customers", "a", "A", "customers", " Pelanggan", True), ("mrr", "b", "B", "IDR", "", False),
             ("dso", "c", "C", "days", " Hari", True), ("x", "d", "D", "%", "%", False)]
    now = spark.createDataFrame([(6.0, 1234567.0, 30.04, 0.0)], cols)
    was = spark.createDataFrame([(8.0, 0.0, 30.04, None)], cols)
    rows = {r["key"]: r for r in kpis.card_rows(now, was, cards).collect()}
    a, b, c, d = (rows[k] for k in ("unpaid_customers", "mrr", "dso", "x"))
    assert (a["formatted_value"], a["change_percentage"], a["trend"], a["status"]) == ("6 Pelanggan", -25.0, "down", "warning")
    assert (b["formatted_value"], b["change_percentage"], b["trend"], b["status"]) == ("Rp 1,234,567", None, "up", "good")
    assert (c["value"], c["formatted_value"], c["change_percentage"], c["trend"], c["status"]) == (
        30.0, "30.0 Hari", 0.0, "flat", "warning")  # the status reads the unrounded value
    assert (d["formatted_value"], d["change_percentage"], d["trend"]) == ("0.0%", None, "flat")
    assert [rows[k]["position"] for k in rows] and sorted(r["position"] for r in rows.values()) == [0, 1, 2, 3]


def test_known_by_keeps_undated_rows_and_the_day_itself(spark):
    day = dt.date(2026, 3, 1)
    frames = {}
    for name, col in [("dim_customer", "installation_date"), ("stg_customer_subscription", "start_date"),
                      ("stg_sales_invoice", "invoice_date"), ("stg_sales_payment", "payment_date")]:
        frames[name] = spark.createDataFrame(
            [(1, day), (2, None), (3, day + dt.timedelta(days=1))], f"id int, {col} date")
    cut = kpis.known_by(frames, "2026-03-01")
    for name in frames:
        assert sorted(r["id"] for r in cut[name].collect()) == [1, 2]


def test_a_missing_domain_leaves_the_index_to_the_others(spark):
    subs = spark.createDataFrame([(1, "ACTIVE"), (2, "active"), (3, "TERMINATED"), (4, None)], "source_id int, status string")
    inv = spark.createDataFrame([(1, dt.date(2026, 1, 5), 100.0), (2, dt.date(2027, 1, 5), 50.0)],
                                "source_id int, due_date date, total_amount double")
    pay = spark.createDataFrame([(1, "SUCCESS", 80.0)], "sales_invoice_id int, payment_status string, amount double")
    t = {"stg_customer_subscription": subs, "stg_sales_invoice": inv, "stg_sales_payment": pay}
    d = {
        "po_lines": spark.createDataFrame([(7, dt.date(2026, 1, 1), dt.date(2026, 1, 20)), (7, dt.date(2026, 1, 1), dt.date(2026, 3, 20))],
                                          "vendor_id int, order_date date, receipt_date date"),
        "ledger": spark.createDataFrame([], "warehouse_id int, item_id int, day date, qty_in double, qty_out double, "
                                            "l_orderkey long, l_linenumber int, unit_price double"),
        "part": spark.createDataFrame([(1, 8), (2, 10)], "p_partkey int, p_size int"),
        "events": spark.createDataFrame([], "event_id long, event_type string, value double"),
    }
    row = domains.composite_health(domains.domain_scores(t, d, "2026-06-01"), domains.DOMAIN_WEIGHTS).first()
    assert (row["finance"], row["commercial"], row["procurement"], row["assets"]) == (80.0, 50.0, 50.0, 50.0)
    assert row["inventory"] is None and row["service"] is None
    assert row["health_index"] == pytest.approx((80 * .25 + 50 * .2 + 50 * .15 + 50 * .1) / .7)
    empty = {k: v.where("false") for k, v in t.items()}, {k: v.where("false") for k, v in d.items()}
    row = domains.composite_health(domains.domain_scores(*empty, "2026-06-01"), domains.DOMAIN_WEIGHTS).first()
    assert row["health_index"] is None
