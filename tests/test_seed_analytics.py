"""KPIs, charts and audit tables on the 8-customer seed (answers computed by hand)."""

import pytest

from conftest import AS_OF
from ledgerwise.plans import audit, charts, kpis


def test_overview_kpis(seed_wh):
    r = kpis.overview_kpis(seed_wh, AS_OF).first()
    assert r["active_customers"] == 6
    assert r["mrr"] == 7_345_000
    assert r["unpaid_ar"] == 1_375_000
    assert r["net_cashflow"] == 7_380_000
    assert r["total_invoiced"] == 8_755_000
    assert round(r["collection_rate"], 1) == 84.3
    assert r["health_score"] == 82.4


def test_commercial_kpis(seed_wh):
    r = kpis.commercial_kpis(seed_wh, AS_OF).first()
    assert (r["active_customers"], r["active_subscriptions"], r["unpaid_customers"], r["churn_proxy"]) == (6, 6, 2, 2)
    assert r["mrr"] == 7_345_000
    assert r["avg_tenure_months"] == pytest.approx(28.6667, abs=1e-3)


def test_finance_kpis(seed_wh):
    r = kpis.finance_kpis(seed_wh).first()
    assert r["dso_days"] == 12.0
    assert r["tax_collected"] == pytest.approx(867_612.61, abs=0.01)
    assert r["count_invoices"] == 14 and r["partial_invoices"] == 0 and r["partial_payment_rate"] == 0.0


def test_revenue_vs_payment(seed_wh):
    rows = {r["month"]: (r["invoiced"], r["collected"]) for r in charts.revenue_vs_payment(seed_wh).collect()}
    assert rows["2026-06"] == (3_010_000, 2_735_000)
    assert rows["2026-07"] == (3_010_000, 2_460_000)
    assert rows["2026-08"] == (2_735_000, 2_185_000)


def test_ar_aging(seed_wh):
    rows = {r["bucket"]: (r["count"], r["amount"]) for r in charts.ar_aging(seed_wh, AS_OF).collect()}
    assert rows == {"0–30 Hari": (2, 825_000), "31–60 Hari": (1, 550_000)}
    four = charts.ar_aging(seed_wh, AS_OF, bounds=(30, 60, 90), labels=charts.AGING_LABELS_4)
    assert four.count() == 2


def test_package_mix_fallback_and_cumulative(seed_wh):
    mix = {r["package_name"]: r["subscriptions"] for r in charts.package_mix(seed_wh).collect()}
    assert sum(mix.values()) == 6
    cum = charts.customer_growth_cumulative(seed_wh).collect()
    assert cum[-1]["cumulative_customers"] == 8
    assert [r["cumulative_customers"] for r in cum] == sorted(r["cumulative_customers"] for r in cum)


def test_audit_tables(seed_wh):
    risk = audit.revenue_at_risk(seed_wh, AS_OF).collect()
    assert [(r["customer_id"], r["overdue_invoices"], r["total_overdue"], r["max_days_late"]) for r in risk] == [
        (1004, 2, 1_100_000, 48), (1005, 1, 275_000, 29)]
    assert audit.customers_without_sub(seed_wh).count() == 2
    disc = audit.payment_discrepancies(seed_wh).collect()
    assert {r["invoice_number"] for r in disc} == {"INV-011", "INV-012", "INV-014"}
    shown = audit.display_top_unpaid(seed_wh).first()
    assert shown["customer_id"] == "CUST-1004" and shown["total_unpaid_ar"] == "Rp 1,100,000"


def test_audit_selector():
    assert audit.resolve_audit_table("finance", "  Discrepancies ") == "payment_discrepancies"
    assert audit.resolve_audit_table("commercial", "unknown") == "top_unpaid"
    assert audit.resolve_audit_table("overview", None) == "revenue_at_risk_overview"
