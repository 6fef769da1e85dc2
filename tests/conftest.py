import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from ledgerwise.session import local_session  # noqa: E402

AS_OF = dt.date(2026, 9, 1)


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", shuffle_partitions=8)
    yield s
    s.stop()


def D(v):
    return Decimal(v).quantize(Decimal("0.01"))


# Seed ERP rows (8 customers, 14 invoices, 11 payments) from the reference's seed description.
SUBS = [  # id, customer, package, start, fee, billing_day, status
    (1, 1001, 4, "2024-02-01", 1250000, 1, "ACTIVE"), (2, 1002, 3, "2024-04-15", 550000, 15, "ACTIVE"),
    (3, 1003, 2, "2024-05-10", 385000, 10, "ACTIVE"), (4, 1004, 3, "2024-06-01", 550000, 1, "SUSPENDED"),
    (5, 1005, 1, "2024-03-20", 275000, 20, "TERMINATED"), (6, 1006, 2, "2024-07-01", 385000, 1, "ACTIVE"),
    (7, 1007, 5, "2024-01-10", 4500000, 10, "ACTIVE"), (8, 1008, 1, "2024-08-15", 275000, 15, "ACTIVE"),
]
PAY_DATES = {1: "06-10", 2: "07-12", 3: "08-14", 4: "06-28", 5: "07-29", 6: "08-20", 7: "06-20", 8: "07-22",
             9: "08-24", 10: "06-20", 13: "07-02"}
STATUS = {11: "OVERDUE", 12: "UNPAID", 14: "UNPAID"}


def _d(s):
    return dt.date.fromisoformat(s)


def seed_rows():
    subs = {s[0]: s for s in SUBS}
    invoices = []
    iid = 0
    for sid, months in [(1, (6, 7, 8)), (2, (6, 7, 8)), (3, (6, 7, 8)), (4, (6, 7, 8)), (5, (6, 7))]:
        for m in months:
            iid += 1
            _, cust, _, _, fee, bday, _ = subs[sid]
            inv_date = dt.date(2026, m, bday)
            invoices.append((iid, sid, cust, f"INV-{iid:03d}", dt.date(2026, m, 1), inv_date,
                             inv_date + dt.timedelta(days=14), D(fee), STATUS.get(iid, "PAID"),
                             dt.datetime(2026, m, bday, 12, 0, 0)))
    payments = []
    for pid, (iid, md) in enumerate(sorted(PAY_DATES.items()), start=1):
        inv = invoices[iid - 1]
        pd_ = _d(f"2026-{md}")
        payments.append((pid, iid, f"PAY-{pid:03d}", "TRANSFER", pd_, inv[7], "SUCCESS",
                         dt.datetime(pd_.year, pd_.month, pd_.day, 9, 0, 0)))
    return invoices, payments


@pytest.fixture(scope="session")
def seed(spark):
    invoices, payments = seed_rows()
    cities = ["Jakarta", "Bandung", "Surabaya", "Medan", None, "Jakarta", "Bandung", "Depok"]
    cust = spark.createDataFrame(
        [(1000 + i, f"Customer {i}", cities[i - 1], _d(SUBS[i - 1][3]), SUBS[i - 1][6],
          dt.datetime(2026, 5, 1)) for i in range(1, 9)],
        "id long, customer_name string, city string, installation_date date, status string, "
        "updated_at timestamp_ntz")
    pkg = spark.createDataFrame(
        [(1, "Home 30", 30, D(275000)), (2, "Home 50", 50, D(385000)), (3, "Home 100", 100, D(550000)),
         (4, "Biz 200", 200, D(1250000)), (5, "Dedicated 1G", 1000, D(4500000))],
        "id int, package_name string, speed_mbps int, monthly_price decimal(18,2)")
    sub = spark.createDataFrame(
        [(s[0], s[1], s[2], f"SUB-{s[0]:03d}", _d(s[3]), None, D(s[4]), s[5], s[6], dt.datetime(2024, 1, 1),
          dt.datetime(2026, 5, 1)) for s in SUBS],
        "id long, customer_id long, package_id int, subscription_no string, start_date date, end_date date, "
        "monthly_fee decimal(18,2), billing_day int, status string, created_at timestamp_ntz, "
        "updated_at timestamp_ntz")
    inv = spark.createDataFrame(
        invoices, "id long, customer_subscription_id long, customer_id long, invoice_number string, "
                  "invoice_period date, invoice_date date, due_date date, total_amount decimal(18,2), "
                  "payment_status string, updated_at timestamp_ntz")
    pay = spark.createDataFrame(
        payments, "id long, sales_invoice_id long, payment_number string, payment_method string, "
                  "payment_date date, amount decimal(18,2), payment_status string, created_at timestamp_ntz")
    return {"customer": cust, "internet_package": pkg, "customer_subscription": sub, "sales_invoice": inv,
            "sales_payment": pay}


@pytest.fixture(scope="session")
def seed_wh(seed):
    """Warehouse tables (staging + current dims) of the seed, as one full load leaves them."""
    from pyspark.sql import functions as F

    sub, inv, pay, cust, pkg = (seed[k] for k in ("customer_subscription", "sales_invoice", "sales_payment",
                                                    "customer", "internet_package"))
    return {
        "stg_customer_subscription": sub.select("id", F.col("id").alias("source_id"), "customer_id", "package_id",
                                                "subscription_no", "start_date", "end_date", "monthly_fee",
                                                "billing_day", "status"),
        "stg_sales_invoice": inv.select("id", F.col("id").alias("source_id"), "customer_subscription_id",
                                        "invoice_number", "invoice_period", "invoice_date", "due_date",
                                        "total_amount", "payment_status"),
        "stg_sales_payment": pay.select("id", F.col("id").alias("source_id"), "sales_invoice_id", "payment_date",
                                        "amount", "payment_status", "payment_method"),
        "dim_customer": cust.select(F.col("id").alias("customer_key"), F.col("id").alias("customer_id"),
                                    "customer_name", "city", "installation_date", "status",
                                    F.col("installation_date").alias("valid_from"),
                                    F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current")),
        "dim_package": pkg.select(F.col("id").alias("package_key"), F.col("id").alias("package_id"),
                                  "package_name", "speed_mbps", "monthly_price",
                                  F.lit(True).alias("is_current")),
    }
