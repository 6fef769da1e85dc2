"""ERP-shaped tables derived from the driver's TPC-H-like tables.

The business tables (subscriptions, invoices, payments, customer dimension,
package dimension) do not exist in the test data, so they are derived from
``customer``, ``nation`` and ``orders`` by integer arithmetic only. Every column
is a plain projection of one scan (plus one dimension lookup), so the derived
tables partition exactly like their parent tables and grow with them.

The same rules are written once more as SQL text in ``ledgerwise.oracle`` so
that DuckDB can check every query; keep the two in step.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# The reference day of the derived data: the orders run 1995-01-01 .. 2001-08-01.
AS_OF = dt.date(2001, 8, 2)

# The four catalogue packages (id, name, speed in Mbps, price).
# Package 5 is left out on purpose so that lookups miss for some subscriptions.
PACKAGES = [
    (1, "Home 30", 30, 275000),
    (2, "Home 50", 50, 385000),
    (3, "Home 100", 100, 550000),
    (4, "Biz 200", 200, 1250000),
]

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table through the generic source reader (A1)."""
    from .erp import read_source

    return read_source(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", "parquet")


def _date(d: str) -> Column:
    return F.lit(d).cast("date")


# The derivation rules are SQL expressions evaluated by ``selectExpr``: one JVM
# call per projection instead of several per column function, and the same
# text as the DuckDB oracle wherever the dialects agree.
_STATUS = ("CASE WHEN c_custkey % 25 < 20 THEN 'ACTIVE' WHEN c_custkey % 25 < 23 THEN 'SUSPENDED' "
           "ELSE 'TERMINATED' END")
_INSTALL = "date_add(DATE'1999-01-01', CAST(c_custkey * 37 % 940 AS INT))"
_DAYS_AFTER = "timestampadd(DAY, CAST(c_custkey * {m} % 200 AS INT), TIMESTAMP_NTZ'2001-01-01 00:00:00')"
_GRP = "((o_custkey % 77) % 10)"
_PAY_LAG = (f"CAST(CASE WHEN {_GRP} < 6 THEN o_orderkey % 14 + CASE WHEN o_orderkey % 17 = 0 THEN 20 ELSE 0 END "
            "ELSE 10 + o_orderkey % 40 END AS INT)")


def subscriptions(customer: DataFrame) -> DataFrame:
    """ERP ``customer_subscription`` rows: one per customer, a second one for every tenth."""
    main = customer.selectExpr(
        "c_custkey + 1 AS id",
        "c_custkey + 1001 AS customer_id",
        "CAST(c_custkey % 5 AS INT) + 1 AS package_id",
        f"CASE WHEN c_custkey % 97 = 0 THEN CAST(NULL AS DATE) ELSE {_INSTALL} END AS start_date",
        "CAST(250000 + 100000 * (c_custkey % 5 + 1) AS DECIMAL(18,2)) AS monthly_fee",
        "CAST(c_custkey % 28 AS INT) + 1 AS billing_day",
        f"{_STATUS} AS status",
        f"CASE WHEN c_custkey % 89 = 0 THEN CAST(NULL AS TIMESTAMP_NTZ) ELSE {_DAYS_AFTER.format(m=7)} END AS updated_at",
    )
    second = customer.where("c_custkey % 10 = 0").selectExpr(
        "c_custkey + 1000001 AS id",
        "c_custkey + 1001 AS customer_id",
        "5 AS package_id",
        "DATE'2000-06-01' AS start_date",
        "CAST(4500000 AS DECIMAL(18,2)) AS monthly_fee",
        "1 AS billing_day",
        "'ACTIVE' AS status",
        f"{_DAYS_AFTER.format(m=7)} AS updated_at",
    )
    return main.unionByName(second).selectExpr(
        "id", "customer_id", "package_id",
        "concat('SUB/', CAST(id AS STRING)) AS subscription_no",
        "start_date",
        "CAST(NULL AS DATE) AS end_date",
        "monthly_fee", "billing_day", "status",
        "COALESCE(CAST(start_date AS TIMESTAMP_NTZ), TIMESTAMP_NTZ'2000-06-01 00:00:00') AS created_at",
        "updated_at",
    )


def erp_customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """ERP ``customer`` rows (id is the business customer id)."""
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").selectExpr(
        "c_custkey + 1001 AS id",
        "concat('CUST-', CAST(c_custkey + 1001 AS STRING)) AS customer_code",
        "c_name AS customer_name",
        "CASE WHEN c_custkey % 53 = 0 THEN CAST(NULL AS STRING) ELSE n_name END AS city",
        f"{_INSTALL} AS installation_date",
        f"{_STATUS} AS status",
        f"{_DAYS_AFTER.format(m=11)} AS updated_at",
    )


def packages(spark: SparkSession) -> DataFrame:
    """ERP ``internet_package`` catalogue (a fixed dimension of four rows, built JVM-side)."""
    values = ", ".join(f"({i}, '{n}', {sp}, CAST({p} AS DECIMAL(18,2)))" for i, n, sp, p in PACKAGES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(id, package_name, speed_mbps, monthly_price)")


def invoices(orders: DataFrame) -> DataFrame:
    """ERP ``sales_invoice`` rows: one per order (order keys kept for the payment rules)."""
    return orders.selectExpr(
        "o_orderkey + 1 AS id",
        "CASE WHEN o_custkey % 10 = 0 AND o_orderkey % 3 = 0 THEN o_custkey + 1000001 ELSE o_custkey + 1 END "
        "AS customer_subscription_id",
        "o_custkey + 1001 AS customer_id",
        "concat('INV/', CAST(o_orderkey + 1 AS STRING)) AS invoice_number",
        "trunc(to_date(o_orderdate), 'month') AS invoice_period",
        "to_date(o_orderdate) AS invoice_date",
        "CASE WHEN o_orderkey % 101 = 0 THEN CAST(NULL AS DATE) ELSE date_add(to_date(o_orderdate), 14) END AS due_date",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount",
        f"CASE WHEN o_orderkey % 211 = 0 THEN 'paid' "
        f"WHEN {_GRP} < 6 OR ({_GRP} < 8 AND o_orderkey % 3 <> 0) OR o_orderstatus = 'F' THEN 'PAID' "
        "WHEN o_orderstatus = 'P' THEN 'PARTIAL' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'OVERDUE' "
        "ELSE 'UNPAID' END AS payment_status",
        "timestampadd(HOUR, CAST(o_orderkey % 24 AS INT), o_orderdate) AS updated_at",
        "o_orderkey",
        "o_custkey",
    )


def payments(inv: DataFrame) -> DataFrame:
    """ERP ``sales_payment`` rows: one per PAID / PARTIAL invoice, computed from the invoice row."""
    return inv.where("upper(payment_status) IN ('PAID', 'PARTIAL')").selectExpr(
        "id",
        "id AS sales_invoice_id",
        "concat('PAY/', CAST(id AS STRING)) AS payment_number",
        "element_at(array('TRANSFER', 'VIRTUAL_ACCOUNT', 'AUTO_DEBIT', 'CASH'), CAST(o_orderkey % 4 + 1 AS INT)) "
        "AS payment_method",
        f"date_add(invoice_date, {_PAY_LAG}) AS payment_date",
        "CASE WHEN upper(payment_status) = 'PAID' THEN total_amount "
        "ELSE CAST(floor(total_amount * CAST(0.5 AS DECIMAL(2,1))) AS DECIMAL(18,2)) END AS amount",
        "CASE WHEN o_orderkey % 50 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS payment_status",
        f"timestampadd(HOUR, CAST(o_orderkey % 24 AS INT), CAST(date_add(invoice_date, {_PAY_LAG}) AS TIMESTAMP_NTZ)) "
        "AS created_at",
    )


class LazyTables(dict):
    """A dict whose values are built on first access (only the tables a query uses are planned)."""

    def __init__(self, builders: dict):
        super().__init__()
        self._builders = builders

    def __missing__(self, key):
        value = self._builders[key]()
        self[key] = value
        return value

    def __contains__(self, key):
        return key in self._builders

    def keys(self):
        return self._builders.keys()


def erp_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five ERP source tables, lazily derived from the driver tables."""
    raw = LazyTables({n: (lambda n=n: read_raw(spark, sf_dir, n)) for n in ("customer", "nation", "orders")})
    t: LazyTables

    def inv_full():
        return invoices(raw["orders"])

    t = LazyTables({
        "customer": lambda: erp_customers(raw["customer"], raw["nation"]),
        "internet_package": lambda: packages(spark),
        "customer_subscription": lambda: subscriptions(raw["customer"]),
        "_inv_full": inv_full,
        "sales_invoice": lambda: t["_inv_full"].drop("o_orderkey", "o_custkey"),
        "sales_payment": lambda: payments(t["_inv_full"]),
    })
    return t


def warehouse_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Staging and current-dimension views as a single full load would leave them.

    Keys: ``stg_customer_subscription``, ``stg_sales_invoice``,
    ``stg_sales_payment``, ``dim_customer`` (current rows), ``dim_package``.
    Tables are planned on first access only.
    """
    erp = erp_tables(spark, sf_dir)

    def stg_sub():
        return erp["customer_subscription"].select(
            "id", F.col("id").alias("source_id"), "customer_id", "package_id", "subscription_no", "start_date",
            "end_date", "monthly_fee", "billing_day", "status", F.col("updated_at").alias("source_updated_at"),
        )

    def stg_inv():
        return erp["sales_invoice"].select(
            "id", F.col("id").alias("source_id"), "customer_subscription_id", "invoice_number", "invoice_period",
            "invoice_date", "due_date", "total_amount", "payment_status",
            F.col("updated_at").alias("source_updated_at"),
        )

    def stg_pay():
        return erp["sales_payment"].select(
            "id", F.col("id").alias("source_id"), "sales_invoice_id", "payment_date", "amount", "payment_status",
            F.col("created_at").alias("source_created_at"), "payment_method",
        )

    def dim_customer():
        # Subscription status doubles as the customer status in the dimension (as in the source system).
        return erp["customer"].select(
            F.col("id").alias("customer_key"),
            F.col("id").alias("customer_id"),
            "customer_name",
            "city",
            "installation_date",
            "status",
            F.col("installation_date").alias("valid_from"),
            F.lit(None).cast("date").alias("valid_to"),
            F.lit(True).alias("is_current"),
            F.col("updated_at").alias("source_updated_at"),
        )

    def dim_package():
        return erp["internet_package"].select(
            F.col("id").alias("package_key"),
            F.col("id").alias("package_id"),
            "package_name",
            "speed_mbps",
            "monthly_price",
            _date("1999-01-01").alias("valid_from"),
            F.lit(None).cast("date").alias("valid_to"),
            F.lit(True).alias("is_current"),
        )

    return LazyTables({
        "stg_customer_subscription": stg_sub,
        "stg_sales_invoice": stg_inv,
        "stg_sales_payment": stg_pay,
        "dim_customer": dim_customer,
        "dim_package": dim_package,
    })


# ---- accounting and stock, derived from the same tables ----------------------------------
# The chart of accounts used by the derived journal (code, name, type).
ACCOUNTS = [
    (1, "1001", "Kas Operasional Bank BCA", "ASSET"),
    (3, "1101", "Piutang Pelanggan Internet", "ASSET"),
    (5, "2001", "Utang Usaha Supplier", "LIABILITY"),
    (6, "4001", "Pendapatan Langganan Internet", "REVENUE"),
    (7, "5001", "Beban Bandwidth Transit / NAP", "EXPENSE"),
]
CASH, AR, AP, REVENUE, EXPENSE = 1, 3, 5, 6, 7


def accounts(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"({i}, '{c}', '{n}', '{t}')" for i, c, n, t in ACCOUNTS)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(id, account_code, account_name, account_type)")


def journal_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``journal_entry`` / ``journal_entry_line`` / ``account`` from invoices, payments and purchases.

    Invoice: AR debit / revenue credit on the invoice date. Successful payment:
    cash debit / AR credit on the payment date. Purchase order (lineitem lines
    of an order, net of discount, summed per order): expense debit / AP credit
    on the order date. Entry id = order key * 4 + kind; line id = entry id * 2 + side.
    """
    erp = erp_tables(spark, sf_dir)
    inv = erp["_inv_full"]
    pay = payments(inv).where(F.col("payment_status") == "SUCCESS")
    li = read_raw(spark, sf_dir, "lineitem")
    orders = read_raw(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    # net line amount in exact decimal arithmetic, rounded half-up to cents
    net = (F.col("l_extendedprice").cast(MONEY) * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast(MONEY)
    purchases = li.groupBy("l_orderkey").agg(F.sum(net).cast(MONEY).alias("amt")).join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 4 + 3).alias("entry_id"), F.col("d").alias("entry_date"), "amt",
        F.lit(EXPENSE).alias("dr"), F.lit(AP).alias("cr"), F.lit("PO").alias("kind"))
    inv_e = inv.select((F.col("o_orderkey") * 4 + 1).alias("entry_id"), F.col("invoice_date").alias("entry_date"),
                       F.col("total_amount").alias("amt"), F.lit(AR).alias("dr"), F.lit(REVENUE).alias("cr"),
                       F.lit("INV").alias("kind"))
    pay_e = pay.select(((F.col("id") - 1) * 4 + 2).alias("entry_id"), F.col("payment_date").alias("entry_date"),
                       F.col("amount").alias("amt"), F.lit(CASH).alias("dr"), F.lit(AR).alias("cr"),
                       F.lit("PAY").alias("kind"))
    entries = inv_e.unionByName(pay_e).unionByName(purchases)
    je = entries.select(F.col("entry_id").alias("id"),
                        F.concat(F.lit("JRN-"), F.col("kind"), F.lit("-"), F.col("entry_id").cast("string"))
                        .alias("entry_no"), "entry_date")
    zero = F.lit(0).cast(MONEY)
    jel = entries.select(F.explode(F.array(
        F.struct((F.col("entry_id") * 2).alias("id"), F.col("dr").alias("account_id"),
                 F.col("amt").alias("debit"), zero.alias("credit")),
        F.struct((F.col("entry_id") * 2 + 1).alias("id"), F.col("cr").alias("account_id"),
                 zero.alias("debit"), F.col("amt").alias("credit")))).alias("l"), "entry_id").select(
        "l.id", F.col("entry_id").alias("journal_entry_id"), "l.account_id", "l.debit", "l.credit")
    return {"journal_entry": je, "journal_entry_line": jel, "account": accounts(spark)}


def stock_table(spark: SparkSession, sf_dir: str, opening: float = 20.0) -> DataFrame:
    """ERP ``stock`` (warehouse, item, quantity, last_updated) from the lineitem movements.

    Warehouse = supplier key % 5, item = part key; returned lines come back in,
    other lines go out; quantity = opening + in - out; last_updated = last ship day.
    """
    li = read_raw(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    delta = F.when(F.col("l_returnflag") == "R", q).otherwise(-q)
    return li.groupBy(F.pmod(F.col("l_suppkey"), F.lit(5)).cast("int").alias("warehouse_id"),
                      F.col("l_partkey").alias("item_id")).agg(
        (F.lit(opening) + F.sum(delta)).cast("long").alias("quantity"),
        F.max("l_shipdate").alias("last_updated"))
