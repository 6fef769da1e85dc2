"""Column-expression helpers shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status sets used by the business rules.
UNPAID_STATUSES = ("UNPAID", "OVERDUE", "PARTIAL")
OVERDUE_STATUSES = ("UNPAID", "OVERDUE")
CHURN_PROXY_STATUSES = ("CANCELLED", "SUSPENDED", "TERMINATED", "INACTIVE")
SUCCESS = "SUCCESS"
ACTIVE = "ACTIVE"
PAID = "PAID"
# Indonesian VAT (PPN) share inside a gross amount: total * 0.11 / 1.11.
VAT_RATE = 0.11


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(d: str | dt.date | Column) -> Column:
    """A date literal (or pass a column through)."""
    if isinstance(d, Column):
        return d
    return F.lit(str(d)).cast("date")


def upper_in(c: str | Column, *values: str) -> Column:
    """``UPPER(c) IN (...)``; NULL stays NULL, which filters as false."""
    return F.upper(col(c)).isin(*values)


def upper_eq(c: str | Column, value: str) -> Column:
    return F.upper(col(c)) == value


def month_key(c: str | Column) -> Column:
    """``YYYY-MM`` text of a date."""
    return F.date_format(col(c), "yyyy-MM")


def day_text(c: str | Column) -> Column:
    """``YYYY-MM-DD`` text of a date."""
    return F.date_format(col(c), "yyyy-MM-dd")


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """Whole days ``later - earlier`` (date subtraction)."""
    return F.datediff(col(later), col(earlier))


def money(c: str | Column) -> Column:
    """Money leaves the library as DOUBLE; sums are taken in DECIMAL first."""
    return col(c).cast("double")


def money_sum(c: str | Column) -> Column:
    """``COALESCE(SUM(c), 0)`` summed exactly in DECIMAL, returned as DOUBLE."""
    return F.coalesce(F.sum(col(c)), F.lit(0)).cast("double")


def safe_ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """``num / den * scale`` or 0.0 when the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double") * F.lit(scale)).otherwise(F.lit(0.0))


def cust_code(c: str | Column) -> Column:
    """Display id ``CUST-0042``."""
    return F.format_string("CUST-%04d", col(c))


def rupiah(c: str | Column) -> Column:
    """Display amount ``Rp 1,234,567`` (HALF_EVEN at whole rupiah)."""
    return F.concat(F.lit("Rp "), F.format_number(col(c).cast("double"), 0))


def days_text(c: str | Column) -> Column:
    """Display ``n hari`` (days)."""
    return F.concat(col(c).cast("string"), F.lit(" hari"))
