"""Data quality checks and the quality log (survey 2.C).

All checks over one DataFrame run as one aggregate pass (null cells and
negative cells per field, plus the row count); the log rows are then built
from that single result row. Checks never block a load.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts of the quality log.
EMPTY_CHECK = "null_check_empty_payload"
EMPTY_DETAILS = "No records received for validation."


def _py_list(fields) -> str:
    return "[" + ", ".join(f"'{f}'" for f in fields) + "]"


def quality_checks(df: DataFrame, table: str, not_null=(), non_negative=()) -> DataFrame:
    """One row per check: ``check_name, table_name, status, details``.

    C1 counts NULL cells over the required fields (PASS iff 0, else FAIL);
    C2 counts cells < 0 (NULL passes); C3: an empty input gives one WARN row
    instead of the null check.
    """
    return check_rows(df.agg(*check_measures(not_null, non_negative)), table, not_null, non_negative)


def check_measures(not_null=(), non_negative=()) -> list[Column]:
    """The aggregates behind the checks: a separate pass, or observed while the rows are written."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(F.col(c).isNull().cast("long")).alias(f"_null_{c}") for c in not_null]
    return aggs + [F.sum(F.when(F.col(c) < 0, 1).otherwise(0)).alias(f"_neg_{c}") for c in non_negative]


def check_rows(one: DataFrame, table: str, not_null=(), non_negative=()) -> DataFrame:
    """C1-C3 from one row of ``check_measures``."""
    rows = []
    n = F.col("_n")
    if not_null:
        nulls = sum((F.coalesce(F.col(f"_null_{c}"), F.lit(0)) for c in not_null), F.lit(0))
        name = "null_check_" + "_".join(not_null)
        rows.append(F.when(n == 0, F.struct(F.lit(EMPTY_CHECK).alias("check_name"), F.lit("WARN").alias("status"),
                                            F.lit(EMPTY_DETAILS).alias("details")))
                    .otherwise(F.struct(F.lit(name).alias("check_name"),
                                        F.when(nulls == 0, "PASS").otherwise("FAIL").alias("status"),
                                        F.format_string("Verified %d rows. Violations: %d null fields.", n, nulls)
                                        .alias("details"))))
    if non_negative:
        negs = sum((F.coalesce(F.col(f"_neg_{c}"), F.lit(0)) for c in non_negative), F.lit(0))
        name = "non_negative_check_" + "_".join(non_negative)
        rows.append(F.struct(F.lit(name).alias("check_name"),
                             F.when(negs == 0, "PASS").otherwise("FAIL").alias("status"),
                             F.format_string(f"Verified %d rows for non-negative {_py_list(non_negative)}. "
                                             "Negative values: %d.", n, negs).alias("details")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select(
        "r.check_name", F.lit(table).alias("table_name"), "r.status", "r.details")


def record_quality(checks: DataFrame, batch_id: str | None, checked_at: dt.datetime | None = None) -> DataFrame:
    """C4: log rows (append these to ``data_quality_log``)."""
    ts = (checked_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).strftime("%Y-%m-%d %H:%M:%S")
    return checks.select(
        F.xxhash64(F.lit(str(batch_id)), "check_name", "table_name", F.lit(ts)).alias("id"),
        F.lit(None if batch_id is None else str(batch_id)).cast("string").alias("batch_id"),
        "check_name", "table_name", "status", "details",
        F.lit(ts).cast("timestamp_ntz").alias("checked_at"),
    )


def quality_report(log: DataFrame, status: str | None = None, table: str | None = None,
                   limit: int | None = 20) -> DataFrame:
    """Optional status (upper-cased) and table filters, newest first."""
    q = log
    if status:
        q = q.where(F.col("status") == status.upper())
    if table:
        q = q.where(F.col("table_name") == table)
    q = q.orderBy(F.desc("checked_at"), F.desc("id"))
    return q.limit(limit) if limit else q


def check_fk(child: DataFrame, parent: DataFrame, key: str, parent_key: str, table: str) -> DataFrame:
    """Orphan foreign keys (non-NULL child keys without a parent) as one check row.

    Only the distinct child keys are shuffled against the parent keys.
    """
    keys = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_rows"))
    orphans = keys.join(parent.select(F.col(parent_key).alias("_k")).distinct(), "_k", "left_anti")
    agg = orphans.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("orphan_rows"),
                      F.count(F.lit(1)).alias("orphan_keys"))
    return agg.select(
        F.lit(f"fk_integrity_{table}").alias("check_name"), F.lit(table).alias("table_name"),
        F.when(F.col("orphan_rows") == 0, "PASS").otherwise("FAIL").alias("status"),
        F.format_string("Orphan rows: %d (distinct keys: %d).", "orphan_rows", "orphan_keys").alias("details"),
    )


def empty_quality_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id long, batch_id string, check_name string, table_name string, "
                                     "status string, details string, checked_at timestamp_ntz")
