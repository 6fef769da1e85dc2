"""Exact quantiles without a task that holds all values.

``percentile`` gathers every distinct value of a column in one final task. Here the values are
counted per distinct value (partial counts per task), a running total over the values in order,
range-split over all tasks, gives each its ranks, and a quantile is picked by rank. All columns
go through the same pass as (column, value) rows; a column of very many values spans as many
range partitions as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running_totals


def exact_quantiles(df: DataFrame, columns: dict[str, Column] | list[str], probs: list[float]) -> DataFrame:
    """One row per column: ``column``, ``n`` (values that are not null) and ``quantiles``, an array
    in the order of ``probs`` with linear interpolation between neighbouring ranks.

    NULLs are left out; NaN is the greatest value. A column without values has n = 0 and NULL quantiles.
    """
    cols = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    if not cols or not all(0 <= p <= 1 for p in probs):
        raise ValueError("columns and probabilities between 0 and 1 are needed")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), e.cast("double").alias("value")) for c, e in cols.items()])
    counts = df.select(F.explode(pairs).alias("r")).select("r.*").where(F.col("value").isNotNull()).groupBy(
        "column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, ["value"], ["n"], keys=["column"])  # cum_n: values up to and with this one
    # rank of a quantile: p * (n - 1), between the values at its floor and its ceiling
    total = ranked.groupBy("column").agg(F.max("cum_n").alias("total"))
    rank = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
    picks = []
    for i, r in enumerate(rank):
        picks += [F.min(F.when(F.col("cum_n") > F.floor(r), F.col("value"))).alias(f"lo{i}"),
                  F.min(F.when(F.col("cum_n") > F.ceil(r), F.col("value"))).alias(f"hi{i}")]
    got = ranked.join(F.broadcast(total), "column").groupBy("column").agg(F.max("total").alias("total"), *picks)  # a row a column
    between = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (r - F.floor(r)) for i, r in enumerate(rank)]
    exact = [F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise(b) for i, b in enumerate(between)]
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    found = got.select("column", F.col("total").alias("n"), F.array(*exact).alias("quantiles"))
    return names.join(found, "column", "left").select(
        "column", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "quantiles")
