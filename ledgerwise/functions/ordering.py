"""Global row positions without a single-partition window.

``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task.
Instead the rows are range-sorted across all tasks, each row gets its
(partition, offset) from ``monotonically_increasing_id``, and a table of
per-partition counts (one row per partition, so bounded by the partition
count, not the data) turns that into a dense 0-based position.

The sorted rows, with their ids, are written once to the shared checkpoint
folder first, so the positions stay stable even if an executor is lost and
tasks re-run (and the sort is computed once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_LOW_BITS = (1 << 33) - 1


def global_position(df: DataFrame, order_cols, name: str = "pos") -> DataFrame:
    """Add a 0-based position column following ``order_cols`` (make them unique)."""
    sorted_df = materialize(df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id()), "positions")
    tagged = sorted_df.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_off", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    return tagged.join(F.broadcast(starts), "_part").withColumn(
        name, (F.col("_start") + F.col("_off")).cast("long")).drop("_mid", "_part", "_off", "_start")


def running_totals(df: DataFrame, order_cols, sum_cols, descending: bool = False,
                  keys=(), how: str = "sum") -> DataFrame:
    """Inclusive running sums (or maxima, ``how='max'``) of ``sum_cols`` along ``order_cols``,
    per ``keys`` (or over the whole DataFrame); results in ``cum_<col>``.

    Same scheme as ``global_position``: a range sort on ``(keys, order)``
    spreads the rows over all tasks - a hot key spans as many range partitions
    as its rows need instead of landing in one task. Each (partition, key)
    piece gets its running value from a window local to that piece, and the
    key's pieces in earlier partitions give its starting value (their sum, or
    their max). The offsets table has one row per (partition, key) piece, so it
    is bounded by the number of keys plus the number of partitions, and a
    key's offsets window by the number of partitions it spans. Both
    aggregates are associative, which is what makes the split exact.
    """
    if how not in ("sum", "max"):
        raise ValueError("how must be 'sum' or 'max'")
    agg = F.sum if how == "sum" else F.max
    keys = list(keys)
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    sorted_df = materialize(df.orderBy(*keys, *order).withColumn("_mid", F.monotonically_increasing_id()), "running")
    tagged = sorted_df.withColumn("_part", F.shiftright("_mid", 33))
    totals = tagged.groupBy(*keys, "_part").agg(*[agg(c).alias(f"_t_{c}") for c in sum_cols])
    w_parts = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = [agg(f"_t_{c}").over(w_parts) for c in sum_cols]
    if how == "sum":
        before = [F.coalesce(b, F.lit(0)) for b in before]
    starts = totals.select(*keys, "_part", *[b.alias(f"_s_{c}") for b, c in zip(before, sum_cols)])
    w_in = Window.partitionBy("_part", *keys).orderBy("_mid").rowsBetween(Window.unboundedPreceding,
                                                                         Window.currentRow)
    # Without keys the offsets table has one row per partition: broadcast it. With keys it
    # grows with the number of keys, so it joins by (partition, key) - the same clustering
    # the in-piece window needs, so the join's shuffle serves the window too.
    if keys:
        # null-safe on the keys: a NULL key is one group, as in a window
        st = starts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"),
                           *[f"_s_{c}" for c in sum_cols])
        cond = [F.col("_part") == F.col("_p")] + [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        out = tagged.join(st, cond).drop("_p", *[f"_k_{k}" for k in keys])
    else:
        out = tagged.join(F.broadcast(starts), "_part")
    for c in sum_cols:
        here = agg(c).over(w_in)
        # greatest() skips NULLs: a key with no earlier value starts from its own
        cum = F.col(f"_s_{c}") + here if how == "sum" else F.greatest(F.col(f"_s_{c}"), here)
        out = out.withColumn(f"cum_{c}", cum)
    return out.drop("_mid", "_part", *[f"_s_{c}" for c in sum_cols])
