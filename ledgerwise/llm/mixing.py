"""Mixing sources to target weights by systematic sampling.

Every document has an expected number of copies. Within a source the expected copies are
prefix-summed, one random offset is added, and a document is emitted once for each integer
boundary that its interval crosses: it gets the floor or the ceiling of its expectation, and
the source's total is within one copy of the expected total. Documents stand in the order of
their sizes (ties in hashed order), so every size class is sampled at the same rate and the
words taken stay within about one document of the target.

All sums are exact: expected copies are integers in units of 2**-32.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import global_position, running_totals
from .common import materialize, with_row, word_count

UNIT = 1 << 32
# -- fixed values: weights by place of the source, repeating; share of all sizes; most repeats
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target`` from rows of ``source``, ``size``.

    Sources stand by code point, null last. Targets share ``share`` of all sizes by weight;
    none exceeds ``most`` times its source's size, and what is cut off goes to the others by
    weight until none is above. Each round reads a few sums of the per-source table.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = global_position(per, [F.col("source").asc_nulls_last()], "place")
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % n + 1).cast("int"))
    per = materialize(placed.select("source", "source_size", weight.alias("weight"),
                                    (F.col("source_size") * F.lit(most)).alias("cap")), "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    budget, level = share * total, 0.0
    while True:  # water level: an uncapped source gets level * weight; each round caps more sources
        over = F.col("cap") <= F.col("weight") * F.lit(level)
        capped, rest = per.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if not rest:
            break
        higher = max(0.0, budget - (capped or 0.0)) / rest
        if higher <= level:
            break
        level = higher
    return per.select("source", "source_size", "weight",
                      F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def systematic_copies(docs: DataFrame, group: str, expected: str, order: list[str], seed: int = 0) -> DataFrame:
    """Add ``copies``: how many integer boundaries a row's interval of the prefix sums crosses.

    ``expected``: a column of whole units (``UNIT`` = one copy), not negative. The prefix sums
    range-split a hot group over tasks. The offset is a hash of the group and ``seed``, so
    reruns agree. Sums are decimals, so no length of a group overflows.
    """
    df = docs.withColumn("_e", F.col(expected).cast("decimal(38,0)"))
    summed = running_totals(df, order, ["_e"], keys=[group])
    offset = F.pmod(F.xxhash64(F.coalesce(F.col(group).cast("string"), F.lit("\0")), F.lit(seed)), F.lit(UNIT))
    end = F.col("cum__e") + offset.cast("decimal(38,0)")
    unit = F.lit(UNIT).cast("decimal(38,0)")
    whole = lambda c: F.floor((c - c % unit) / unit).cast("long")
    return summed.withColumn("copies", whole(end) - whole(end - F.col("_e"))).drop("_e", "cum__e")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """One row per document: ``key``, ``source``, ``size`` (words), ``source_size``, ``target``,
    ``copies`` and ``taken`` (words that the mix takes, repeats counted).

    A null text has size 0; a null source is a source of its own, the last; a source without
    words takes nothing; repeated rows are documents of their own; empty in, empty out.
    Texts are read once and never shuffled.
    """
    sizes = materialize(docs.select(F.col(key).alias("key"), F.col(source).alias("source"),
                                    word_count(text).alias("size")), "sizes")
    targets = source_targets(sizes, weights, share, most).select(
        F.col("source").alias("_src"), "source_size", "target")
    # one row per source: equal expected copies for all documents of a source
    units = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") * UNIT),
                                                     F.lit(int(most * UNIT)))).otherwise(F.lit(0)).cast("long")
    joined = sizes.join(targets, F.col("source").eqNullSafe(F.col("_src"))).drop("_src").withColumn("units", units)
    joined = joined.withColumn("mixed", F.xxhash64(F.col("key"), F.lit(seed)))
    out = systematic_copies(joined, "source", "units", ["size", "mixed", "key"], seed)
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target",
                      "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, mixed: DataFrame, row_id: Column, key: str) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as many times as it was taken.

    ``mixed``: what ``mix`` returned for the rows' ids ``key``; ``row_id``: the same id as an
    expression on ``docs``. Rows that share an id share its copies as evenly as can be.
    """
    plan = mixed.groupBy(key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    plan = materialize(plan.where("copies > 0"), "plan").withColumnRenamed(key, "taken_id")
    rows = with_row(docs, id=row_id).join(plan, F.col("id").eqNullSafe(F.col("taken_id")))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("id"))
    own = F.expr("cast(copies div rows + if(nth <= copies % rows, 1, 0) as int)")
    times = rows.withColumn("nth", nth).withColumn("own", own).where("own > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("copy")).select("row.*")
