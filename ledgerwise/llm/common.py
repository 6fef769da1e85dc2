"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: A word of the data contracts: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; Python workers of the session can import this package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Put the package root on the Python workers' path (where it is not installed)."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, _ROOT])


def release() -> None:
    """Return Arrow's unused memory to the system; a Python worker, kept for later tasks, else holds it."""
    pa.default_memory_pool().release_unused()


def text_of(col: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def with_row(df: DataFrame, **more: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside ``more``: no column can clash. Undo: ``row.*``."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def identity(*cols: str, text: str = "text") -> Column:
    """Tells rows apart that share a key but not their text."""
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)], F.md5(text_of(text)).alias("h"))


def id_filter(df: DataFrame, key: str, ids: DataFrame, buckets: int = 1 << 20) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (column ``key``, distinct, no nulls), before
    any shuffle of wide rows: a broadcast set of at most ``buckets`` hash values (a fixed
    size, whatever the data) drops most other rows in the scan, then an exact semi join
    decides. Exact at every size; with more ids than buckets only the first step gets weak.
    """
    b = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    few = ids.select(b.alias("_b")).distinct()
    near = df.withColumn("_b", b).join(F.broadcast(few), "_b", "left_semi").drop("_b")
    return near.join(ids.select(key), key, "left_semi")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (columns ``a``, ``b``, any orderable type).

    Large-star / small-star rounds, each written to the shared folder (no lineage growth,
    nothing on the driver but one count a round). A round only takes minima per node and
    joins on a node, so a hub with very many neighbours is pre-aggregated and its join
    partition can be split. Returns ``node``, ``root`` for every node of an edge, ``root``
    being the smallest node of the component.
    """
    cur = materialize(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of a node points to the node's smallest neighbour
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cur.select("u", "v").join(low.withColumnRenamed("u", "v"), "v").where("u <> m").select(
            "u", F.col("m").alias("v"))
        # small star: a node and its smaller neighbours point to the smallest of them
        large = materialize(large.union(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct(), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialize(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), name)
        # a forest of stars: every u has one v, and no v is itself a u
        bad = nxt.join(nxt.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        twice = 0 if bad else nxt.groupBy("u").count().where("count > 1").limit(1).count()
        cur = nxt
        if not bad and not twice:
            break
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

