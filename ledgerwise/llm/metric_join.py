"""Exact range join of embeddings in metric space, with links counted and components formed.

On unit vectors a cosine of at least c is a Euclidean distance of at most r = sqrt(2 - 2c).
Pivots partition the vectors of a label: each vector lives in the cell of its nearest pivot.
If x lives in cell i and a vector within r of x lives in cell j, the triangle inequality gives
d(x, p_j) <= d(x, p_i) + 2r. Among unit vectors the plane halfway between the two pivots says
it more sharply: x is no further than r, and so at an angle of no more than acos(c), from its
side j, which implies the former. So x is also replicated to such cells, and every vector meets
all its neighbours in its own cell. Cells join independently; large ones are cut into blocks,
and a task compares one block of residents with one block of a cell's vectors.

A vector is stored once with the list of its cells; replicas are ids until the blocks meet. How
many pivots a label gets is decided on a bounded sample: those that make comparisons and rows
moved cheapest. Vectors without structure, nearly equidistant in many dimensions, belong to all
cells of any partition, so their labels keep one cell and are joined block by block.

Equal vectors are collapsed first. A task returns a count per vector and a forest of its
links, never all pairs, so a large group of near copies costs rows in proportion to its size.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, ship

COSINE = 0.93
#: Vectors for each pivot, pivots altogether (a bounded sample, sent to all tasks), sampled vectors for each pivot.
CELL, PIVOTS, PROBES = 4096, 1024, 4
#: Rows of a block; pairs compared at once; comparisons that cost as much as moving one row; cost that more pivots must come under.
BLOCK, STRIP, MOVE, GAIN = 16384, 1 << 22, 128, 0.8

log = logging.getLogger(__name__)


def usable(col: str) -> Column:
    """A vector with at least one component that is not zero, all finite and none null."""
    v = F.col(col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Pivots:
    """Cells of unit vectors: the nearest pivot's, and those whose vectors may be in reach."""

    def __init__(self, points: np.ndarray, cosine: float):
        self.points = points
        # furthest that a vector may be from the plane between two pivots and have a neighbour behind it
        far = np.sqrt(1 - cosine * cosine) if cosine >= 0 else np.inf
        self.reach = far * np.sqrt(np.maximum(0, 2 - 2 * points @ points.T)) + 1e-7

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cell of each row; matrix of all its cells."""
        dot = x @ self.points.T
        home = dot.argmax(axis=1)
        return home, dot[np.arange(len(x)), home][:, None] - dot <= self.reach[home]


def best_pivots(points: np.ndarray, probes: np.ndarray, rows: float, cosine: float, block: int, move: float) -> Pivots | None:
    """The cheapest number of pivots for a label of about ``rows`` vectors, measured on
    ``probes``; None: one cell for all. More pivots than that must save a fifth."""
    def cost(asks: np.ndarray, answers: np.ndarray) -> float:
        moved = np.maximum(asks + answers, 2 * asks * answers / block)
        return (asks * answers).sum() + move * moved.sum()

    best, least, many = None, cost(np.array([rows]), np.array([rows])), 2
    while len(points) > 1 and len(probes):
        tried = Pivots(points[:many], cosine)
        home, near = tried.place(probes)
        share = rows / len(probes)
        now = cost(np.bincount(home, minlength=len(tried.points)) * share, near.sum(axis=0) * share)
        if now < GAIN * least:
            best, least = tried, now
        if many >= len(points):
            break
        many *= 2
    return best


def _cells(pivots: dict[tuple, Pivots]):
    """Adds the cells of each row (class, multiplicity, group, dim, vector), its home first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pdf = batch.select(["label", "dim", "vec"]).to_pandas()
            cells: list = [[0]] * len(pdf)
            for key, rows in pdf.groupby(["label", "dim"]).indices.items():
                own = pivots.get(tuple(int(k) for k in key))
                if own is None:
                    continue
                for lo in range(0, len(rows), 1024):
                    at = rows[lo:lo + 1024]
                    home, near = own.place(unit(pdf["vec"].iloc[at].tolist()))
                    near[np.arange(len(at)), home] = False
                    for r, h, others in zip(at.tolist(), home.tolist(), near):
                        cells[r] = [h, *np.flatnonzero(others).tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))],
                                             names=[*batch.schema.names, "cells"])

    return run


def unite(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the trees of ``u`` and ``v`` in the forest ``root`` (places; a root is its tree's smallest)."""
    while True:
        ru, rv = root[u], root[v]
        apart = ru != rv
        if not apart.any():
            return
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _compare(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, all_ = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        empty = pd.DataFrame({"c": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        if mine.empty or all_.empty:
            return empty
        x, y = unit(mine["vec"].tolist()), unit(all_["vec"].tolist()).T
        a, b, m = mine["c"].to_numpy(), all_["c"].to_numpy(), all_["m"].to_numpy().astype(np.float64)
        # counts and a forest of the block's links, strip by strip
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v, root = at[:len(a)], at[len(a):], np.arange(len(nodes))
        count, step = np.zeros(len(a), dtype=np.int64), max(1, STRIP // len(b))
        for lo in range(0, len(a), step):
            near = x[lo:lo + step] @ y >= cosine
            near &= a[lo:lo + step, None] != b[None, :]
            count[lo:lo + step] = near @ m
            i, j = np.nonzero(near)
            unite(root, u[lo + i], v[j])
        asked = np.flatnonzero(count)
        out = pd.DataFrame({"c": a[asked], "n": count[asked], "root": a[asked]})
        forest = pd.DataFrame({"c": nodes, "n": 0, "root": nodes[root]})
        return pd.concat([out, forest[forest["c"] != forest["root"]]], ignore_index=True)

    return run


def link_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label",
                 cosine: float = COSINE, cell: int = CELL, pivots: int = PIVOTS, block: int = BLOCK,
                 move: float = MOVE) -> DataFrame:
    """One row per vector: ``key``, ``n_links``, ``component_id``, ``kept``.

    Rows link when their ``group`` is equal and not null and their cosine, in double
    precision, is at least ``cosine``; equal vectors, repeated rows too, link. A vector that
    is null, empty, zero or holds null or non-finite components links with nothing, nor do
    vectors of different lengths. A null key counts as a link of others but never names a
    component of other keys. Empty in, empty out. The replication factor is logged.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = materialize(vectors.select(F.col(key).alias("key"), F.col(group).alias("label"), F.col(vector).alias("vec"),
                                      (usable(vector) & F.col(group).isNotNull()).alias("ok")), "vectors")
    good = rows.where("ok")
    classes = good.groupBy("label", "vec").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("rep"))
    classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")),
                          "classes")

    # a hashed sample: one vector in `cell` is a pivot, others are probes; `pivots` x PROBES vectors at most
    h, step = F.xxhash64("c", F.lit(3)), max(1, cell // PROBES)
    sample = classes.where(F.pmod(h, F.lit(step)) == 0).orderBy(h, "c").limit(pivots * PROBES).select(
        "label", "dim", "vec").collect()
    total = classes.count()
    drawn: dict[tuple, list] = {}
    for r in sample:
        drawn.setdefault((int(r["label"]), int(r["dim"])), []).append(r["vec"])
    chosen = {}
    for name, vecs in drawn.items():
        x, first = unit(vecs), -(-len(vecs) // PROBES)
        best = best_pivots(x[:first], x[first:], total * len(vecs) / len(sample), cosine, block, move)
        if best is not None:
            chosen[name] = best
    base = classes.select("c", "m", "label", "dim", "vec")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields)
    placed = materialize(base.mapInArrow(_cells(chosen), f"{schema}, cells array<int>"), "cells")

    # blocks of a cell: residents ask, all of the cell's vectors answer
    at = placed.select("label", "dim", F.posexplode("cells").alias("nth", "cell"))
    homes, replicas = F.sum((F.col("nth") == 0).cast("int")), F.count(F.lit(1))
    sizes = materialize(at.groupBy("label", "dim", "cell").agg(
        homes.alias("homes"), replicas.alias("replicas"), F.ceil(homes / block).cast("int").alias("askers"),
        F.ceil(replicas / block).cast("int").alias("answers")), "cell_sizes")
    moved = F.greatest(F.col("askers"), F.lit(1)) * F.col("replicas") + F.col("answers") * F.col("homes")
    seen = sizes.agg(F.sum("homes").alias("homes"), F.sum("replicas").alias("replicas"), F.sum(moved).alias("moved")).first()
    if seen["homes"]:
        log.info("%d vectors in %.2f cells each, %.2f rows moved for each", seen["homes"],
                 seen["replicas"] / seen["homes"], seen["moved"] / seen["homes"])
    asked = sizes.where("askers > 0").select("label", "dim", "cell", "askers", "answers")
    own = lambda n, salt: F.pmod(F.xxhash64("c", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["label", "dim", "cell", "c", "m", "vec"]
    asks = placed.withColumn("cell", F.col("cells")[0]).join(asked, ["label", "dim", "cell"]).select(
        *cols, own("askers", 1).alias("ask"), each("answers").alias("answer"), F.lit(True).alias("asks"))
    answers = placed.withColumn("cell", F.explode("cells")).join(asked, ["label", "dim", "cell"]).select(
        *cols, each("askers").alias("ask"), own("answers", 2).alias("answer"), F.lit(False).alias("asks"))
    found = materialize(asks.unionByName(answers).groupBy("label", "dim", "cell", "ask", "answer").applyInPandas(
        _compare(cosine), "c long, n long, root long"), "found")

    counts = found.groupBy("c").agg(F.sum("n").alias("n"))
    roots = components(found.where("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b")))
    done = classes.select("c", "label", "vec", "m", "rep").join(counts, "c", "left").join(
        roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    done = materialize(done, "linked")
    smallest = done.groupBy("root").agg(F.min("rep").alias("least"))
    per_class = materialize(done.join(smallest, "root").select(
        F.col("label").alias("_l"), F.col("vec").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"),
        "least"), "per_class")
    # rows that link with nothing stay out of the join: they have no key to be spread by
    same = (F.col("label") == F.col("_l")) & (F.col("vec") == F.col("_v"))
    hit = rows.where("ok").join(per_class, same, "left").select("key", "n_links", "least").unionByName(
        rows.where("not ok").select("key", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast(
            rows.schema["key"].dataType).alias("least")))
    out = hit.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     F.when(F.col("key").isNotNull(), F.coalesce("least", "key")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
