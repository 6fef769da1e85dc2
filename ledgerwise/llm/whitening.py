"""Whitening of embeddings with MLlib's distributed block matrices.

Vectors become fixed-point integers, so sums per dimension, and with them the centred rows
n * x - S, are exact and do not depend on the order of the rows. The centred rows are indexed
into an ``IndexedRowMatrix`` and cut into a ``BlockMatrix`` of row blocks; the transpose times
the matrix is the scatter, whose few numbers go to ``numpy.linalg.eigh``; the block matrix
times the whitening matrix (eigenvectors over the roots of their eigenvalues) projects all rows.

The driver holds matrices of dim x dim and the coordinates of the blocks (two integers for
every ``BLOCK_BYTES`` of rows). The transpose product is split along the rows, a task a block,
and the tasks' small products are summed; a plain ``multiply`` would send all rows to one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

COMPONENTS = 8
#: Fixed point: x = floor(SCALE * component) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Bytes of a block of rows; an eigenvalue below this share of the largest is rounding, not variance.
BLOCK_BYTES, LEAST_SHARE = 4 << 20, 1e-10

SCHEMA = "n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"


def complete(col: str) -> Column:
    """A vector that is not null and holds neither null nor non-finite components."""
    bad = F.exists(F.col(col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def fixed_point(col: str, scale: int = SCALE, offset: int = OFFSET) -> Column:
    return F.transform(F.col(col), lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(offset).cast("long"))


def indexed(rows: DataFrame) -> DataFrame:
    """``rows``, written, with ``index`` from 0 without gaps: no sort, no shuffle. The places
    within a written part are stable; one count a part gives its start."""
    low = (1 << 33) - 1
    done = materialize(rows.withColumn("_mid", F.monotonically_increasing_id()), "fixed_point")
    part = F.shiftright("_mid", 33)
    counts = done.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))  # a row a written part
    at = (F.col("_start") + F.col("_mid").bitwiseAND(F.lit(low))).cast("long")
    return done.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("index", at).drop(
        "_mid", "_part", "_start")


def block_matrix(rows: DataFrame, n: int, dim: int) -> BlockMatrix:
    """``rows`` (``index``, ``vector`` of doubles) as row blocks of about ``BLOCK_BYTES``."""
    vectors = rows.select("index", array_to_vector("vector").alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, dim)
    return matrix.toBlockMatrix(max(1, BLOCK_BYTES // (8 * dim)), dim)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """transpose(rows) x rows, dim x dim; the tasks split the rows among them."""
    splits = -(-blocks.numRows() // blocks.rowsPerBlock)
    left, right = blocks.transpose(), blocks
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def project(blocks: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """rows x weights as ``index``, ``projected``."""
    sc = blocks.blocks.ctx
    dim, k = weights.shape
    right = BlockMatrix(sc.parallelize([((0, 0), Matrices.dense(dim, k, weights.ravel(order="F").tolist()))], 1), dim, k)
    rows = blocks.multiply(right).toIndexedRowMatrix()
    frame = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(frame, "vector").select("index", vector_to_array("vector").alias("projected"))


def spectrum(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues that are not rounding, falling, and their unit vectors in columns,
    each with its largest entry positive."""
    e, v = np.linalg.eigh((covariance + covariance.T) / 2)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    real = e > max(e[0], 0) * LEAST_SHARE if len(e) else np.zeros(0, bool)
    e, v = e[real], v[:, real]
    return e, v * np.where(v[np.abs(v).argmax(axis=0), np.arange(len(e))] < 0, -1, 1)


def _whiten_length(rows: DataFrame, dim: int, components: int) -> DataFrame:
    rows = indexed(rows)
    sums = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(
        F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("at").collect()  # dim rows
    n = sums[0]["n"]
    s = F.array(*[F.lit(r["s"]).cast("long") for r in sums])
    off = F.zip_with("x", s, lambda x, total: x * F.lit(n).cast("long") - total)  # n * (x - mean), exact
    square = lambda d: d.cast("decimal(19,0)") * d.cast("decimal(19,0)")
    deviation = F.aggregate("off", F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + square(d)).cast("decimal(38,0)"))
    rows = rows.withColumn("off", off)
    blocks = block_matrix(rows.select("index", F.transform("off", lambda d: d / F.lit(float(n))).alias("vector")), n, dim)
    covariance = scatter(blocks) / n
    e, vectors = spectrum(covariance, components)
    k = len(e)
    if not k:  # all vectors are equal: no direction has a variance
        return rows.select("key", *_nulls()).limit(0)
    done = materialize(project(blocks, vectors / np.sqrt(e)), "whitened")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    measured = done.agg(*[F.covar_pop(F.col("projected")[i], F.col("projected")[j]) for i, j in pairs]).first()
    error = max(abs(measured[p] - (i == j)) for p, (i, j) in enumerate(pairs))
    share = F.array(*[F.lit(float(x)) for x in e / np.trace(covariance)])
    return rows.select("index", "key", deviation.alias("deviation")).join(done, "index").select(
        "key", F.lit(n).cast("long").alias("n"), "deviation", F.col("projected").alias("whitened"),
        share.alias("explained"), F.lit(float(error)).alias("identity_error"))


def _nulls() -> list[Column]:
    return [F.lit(None).cast(t.split(" ", 1)[1]).alias(t.split(" ", 1)[0]) for t in SCHEMA.split(", ")]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """One row per vector that takes part: ``key``, ``n`` (vectors of the fit), ``deviation`` (the sum of
    (n * x - S)^2, exact), ``whitened`` (its coordinates on the first ``components`` principal
    components, variance 1 each), ``explained`` (their shares of the variance) and
    ``identity_error`` (largest entry of the measured covariance of ``whitened`` less the identity).

    Rows take part unless the vector is null, empty or holds null or non-finite components; repeated
    rows and null keys count like any. Vectors of different lengths have no common covariance:
    every length is whitened by itself. There are fewer than ``components`` coordinates where the
    vectors span fewer directions, and no rows where all are equal; empty in, empty out. Fixed-point
    values or deviations beyond their types raise Spark's arithmetic errors.
    """
    good = vectors.where(complete(vector) & (F.size(vector) > 0)).select(
        F.col(key).alias("key"), fixed_point(vector, scale, offset).alias("x"))
    lengths = [r["dim"] for r in good.select(F.size("x").alias("dim")).distinct().orderBy("dim").collect()]
    out = good.select("key", *_nulls()).limit(0)
    for dim in lengths:
        out = out.unionByName(_whiten_length(good.where(F.size("x") == dim), dim, components))
    return out.withColumnRenamed("key", key)
