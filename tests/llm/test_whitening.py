"""Whitening against numpy: exact sums, eigenvectors, measured covariance, edge cases."""

from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerwise.llm import queries, whitening

SF = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, label int"


def fixed(rows):
    return np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in rows], dtype=np.int64)


def compare(got, ids, x, k):
    n = len(x)
    s = x.sum(axis=0)
    off = n * x - s
    centred = off / n
    v = centred.T @ centred / n
    e, vec = np.linalg.eigh(v)
    e, vec = e[::-1][:k], vec[:, ::-1][:, :k]
    want = centred @ vec / np.sqrt(e)
    rows = defaultdict(dict)
    for r in got:
        rows[r.vec_id][r.component] = r
        assert r.n == n and r.identity_error <= 1e-4
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(v), rel=1e-9)
    assert set(rows) == set(ids)
    mine = np.array([[rows[i][c + 1].whitened for c in range(k)] for i in ids])
    sign = np.sign((mine * want).sum(axis=0))  # either sign, the same for all rows
    assert np.abs(mine * sign - want).max() < 1e-8
    for at, i in enumerate(ids):
        assert len(rows[i]) == k
        assert rows[i][1].deviation == sum(int(d) ** 2 for d in off[at])


def test_op13_against_numpy(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    got = queries.op13_whitening(spark, SF)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
                          ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    compare(got.collect(), t["vec_id"], fixed(t["embedding"]), 8)


def test_many_blocks_and_unequal_variances(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 10 * 8 * 12)  # 10 rows a block
    rng = np.random.default_rng(3)
    x = rng.normal(size=(457, 12)) * np.logspace(0, -2, 12) + 3.0
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VEC).repartition(5)
    got = whitening.whiten(df, components=5).collect()
    flat = [r_ for r in got for r_ in rows_of(r)]
    compare(flat, [r[0] for r in rows], fixed([r[1] for r in rows]), 5)


def rows_of(r):
    from pyspark.sql import Row

    return [Row(vec_id=r.vec_id, component=i + 1, n=r.n, deviation=int(r.deviation), whitened=w, explained=r.explained[i],
                identity_error=r.identity_error) for i, w in enumerate(r.whitened)]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    base = [(i, [float(i % 3), float(i % 5), 1.0], 1) for i in range(30)]
    bad = [(100, None, 1), (101, [], 1), (102, [1.0, None, 2.0], 1), (103, [nan, 1.0, 1.0], 1), (104, [inf, 0.0, 0.0], 1)]
    odd = [(200, [1.0, 2.0], 1), (201, [1.0, 2.0], 2)]  # another length, all equal: no component
    rows = base + [base[0], (None, [2.0, 4.0, 1.0], None)] + bad + odd
    got = whitening.whiten(spark.createDataFrame(rows, VEC).selectExpr("*", "'x' AS key", "1 AS index", "2 AS n")).collect()
    assert len(got) == 32 and {r.n for r in got} == {32}
    # two of the three dimensions vary: two components
    assert {len(r.whitened) for r in got} == {2} and max(r.identity_error for r in got) < 1e-8
    assert sorted(r.vec_id for r in got if r.vec_id is not None) == sorted([*range(30), 0])
    twice = [r.whitened for r in got if r.vec_id == 0]
    assert twice[0] == pytest.approx(twice[1])
    empty = whitening.whiten(spark.createDataFrame([], VEC))
    assert empty.collect() == [] and empty.columns[0] == "vec_id"
