"""Hard negatives against brute force: windows, ties, copies, many cells and chunks, edge cases."""


import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerwise.llm import hard_negatives as hn
from ledgerwise.llm import queries

SF = "/root/testdata/sf0.001"
ROWS = "vec_id long, label int, x array<long>"


def brute(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    rows = sorted({(i, y, tuple(x)) for i, y, x in rows})
    out = []
    for i, y, a in (r for r in rows if is_anchor(r[0])):
        score = sorted((-sum(p * q for p, q in zip(a, x)), j, z) for j, z, x in rows if j != i and len(x) == len(a))
        for s, j, _ in [r for r in score if r[2] == y][:positives]:
            fits = [(-t, k) for t, k, z in score if z != y and low * -s <= 100 * -t <= high * -s]
            out += [(i, j, n + 1, k, -s, t) for n, (t, k) in enumerate(fits[:negatives])]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_op11_whole_table(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    rows = [(i, (y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(256 * c)) for c in v])
            for i, v, y in zip(t["vec_id"], t["embedding"], t["label"])]
    got = queries.op11_hard_negatives(spark, SF)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                          ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert found(got) == brute(rows, lambda i: i % 100 == 0)


def clustered(rng, n, dim, spread, labels):
    centres = rng.integers(-200, 200, size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.integers(-spread, spread + 1, size=(n, dim))
    return [(i, int(rng.integers(0, labels)), v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("cell,chunk,spread", [(40, 25, 30), (100, 1000, 3), (10_000, 10_000, 60)])
def test_cells_chunks_and_ties(spark, monkeypatch, cell, chunk, spread):
    rng = np.random.default_rng(cell)
    rows = clustered(rng, 700, 5, spread, 3)
    rows[300:500] = [(i, y, rows[7][2]) for i, y, _ in rows[300:500]]  # many copies of one vector, three labels
    rows += rows[:20]  # repeated rows
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    got = found(hn.mine(df, "vec_id % 10 = 0", cell=cell, chunk=chunk))
    assert got == brute(rows, lambda i: i % 10 == 0)


def test_search_skips_subtrees_and_misses_nothing(monkeypatch):
    monkeypatch.setattr(hn, "LEAF", 8)
    rng = np.random.default_rng(2)
    rows = clustered(rng, 2000, 4, 4, 4)
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    top = float((x * x).sum(axis=1).max())
    tree = hn.Tree(x, y, np.arange(len(x)), np.ones(len(x), int), top)
    scanned = []
    leaf = hn._leaf
    monkeypatch.setattr(hn, "_leaf", lambda t, rows, q, *a: (scanned.append(len(rows) * len(q)), leaf(t, rows, q, *a)))
    a, keys = x[:50], np.arange(50)
    full = a @ x.T
    low, high = np.quantile(full, 0.6, axis=1).astype(int)[:, None], np.quantile(full, 0.7, axis=1).astype(int)[:, None]
    answers = hn.Answers(low, high, 5)
    hn.descend(tree, a, keys, y[:50], answers, False)
    for i in range(50):
        want = sorted((-s, j) for j, s in enumerate(full[i].tolist()) if y[j] != y[i] and low[i, 0] <= s <= high[i, 0])[:5]
        got = [(-s, j) for s, j in zip(answers.score[i, 0], answers.id[i, 0])][:answers.filled[i, 0]]
        assert got == want
    assert sum(scanned) < 0.35 * 50 * len(x)  # ranges and annuli rule out most subtrees


def test_large_numbers_are_exact():
    big = 1 << 29
    x = np.array([[big, 1], [big, 0], [big - 1, 3]])
    tree = hn.Tree(x, np.array([0, 1, 1]), np.arange(3), np.ones(3, int), float((x.astype(float) ** 2).sum(axis=1).max()))
    assert tree.scores(x[:1], np.arange(3)).tolist() == [[big * big + 1, big * big, big * (big - 1) + 3]]


def test_edges(spark):
    rows = [(0, 1, [3, 4]), (1, 1, [3, 3]), (2, 2, [2, 4]), (3, 2, [-3, -4]), (10, 1, None), (11, None, [1, 2]),
            (12, 1, [1, None]), (None, 2, [3, 4]), (13, 2, [3, 4, 5]), (14, 2, []), (0, 2, [3, 4]), (20, 3, [-1, -1])]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "'x' AS key", "1 AS cell", "2 AS q")
    usable = [r for r in rows if None not in r and None not in r[2] and r[2]]
    assert found(hn.mine(df, "vec_id % 10 = 0")) == brute(usable, lambda i: i % 10 == 0)
    assert found(hn.mine(df, "vec_id = 999")) == []
    assert found(hn.mine(df.limit(0), "vec_id % 10 = 0")) == []
