import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerwise.llm import ann, metric_join, minhash, queries, toxicity
from ledgerwise.llm.common import components

SF = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, label int"


class Union(dict):
    def root(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self[b] = a


# -- components ------------------------------------------------------------------------
@pytest.mark.parametrize("n,m,seed", [(60, 40, 1), (200, 220, 2), (50, 0, 3)])
def test_components(spark, n, m, seed):
    rng, want = random.Random(seed), Union()
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    edges += [(i, i + 1) for i in range(1000, 1040)] if m else []  # a long chain
    for a, b in edges:
        want.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: want.root(x) for x in want if any(x in e and e[0] != e[1] for e in edges)}


# -- op4 -------------------------------------------------------------------------------
def nearest(rows, k=20):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            best = sorted((-float((v * q).sum()), j) for j, v in ok if j != i)[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


def recall_of(rows, want):
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want)
    hits = total = 0
    for q, best in want.items():
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0])) and len(got[q]) == len(best)
        hits, total = hits + len({j for j, _ in got[q]} & {j for j, _ in best}), total + len(best)
    return hits / total


def test_op4_recall_and_scores(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    rows = list(zip(t["vec_id"], t["embedding"]))
    got = queries.op4_neighbours(spark, SF).collect()
    assert recall_of(got, nearest(rows)) >= 0.9
    vec = dict(rows)
    for r in got[:50]:
        assert r.score == pytest.approx(float(np.dot(np.array(vec[r.query_id], float), np.array(vec[r.vec_id], float))),
                                        abs=1e-12)


def test_op4_many_shards_norms_and_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16)) * rng.uniform(0.2, 3, size=(900, 1))
    x[300:600] = x[7]  # a third of all rows are copies of one vector
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VEC)
    index = ann.build_index(df, shard_rows=200)
    assert index.count() >= 3
    want = nearest([(i, np.array(v, np.float32)) for i, v, _ in rows])
    got = ann.search(index, df.where("vec_id % 20 = 0"), block=16).collect()
    assert recall_of(got, want) >= 0.9
    q = want[300]  # a copy's nearest: ties go to the smallest ids
    mine = [r.vec_id for r in sorted((r for r in got if r.query_id == 300), key=lambda r: r.rank)]
    assert mine == [j for j, _ in q]


def test_op4_shards_grow_before_they_get_many(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(rng.normal(size=(1200, 16)))]
    df = spark.createDataFrame(rows, VEC)
    node = 8 * 16 + 4 * ann.EDGES
    count = lambda **how: ann.build_index(df, **how).count()
    assert count(shard_rows=400) == 3
    assert count(shard_rows=20, spread=4) == 4  # larger shards, not 60
    assert count(shard_rows=20, spread=2, shard_bytes=200 * node) == 6  # memory bounds a shard
    index = ann.build_index(df, shard_rows=20, spread=4)
    found = ann.search(index, df.where("vec_id % 20 = 0"), block=7)
    assert recall_of(found.collect(), nearest([(i, v) for i, v, _ in rows])) >= 0.9
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(dim#") == 2  # the list of shards; shards with their queries, once
    assert plan.count("Exchange hashpartitioning(q#") == 1  # candidates; the ranks need no further exchange


def test_op4_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [1.0, None], 1),
            (5, [inf, 1.0], 1), (6, [0.5, 0.5], 1), (6, [0.5, 0.5], 1), (7, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1),
            (20, [0.0, 0.0], 2), (40, [0.5, 0.5], None), (60, [], 1)]
    df = spark.createDataFrame(rows, VEC).withColumn("c", F.lit(1)).withColumn("q", F.lit(2)).withColumn("shard", F.lit(3))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in
           ann.search(ann.build_index(df), df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 0.5), (0, 2, 40, 0.5), (40, 1, 0, 0.5), (40, 2, 6, 0.5)]
    assert ann.search(ann.build_index(df.limit(0)), df).count() == 0


# -- op5 -------------------------------------------------------------------------------
def brute_links(rows, cosine=0.93):
    n_links, comp = [0] * len(rows), Union()
    unit = []
    for _, v, label in rows:
        ok = v is not None and len(v) and label is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    for a in range(len(rows)):
        comp.root(a)
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) \
                    and float(unit[a] @ unit[b]) >= cosine:
                n_links[a] += 1
                n_links[b] += 1
                comp.join(a, b)
    least = {}
    for a, r in enumerate(rows):
        if r[0] is not None:
            least[comp.root(a)] = min(least.get(comp.root(a), r[0]), r[0])
    return sorted(((r[0], n_links[a], least.get(comp.root(a)) if r[0] is not None else None) for a, r in enumerate(rows)),
                  key=str)


def links_of(df, **how):
    out = metric_join.link_vectors(df, **how).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str)


def test_op5_matches_brute_force(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    rows = list(zip(t["vec_id"], t["embedding"], t["label"]))
    got = queries.op5_metric_join(spark, SF).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_links(rows)


def test_op5_cells_blocks_and_near_copies(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=8)
    near = centre + rng.normal(size=(150, 8)) * 0.3 * rng.uniform(0, 1, size=(150, 1))
    rows = [[i, v.astype(np.float32).tolist(), 1] for i, v in enumerate(np.vstack([near, rng.normal(size=(150, 8))]))]
    rows += [[300 + i, rows[3][1], 1] for i in range(40)] + [[400, rows[3][1], 2]]
    df = spark.createDataFrame([tuple(r) for r in rows], VEC)
    assert links_of(df, cell=8, pivots=12, block=17) == brute_links(rows)


def test_op5_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [1.0, None], 1), (5, [2.0, 0.0], 1),
            (6, [1.0, 0.0], None), (7, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (8, [], 1), (9, [1.0, 0.1], 1),
            (9, [1.0, 0.1], 1), (10, [1e30, 1e30], 1), (11, [1e-30, 1e-30], 1)]
    df = spark.createDataFrame(rows, VEC)
    clash = df.select("*", *[F.lit(1).alias(n) for n in ("key", "c", "m", "cell", "home", "root", "ok")])
    assert links_of(clash) == brute_links(rows)
    assert metric_join.link_vectors(df.limit(0)).count() == 0


def clustered(n, dim=16, centres=24, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return [[float(np.float32(c)) for c in middle[rng.integers(centres)] + rng.normal(scale=0.12, size=dim)] for _ in range(n)]


def test_op5_few_replicas_where_vectors_have_structure(spark, monkeypatch, caplog):
    vecs = clustered(700)
    rows = [(i, v, i % 2) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, VEC)
    monkeypatch.setattr(metric_join, "STRIP", 500)  # many strips a block
    with caplog.at_level("INFO", logger=metric_join.__name__):
        assert links_of(df, cell=16, block=40, move=0) == brute_links(rows)
    vectors, cells, _ = caplog.records[-1].args
    assert vectors == 700 and 1 < cells < 8  # of about 22 a label
    x = metric_join.unit(vecs)
    best = metric_join.best_pivots(x[:32], x[32:], 1e6, 0.93, 16384, 128)
    assert best is not None and len(best.points) >= 16
    home, near = best.place(x)
    links = x @ x.T >= 0.93  # every neighbour's cell is among a vector's own
    a, b = np.nonzero(links)
    assert near[a, home[b]].all()
    # without structure no partition is worth its replicas
    flat = metric_join.unit(np.random.default_rng(1).normal(size=(600, 64)).tolist())
    assert metric_join.best_pivots(flat[:120], flat[120:], 1e6, 0.93, 16384, 128) is None


def test_op5_forest_of_strips():
    rng = np.random.default_rng(8)
    root, want = np.arange(300), Union()
    for _ in range(6):
        u, v = rng.integers(0, 300, 40), rng.integers(0, 300, 40)
        metric_join.unite(root, u, v)
        for a, b in zip(u.tolist(), v.tolist()):
            want.join(a, b)
    groups = defaultdict(list)
    for i in range(300):
        groups[want.root(i)].append(i)
    assert all(root[i] == min(g) for g in groups.values() for i in g)


def test_op5_query_links_near_copies(spark, tmp_path):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, vecs, labels = t["vec_id"].to_pylist(), t["embedding"].to_pylist(), t["label"].to_pylist()
    rng, top = np.random.default_rng(2), max(ids) + 1
    for i in range(0, 60, 2):  # three noisy copies of every second of the first rows, one with another label
        for k, scale in enumerate((0.05, 0.2, 0.05)):
            ids.append(top + 10 * i + k)
            noisy = np.array(vecs[i]) * (1 + rng.normal(scale=scale, size=len(vecs[i])))
            vecs.append([float(np.float32(c)) for c in noisy])
            labels.append(labels[i] + (k == 2))
    made = pa.table({"vec_id": ids, "embedding": pa.array(vecs, t.schema.field("embedding").type),
                     "label": pa.array(labels, t.schema.field("label").type)})
    pq.write_table(made, f"{tmp_path}/embeddings.parquet")
    got = queries.op5_metric_join(spark, str(tmp_path)).collect()
    want = brute_links(list(zip(ids, vecs, labels)))
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert sum(n > 0 for _, n, _ in want) > 60


# -- op9 -------------------------------------------------------------------------------
def brute_near(texts, k, percent):
    """Per row: size of the set, and the smallest key of its component."""
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = Union()
    for a in range(len(texts)):
        comp.root(a)
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    comp.join(a, b)
    least = {}
    for a, (key, _) in enumerate(texts):
        if key is not None:
            least[comp.root(a)] = min(least.get(comp.root(a), key), key)
    return sorted(((key, len(sets[a]), least.get(comp.root(a)) if key is not None else None)
                   for a, (key, _) in enumerate(texts)), key=str)


def near_of(df, **how):
    out = minhash.near_duplicates(df, **how).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def test_op9_matches_brute_force(spark, docs):
    got = queries.op9_near_duplicates(spark, SF).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_near(
        [(i, t) for i, t, _ in docs], 3, 85)


@pytest.mark.parametrize("k,percent,small", [(3, 85, 48), (5, 80, 48), (3, 85, 2)])
def test_op9_groups_of_near_copies(spark, monkeypatch, k, percent, small):
    """Chains whose ends are far apart, a large group of variants, and a passage that all share;
    with pairs listed or, ``small`` = 2, verified in several blocks."""
    monkeypatch.setattr(minhash, "SMALL", small)
    if small == 2:
        monkeypatch.setattr(minhash, "BLOCK", 30)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=120)
    texts = []
    for i in range(150):  # variants: some near each other only through others
        t = list(base)
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append((i, " ".join(t)))
    chain = rng.choices(words, k=100)
    for i in range(30):
        chain[(3 * i) % 100] = rng.choice(words)
        texts.append((200 + i, " ".join(chain)))
    passage = " ".join(rng.choices(words, k=60))
    texts += [(300 + i, passage + " " + " ".join(rng.choices(words, k=60))) for i in range(60)]
    texts += [(400 + i, texts[5][1].upper()) for i in range(50)]  # copies
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert near_of(df, percent=percent, shingle=k) == brute_near(texts, k, percent)


def test_op9_edges(spark, clashing):
    texts = [(r.doc_id, r.text) for r in clashing.collect()]
    assert near_of(clashing, percent=85, shingle=3) == brute_near(texts, 3, 85)
    assert minhash.near_duplicates(clashing.limit(0)).count() == 0
    kept = minhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    rows = [r.doc_id for r in kept.collect()]
    # equal rows become one; a null key and a repeated key with other texts stay
    assert sorted(rows, key=str) == sorted([1, 2, 3, 4, None, 5, 6, 7, 8, 5], key=str)


def test_posterior_bounds_and_bands():
    rule = minhash.least_matches(0.85, 1e-9)
    assert [n for n, _ in rule] == [32, 64, 96, 128] and all(m < 0.85 * n for n, m in rule)
    rng = np.random.default_rng(0)
    drawn = rng.random((200_000, 128)) < 0.85  # rows of pairs at the threshold
    for n, m in rule:
        assert (drawn[:, :n].sum(axis=1) < m).mean() < 1e-4
    for t in (0.8, 0.85, 0.9):
        b, r = minhash.banding(t)
        assert b * r <= minhash.HASHES and (1 - t ** r) ** b <= minhash.MISS_BANDS


# -- op7 -------------------------------------------------------------------------------
def test_op7_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.train(docs, labels.where("doc_id % 4 <> 0"), queries.CATEGORIES)
    test = toxicity.classify(docs, chain).join(labels.where("doc_id % 4 = 0"), "doc_id")
    n = {(r.toxic, r.rejected): r["count"] for r in test.groupBy("toxic", "rejected").count().collect()}
    assert n.get((1, True), 0) >= 0.9 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.01 * n[0, False]


def test_op7_edges(spark, clashing):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (3, None, 0), (5, 1, None), (None, 1, 1), (99, 1, 1), (6, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    chain = toxicity.train(clashing, labels, queries.CATEGORIES)
    rows = toxicity.classify(clashing, chain).collect()
    assert len(rows) == 11 and all(0 <= r.p_toxic <= 1 for r in rows)
    assert all(r.rejected for r in rows if r.doc_id == 1)
    kept = toxicity.drop_rejected(clashing, chain)
    assert kept.columns == clashing.columns and kept.count() == sum(not r.rejected for r in rows)
    none = toxicity.train(clashing, labels.limit(0), queries.CATEGORIES)  # nothing to learn from
    assert {r.p_toxic for r in toxicity.classify(clashing, none).collect()} == {0.0}
    assert toxicity.classify(clashing.limit(0), chain).count() == 0
    one = toxicity.train(clashing, labels.where("doc_id = 1"), {"toxic": "toxic = 1"})
    assert {r.p_toxic for r in toxicity.classify(clashing, one).collect()} == {1.0}


def chain_rows(rng, n=2000):
    """Three categories, each said by words of its own and likelier after the one before."""
    y = np.zeros((n, 3))
    y[:, 0] = rng.random(n) < 0.4
    y[:, 1] = rng.random(n) < 0.15 + 0.5 * y[:, 0]
    y[:, 2] = rng.random(n) < 0.1 + 0.6 * y[:, 1]
    marks = np.arange(9).reshape(3, 3) + 1000
    terms = [np.array(sorted({*rng.integers(0, 60, 12).tolist(), *(int(rng.choice(marks[c])) for c in range(3)
                                                                   if y[i, c] and rng.random() < 0.7)})) for i in range(n)]
    return terms, y


def test_chain_of_three_gets_out_of_fold_inputs():
    rng = np.random.default_rng(8)
    terms, y = chain_rows(rng)
    fold = rng.integers(0, 3, len(y))
    models, unseen = toxicity.fit_models(terms, y, fold, 3)
    assert [len(m.before) for m in models] == [0, 1, 2] and (unseen[:, 2] == 0).all()
    for k in range(3):
        # labels of a fold change nothing in the probabilities that its documents got
        other = y.copy()
        other[fold == k] = 1 - other[fold == k]
        _, changed = toxicity.fit_models(terms, other, fold, 3)
        assert np.allclose(changed[fold == k, 0], unseen[fold == k, 0])
        assert not np.allclose(changed[fold != k, 0], unseen[fold != k, 0])
    # the chain uses the category before: its weight is positive, and it helps on new documents
    assert models[1].before[0] > 0 and models[2].before.sum() > 0
    new, truth = chain_rows(np.random.default_rng(9))
    rows = np.repeat(np.arange(len(new)), [len(t) for t in new])
    p = np.zeros((len(new), 3))
    for i, m in enumerate(models):
        p[:, i] = m.predict(rows, np.concatenate(new), len(new), p[:, :i])
        hit = p[truth[:, i] == 1, i][:, None] > p[truth[:, i] == 0, i][None, :]
        assert hit.mean() > 0.75


def test_fit_task_gets_the_chosen_terms_only(spark, monkeypatch):
    """Terms of one document alone fill the sample; the task never sees them, and its chain is that of all terms."""
    rng = np.random.default_rng(10)
    terms, y = chain_rows(rng, 600)
    terms = [np.array([*t, *range(5000 + 50 * i, 5050 + 50 * i)]) for i, t in enumerate(terms)]
    rows = [(i, t.tolist(), *map(float, c)) for i, (t, c) in enumerate(zip(terms, y))]
    labelled = spark.createDataFrame(rows, "fold_key long, terms array<int>, y0 double, y1 double, y2 double").repartition(3)
    real = toxicity._fit_task

    def strict(categories, folds):
        task = real(categories, folds)

        def run(pdf):
            seen = {t for row in pdf["terms"] for t in row}
            assert len(pdf) == 600 and len(seen) < 100, f"{len(seen)} terms"
            return task(pdf)

        return run

    monkeypatch.setattr(toxicity, "_fit_task", strict)
    chain = toxicity.fit_chain(labelled, ["a", "b", "c"])
    fold = np.array([r.f for r in labelled.selectExpr("fold_key", "int(pmod(xxhash64(fold_key, 11), 3)) f").orderBy("fold_key").collect()])
    want, _ = toxicity.fit_models(terms, y, fold)
    for got, model in zip(chain.models, want, strict=True):
        assert got.terms.tolist() == model.terms.tolist() and got.intercept == model.intercept
        assert got.weights.tolist() == model.weights.tolist() and got.before.tolist() == model.before.tolist()


@pytest.mark.parametrize("limit", [3, 1000])
def test_spark_chooses_the_terms_of_every_model(spark, limit):
    rng = np.random.default_rng(11)
    terms, y = chain_rows(rng, 300)
    y[:, 2] = 0  # one class: no terms
    fold = rng.integers(0, 2, 300)  # the third fold is empty
    rows = [(int(f), t.tolist(), *map(float, c)) for f, t, c in zip(fold, terms, y)]
    got = toxicity.choose_terms(spark.createDataFrame(rows, "fold int, terms array<int>, y0 double, y1 double, y2 double"), 3, limit=limit)
    want = set()
    for i, keep in [(i, fold != k) for i in (0, 1) for k in (0, 1, 2)]:
        kept = [t for t, k in zip(terms, keep) if k]
        want.update(toxicity.best_terms(np.concatenate(kept), np.repeat(np.arange(len(kept)), [len(t) for t in kept]), y[keep, i], limit).tolist())
    assert len(got) == len(want) and set(got) == want


def test_solver_reaches_the_minimum():
    rng = np.random.default_rng(1)
    x = (rng.random((300, 6)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [2, -1, 0, 1, -2, 0.5] - 0.3)))).astype(float)
    rows, codes = np.nonzero(x)
    model = toxicity.fit(rows, codes, np.zeros((300, 0)), y)
    p = model.predict(rows, codes, 300, np.zeros((300, 0)))
    grad = np.append(x.T @ (p - y) / 300 + toxicity.DECAY * model.weights, (p - y).mean())
    assert np.abs(grad).max() < 1e-5


def test_op9_a_null_key_between_two_others_links_them(spark):
    words = [f"w{i}" for i in range(40)]
    text = lambda lo: " ".join(words[lo:lo + 34])  # noqa: E731  (neighbours are near, the ends are not)
    rows = [(1, text(0)), (None, text(2)), (3, text(4)), (9, "quite another text with words of its own"), (None, None), (None, "alone it is here")]
    got = near_of(spark.createDataFrame(rows, "doc_id long, text string"), percent=85, shingle=3)
    assert got == brute_near(rows, 3, 85)
    assert {c for k, _, c in got if k in (1, 3)} == {1}
