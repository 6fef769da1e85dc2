"""Hard negatives by exact window searches in a geometric near-neighbour access tree.

For an anchor, rows of another label whose inner product lies in a window below that of a
positive are its hard negatives. One more component, sqrt(max norm^2 - norm^2), gives all rows one
norm; distance to the anchor (which has 0 there) then falls as the inner product rises, and a
window of products is an annulus of distances.

The tree: a node has several split points, every row goes to the nearest one, and the node keeps,
for each split point and each sibling subtree, the range of distances from the point to the
subtree's rows. For a query at distance d_i from split point i, a subtree with range [lo, hi] holds
rows at distances from max(d_i - hi, lo - d_i) to d_i + hi only; where that misses the annuli of all
windows for some i, the subtree is skipped. Leaves are scanned exactly, on integers.

The top node's subtrees (cells) are spread over the cluster, in chunks of a bounded size; every
chunk carries on with nodes of its own. A query first visits the cell of its nearest split point,
where it finds rows that narrow its windows, then the cells that the narrowed windows reach.
Each chunk is sent once and the queries that visit it stream past.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship

POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Rows for each split point of the top node, split points there (bounded: all tasks hold them and their
#: ranges), rows of a chunk.
CELL, SPLITS, CHUNK = 4096, 256, 16384
#: Split points of a node inside a chunk, rows of a leaf, queries that descend together.
FANOUT, LEAF, TOGETHER = 16, 256, 256
#: Share of the largest distance by which rounding may shift one; products below EXACT are whole in a double.
SLACK, EXACT = 1e-6, 1 << 53
_FAR = np.iinfo(np.int64).max


# -- the tree ------------------------------------------------------------------------------
def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Rows of integers with the component that makes every norm sqrt(``top``)."""
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0, top - (x * x).sum(axis=1)))[:, None]])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all rows of ``b``."""
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(0, d))


def reach(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance from queries to the rows of each subtree: ``d`` are the queries' distances to
    the split points, ``low[i, j]`` and ``high[i, j]`` the range from point i to subtree j."""
    least = np.maximum(d[:, :, None] - high[None], low[None] - d[:, :, None]).max(axis=1)
    return least, (d[:, :, None] + high[None]).min(axis=1)


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """Places of at most ``n`` points far from one another, from an evenly spaced sample."""
    few = np.unique(np.linspace(0, len(points) - 1, min(len(points), 3 * n)).astype(int))
    left = np.full(len(few), np.inf)
    out = [0]
    while len(out) < min(n, len(few)):
        left = np.minimum(left, apart(points[few], points[few[out[-1]]][None])[:, 0])
        best = int(left.argmax())
        if not left[best] > 0:
            break
        out.append(best)
    return few[out]


class Node:
    """A leaf (``rows``), or split points with ranges and subtrees."""

    def __init__(self, points: np.ndarray, rows: np.ndarray, depth: int = 0):
        self.rows, self.children = rows, None
        if len(rows) <= LEAF or depth > 30:
            return
        mine = points[rows]
        splits = mine[spread(mine, FANOUT)]
        d = apart(splits, mine)
        owner = d.argmin(axis=0)
        parts = [np.flatnonzero(owner == j) for j in range(len(splits))]
        if max(map(len, parts)) == len(rows):
            return  # points that no split tells apart
        kept = [j for j, p in enumerate(parts) if len(p)]
        self.splits = splits[kept]
        self.low = np.stack([d[kept][:, parts[j]].min(axis=1) for j in kept], axis=1)
        self.high = np.stack([d[kept][:, parts[j]].max(axis=1) for j in kept], axis=1)
        self.children = [Node(points, rows[parts[j]], depth + 1) for j in kept]


class Tree:
    """Rows ``x`` (integers) with their labels and, per row, the ids of the equal rows it stands for."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, ids: np.ndarray, many: np.ndarray, top: float):
        order = np.argsort(ids[np.cumsum(many) - many], kind="stable")  # of equal scores, smaller ids come first
        self.x, self.labels, self.many, self.top = x[order], labels[order], many[order], top
        start = (np.cumsum(many) - many)[order]
        self.start, self.ids = start, ids
        self.root = Node(lifted(self.x, top), np.arange(len(x)))
        self.whole = np.abs(self.x).max(initial=0)

    def scores(self, a: np.ndarray, rows: np.ndarray) -> np.ndarray:
        x = self.x[rows]
        if float(self.whole) * float(np.abs(a).max(initial=0)) * x.shape[1] < EXACT:
            return (a.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
        return a @ x.T  # 64-bit integers, exact where the product fits


class Answers:
    """The best ``k`` rows per query and window so far; windows narrow as they fill."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low.copy(), high, k
        self.score = np.full((*low.shape, k), -_FAR)
        self.id = np.full((*low.shape, k), _FAR)
        self.filled = np.zeros(low.shape, int)

    def add(self, w: int, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        old, place = np.unique(q, return_inverse=True)
        held = self.filled[old, w]
        at = np.repeat(np.arange(len(old)), held)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(held) - held, held)
        who = np.concatenate([place, at])
        score = np.concatenate([score, self.score[old[at], w, nth]])
        ids = np.concatenate([ids, self.id[old[at], w, nth]])
        order = np.lexsort((ids, ~score, who))
        who, score, ids = who[order], score[order], ids[order]
        first = np.searchsorted(who, np.arange(len(old)))
        nth = np.arange(len(who)) - first[who]
        keep = nth < self.k
        self.score[old[who[keep]], w, nth[keep]] = score[keep]
        self.id[old[who[keep]], w, nth[keep]] = ids[keep]
        self.filled[old, w] = np.minimum(np.bincount(who, minlength=len(old)), self.k)
        full = old[self.filled[old, w] == self.k]
        self.low[full, w] = np.maximum(self.low[full, w], self.score[full, w, -1])


def annuli(square: np.ndarray, low: np.ndarray, high: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Windows of inner products as ranges of distances, a little wider than rounding may need; no
    range (inf, -inf) for empty windows. ``square``: the queries' squared norms."""
    most = square[:, None] + top
    slack = SLACK * np.sqrt(most)
    near = np.sqrt(np.maximum(0, most - 2 * high.astype(np.float64))) - slack
    far = np.sqrt(np.maximum(0, most - 2 * low.astype(np.float64))) + slack
    empty = low > high
    return np.where(empty, np.inf, near), np.where(empty, -np.inf, far)


def reached(least: np.ndarray, most: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which subtrees' distances [least, most] (queries x subtrees) meet an annulus of the query."""
    return ((least[:, :, None] <= far[:, None, :]) & (most[:, :, None] >= near[:, None, :])).any(axis=2)


def descend(tree: Tree, a: np.ndarray, keys: np.ndarray, labels: np.ndarray, answers: Answers, same: bool) -> None:
    """Every row of the tree that belongs to the queries' answers, exactly."""
    square = (a.astype(np.float64) ** 2).sum(axis=1)
    point = np.hstack([a.astype(np.float64), np.zeros((len(a), 1))])
    todo = [(tree.root, np.arange(len(a)))]
    while todo:
        node, q = todo.pop()
        near, far = annuli(square[q], answers.low[q], answers.high[q], tree.top)
        if node.children is None:
            live = (far >= near).any(axis=1)
            if live.any():
                _leaf(tree, node.rows, q[live], a, keys, labels, answers, same)
            continue
        least, most = reach(apart(point[q], node.splits), node.low, node.high)
        go = reached(least, most, near, far)
        for j in np.argsort(-least.mean(axis=0)):  # the nearest subtree is taken off the stack first
            if go[:, j].any():
                todo.append((node.children[j], q[go[:, j]]))


def _leaf(tree, rows, q, a, keys, labels, answers, same) -> None:
    score = tree.scores(a[q], rows)
    fits = (tree.labels[rows][None, :] == labels[q][:, None]) == same
    for w in range(answers.low.shape[1]):
        i, j = np.nonzero(fits & (score >= answers.low[q, w][:, None]) & (score <= answers.high[q, w][:, None]))
        if not len(i):
            continue
        many = tree.many[rows[j]]
        at = np.repeat(tree.start[rows[j]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        ids, who, s = tree.ids[at], np.repeat(i, many), np.repeat(score[i, j], many)
        other = ids != keys[q[who]]
        if other.any():
            answers.add(w, q[who[other]], s[other], ids[other])


# -- on the cluster --------------------------------------------------------------------------
def _matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    part = column.take(pa.array(rows))
    return part.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


class Top:
    """The top node of one vector length: split points, their ranges once known, the norm's bound."""

    def __init__(self, splits: np.ndarray, top: float):
        self.splits, self.top = lifted(splits, top), top
        n = len(splits)
        self.low, self.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)


def _by_dim(batch: pa.RecordBatch):
    dim = batch.column("dim").to_numpy()
    for d in np.unique(dim):
        yield int(d), np.flatnonzero(dim == d)


def _place(tops: dict[int, Top]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for dim, rows in _by_dim(batch):
                cell[rows] = apart(lifted(_matrix(batch.column("x"), rows), tops[dim].top), tops[dim].splits).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return run


def _ranges(tops: dict[int, Top]):
    """Rows (dim, x, cell) to each task's ranges from every split point to every cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[tuple, tuple] = {}
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for dim, rows in _by_dim(batch):
                d = apart(lifted(_matrix(batch.column("x"), rows), tops[dim].top), tops[dim].splits)
                for c in np.unique(cells[rows]).tolist():
                    part = d[cells[rows] == c]
                    low, high = mine.get((dim, c), (np.inf, -np.inf))
                    mine[dim, c] = np.minimum(low, part.min(axis=0)), np.maximum(high, part.max(axis=0))
        rows = [(dim, c, i, lo, hi) for (dim, c), (low, high) in mine.items()
                for i, (lo, hi) in enumerate(zip(low.tolist(), high.tolist()))]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                             names=["dim", "cell", "at", "low", "high"])

    return run


def _chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("c")  # the same chunk whatever order the rows come in
    ids = pdf["ids"].tolist()
    return pd.DataFrame([{
        "dim": pdf["dim"].iloc[0], "cell": pdf["cell"].iloc[0], "chunk": pdf["chunk"].iloc[0],
        "rows": np.array(pdf["x"].tolist(), "<i8").tobytes(), "labels": pdf["label"].to_numpy("<i8").tobytes(),
        "ids": np.concatenate(ids).astype("<i8").tobytes(), "many": np.array([len(i) for i in ids], "<i8").tobytes()}])


_CHUNK = "rows binary, labels binary, ids binary, many binary"
_QUERY = "q long, key long, label long, x array<long>, low array<long>, high array<long>"
_VISIT = f"dim int, cell int, {_QUERY}"


def _route(tops: dict[int, Top], first: bool):
    """Queries to the cells that they visit: the nearest one (``first``) or all others in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_dim(batch):
                if dim not in tops:
                    continue
                top = tops[dim]
                for at in range(0, len(rows), 32):
                    part = rows[at:at + 32]
                    a = _matrix(batch.column("x"), part).astype(np.float64)
                    d = apart(np.hstack([a, np.zeros((len(a), 1))]), top.splits)
                    home = d.argmin(axis=1)
                    if first:
                        i, cell = np.arange(len(part)), home
                    else:
                        low, high = _windows(batch, part)
                        go = reached(*reach(d, top.low, top.high), *annuli((a * a).sum(axis=1), low, high, top.top))
                        go[np.arange(len(part)), home] = False
                        i, cell = np.nonzero(go)
                    if len(i):
                        sent = batch.take(pa.array(part[i])).select(_QUERY_NAMES)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(i), dim), pa.int32()), pa.array(cell, pa.int32()), *sent.columns],
                            names=["dim", "cell", *_QUERY_NAMES])

    return run


_QUERY_NAMES = [f.split()[0] for f in _QUERY.split(", ")]


def _windows(batch: pa.RecordBatch, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The queries' windows as matrices, where missing ones are empty (low > high)."""
    low, high = (batch.column(c).take(pa.array(rows)).to_pylist() for c in ("low", "high"))
    most = max(map(len, low))
    return tuple(np.array([[*v, *[gap] * (most - len(v))] for v in ends], dtype=np.int64) for ends, gap in ((low, 1), (high, 0)))


def _search(tops: dict[int, float], k: int, same: bool):
    """Sorted rows: a chunk, then the queries that visit it; out: (q, w, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.append(True, (kind[1:] == 0) | (kind[:-1] == 0)))
            for at, end in zip(edges, np.append(edges[1:], len(kind))):
                if kind[at] == 0:  # a chunk
                    get = lambda c, at=at: np.frombuffer(batch.column(c)[int(at)].as_py(), "<i8")
                    dim = batch.column("dim")[int(at)].as_py()
                    tree = Tree(get("rows").reshape(-1, dim), get("labels"), get("ids"), get("many"), tops[dim])
                    continue
                for lo in range(at, end, TOGETHER):
                    rows = np.arange(lo, min(end, lo + TOGETHER))
                    col = lambda c, rows=rows: batch.column(c).take(pa.array(rows)).to_numpy(zero_copy_only=False)
                    answers = Answers(*_windows(batch, rows), k)
                    descend(tree, _matrix(batch.column("x"), rows), col("key"), col("label"), answers, same)
                    i, w, n = np.nonzero(np.arange(k)[None, None, :] < answers.filled[:, :, None])
                    if len(i):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(col("q")[i]), pa.array(w, pa.int32()), pa.array(answers.id[i, w, n]),
                             pa.array(answers.score[i, w, n])], names=["q", "w", "id", "score"])

    return run


class Forest:
    """The index: chunks on shared storage and the top node of every vector length."""

    def __init__(self, rows: DataFrame, keep: int, cell: int = CELL, splits: int = SPLITS, chunk: int = CHUNK):
        """``rows``: ``key``, ``label`` (longs) and ``x`` (whole numbers), distinct. Rows with equal label and
        vector are one entry with their ``keep`` smallest keys, more than any answer takes."""
        nth = F.row_number().over(Window.partitionBy("label", "x").orderBy("key"))
        few = rows.withColumn("nth", nth).where(F.col("nth") <= keep)
        entries = few.groupBy("label", "x").agg(F.sort_array(F.collect_list("key")).alias("ids"))
        entries = materialize(entries.select("label", "x", "ids", F.size("x").alias("dim"), F.col("ids")[0].alias("c")), "entries")
        square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
        known = entries.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("top")).collect()
        pick = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("x", "label"), "c"))
        sample = entries.select("dim", "x", pick.alias("nth")).where(F.col("nth") <= splits).where(
            " OR ".join(f"dim = {r['dim']} AND nth <= {max(1, r['n'] // cell)}" for r in known) or "false")
        chosen: dict[int, list] = {}
        for r in sample.orderBy("dim", "nth").collect():  # at most `splits` rows a length
            chosen.setdefault(r["dim"], []).append(r["x"])
        self.spark = rows.sparkSession
        self.tops = {r["dim"]: Top(np.unique(np.array(chosen[r["dim"]], np.int64), axis=0), r["top"] * (1 + 1e-12)) for r in known}
        kinds = "label long, x array<long>, ids array<long>, dim int, c long"
        placed = materialize(entries.mapInArrow(_place(self.tops), f"{kinds}, cell int"), "placed")
        ranges = placed.select("dim", "x", "cell").mapInArrow(_ranges(self.tops), "dim int, cell int, at int, low double, high double")
        for r in ranges.groupBy("dim", "cell", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            slack = SLACK * self.tops[r["dim"]].top ** 0.5
            self.tops[r["dim"]].low[r["at"], r["cell"]] = r["low"] - slack
            self.tops[r["dim"]].high[r["at"], r["cell"]] = r["high"] + slack
        self.cells = materialize(placed.groupBy("dim", "cell").agg(
            F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")), "cells")
        self.tasks = 2 * (self.cells.agg(F.sum("chunks")).first()[0] or 1)
        dealt = placed.join(F.broadcast(self.cells), ["dim", "cell"]).withColumn(
            "chunk", F.pmod(F.xxhash64("x", "label"), F.col("chunks")).cast("int"))
        self.chunks = materialize(dealt.repartition(self.tasks, "dim", "cell", "chunk").groupBy("dim", "cell", "chunk").applyInPandas(
            _chunk, f"dim int, cell int, chunk int, {_CHUNK}"), "chunks")

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """``queries``: ``dim`` and the columns of ``_QUERY``. The ``k`` best rows of the same (or another) label in
        each window ``[low[w], high[w]]`` of inner products: ``q``, ``w``, ``rank``, ``id``, ``score``."""
        queries = queries.select("dim", *_QUERY_NAMES)
        first = materialize(_best(self._visit(queries, k, same, True), k), "first_visits")
        full = first.where(F.col("rank") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("found"))
        narrow = F.transform("low", lambda v, w: F.greatest(v, F.col("found")[w]))
        narrowed = queries.join(full, "q", "left").withColumn("low", narrow).drop("found")
        rest = self._visit(narrowed, k, same, False)
        return materialize(_best(first.drop("rank").unionByName(rest), k), "answers")

    def _visit(self, queries: DataFrame, k: int, same: bool, first: bool) -> DataFrame:
        visits = queries.mapInArrow(_route(self.tops, first), _VISIT)
        sent = visits.join(F.broadcast(self.cells), ["dim", "cell"]).withColumn(  # a row a cell
            "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks").withColumn("kind", F.lit(1))
        by = ["dim", "cell", "chunk"]
        both = self.chunks.withColumn("kind", F.lit(0)).withColumnRenamed("labels", "row_labels").unionByName(
            sent, allowMissingColumns=True).withColumnRenamed("row_labels", "labels")
        dealt = both.repartition(self.tasks, *by).sortWithinPartitions(*by, "kind", "q")
        return dealt.mapInArrow(_search({d: t.top for d, t in self.tops.items()}, k, same),
                                "q long, w int, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q", "w").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def whole_numbers(vector: str, scale: int = 256):
    return F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale).cast("long"))


def mine(rows: DataFrame, anchors: str, key: str = "vec_id", vector: str = "x", group: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         cell: int = CELL, splits: int = SPLITS, chunk: int = CHUNK) -> DataFrame:
    """Hard negatives of the rows that the SQL condition ``anchors`` picks, from whole-number vectors.

    An anchor's positives are its ``positives`` other rows of the same label with the highest inner
    products; for each, the ``negatives`` rows of another label with the highest products among
    those with low * positive_score <= 100 * negative_score <= high * positive_score. Ties go to
    the smaller key. Returns ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``,
    ``positive_score``, ``negative_score``; exact.

    Rows with a null key, label or vector, or a null component, take no part. A repeated row counts
    once; rows of one key with other vectors or labels count each, but no row is its own key's
    positive or negative. Vectors of different lengths are never compared. Anchors without
    positives, and positives without negatives, give no rows; empty in, empty out.
    """
    ship(rows.sparkSession)
    clean = rows.where(F.col(key).isNotNull() & F.col(group).isNotNull() & F.col(vector).isNotNull()
                       & ~F.exists(F.col(vector), lambda v: v.isNull()) & (F.size(vector) > 0))
    cols = [F.col(key).cast("long").alias("key"), F.col(group).cast("long").alias("label"), F.col(vector).alias("x")]
    forest = Forest(clean.select(*cols).distinct(), max(positives, negatives) + 1, cell, splits, chunk)
    asked = clean.where(anchors).select(*cols).distinct().withColumn("dim", F.size("x"))
    asked = materialize(asked.withColumn("q", F.monotonically_increasing_id()), "anchors")
    least, most = (F.array(F.lit(v).cast("long")) for v in (-_FAR, _FAR))
    near = forest.search(asked.withColumn("low", least).withColumn("high", most), positives, True)
    ends = F.struct((F.col("rank") - 1).alias("w"),
                    F.ceil(F.col("score").cast("decimal(20,0)") * low / 100).cast("long").alias("low"),
                    F.floor(F.col("score").cast("decimal(20,0)") * high / 100).cast("long").alias("high"))
    windows = near.groupBy("q").agg(F.sort_array(F.collect_list(ends)).alias("ends")).select(
        "q", F.col("ends.low").alias("low"), F.col("ends.high").alias("high"))
    found = forest.search(asked.join(windows, "q"), negatives, False)
    pairs = near.select("q", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pairs, ["q", "w"]).join(asked.select("q", F.col("key").alias("anchor_id")), "q").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
