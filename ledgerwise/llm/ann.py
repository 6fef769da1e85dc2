"""Approximate nearest neighbours by inner product on robust-pruned directed graphs.

Vectors are dealt to shards as large as a task's memory allows. Each shard's graph is built by inserting its
vectors in batches: a greedy beam search on the graph so far proposes neighbours, relaxed
distance pruning keeps diverse edges (a candidate goes when a kept neighbour is nearer to it,
by the factor ``ALPHA``, than the new vector is), and reverse edges are added and pruned the
same way. A query's beam search runs on every shard and the shards' best are merged. A shard is
sent to one task, once; the queries stream past it in batches. The work grows with queries x
shards, so shards grow first (up to ``SHARD_BYTES``, the beam with the root of their size) and
only then become more than ``SPREAD``.

Largest inner product becomes nearest in Euclidean space by one more component,
sqrt(max norm^2 - norm^2), which is 0 for queries. Equal vectors share one node, which keeps
the smallest ids; copies would otherwise crowd each other's edges out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship
from .metric_join import usable

K = 20
#: Edges of a node, beam while building and while searching ``SHARD_ROWS`` nodes, slack of the pruning.
EDGES, BUILD_BEAM, BEAM, ALPHA = 32, 64, 128, 1.2
#: Vectors of a small table's shard; shards that such tables are spread over at most; bytes of a large table's shard.
SHARD_ROWS, SPREAD, SHARD_BYTES = 5000, 32, 64 << 20
#: Queries searched at once (a byte a query and node is held); nodes that a step of the beam search expands.
QUERY_BLOCK, WIDTH = 256, 4


def beam_search(x: np.ndarray, sq: np.ndarray, graph: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int):
    """The ``beam`` nearest nodes found for each row of ``q``: places (-1: none) and distances
    less the query's own square, nearest first."""
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(x) + 1), dtype=bool)  # the last column stands for "no node"
    seen[:, -1] = True
    ids = np.full((n, beam), -1)
    dist = np.full((n, beam), np.inf, dtype=np.float32)
    fresh = np.broadcast_to(entry, (n, len(entry)))
    open_ = np.zeros((n, beam), dtype=bool)
    live = np.arange(n)
    while len(live):
        r = rows[:len(live)]
        fresh = np.sort(fresh, axis=1)
        new = ~seen[live[:, None], fresh]
        new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
        seen[live[:, None], fresh] = True
        d = sq[fresh] - 2 * np.einsum("bkd,bd->bk", x[fresh], q[live])
        d[~new] = np.inf
        all_d = np.concatenate([dist[live], d], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[live] = all_d[r, order]
        ids[live] = np.concatenate([ids[live], np.where(new, fresh, -1)], axis=1)[r, order]
        open_[live] = np.concatenate([open_[live], new], axis=1)[r, order] & np.isfinite(dist[live])
        live = live[open_[live].any(axis=1)]
        if not len(live):
            break
        o = open_[live]
        first = np.argsort(~o, axis=1, kind="stable")[:, :WIDTH]  # the nearest open places
        take = np.take_along_axis(o, first, axis=1)
        nodes = np.where(take, np.take_along_axis(ids[live], first, axis=1), -1)
        closed = o.copy()
        np.put_along_axis(closed, first, False, axis=1)
        open_[live] = closed
        fresh = graph[nodes].reshape(len(live), -1)
        fresh[np.repeat(nodes < 0, graph.shape[1], axis=1)] = -1
    return ids, dist


def robust_prune(x: np.ndarray, point: np.ndarray, cand: np.ndarray, edges: int, alpha: float) -> np.ndarray:
    """At most ``edges`` diverse neighbours of each node of ``point`` from its row of ``cand`` (-1: none)."""
    n = len(point)
    cand = np.sort(cand, axis=1)
    bad = (cand < 0) | (cand == point[:, None])
    bad[:, 1:] |= cand[:, 1:] == cand[:, :-1]
    vec = x[cand]
    d = ((vec - x[point][:, None, :]) ** 2).sum(axis=2)
    d[bad] = np.inf
    out, rows = np.full((n, edges), -1), np.arange(n)
    for k in range(edges):
        best = d.argmin(axis=1)
        ok = np.isfinite(d[rows, best])
        if not ok.any():
            break
        out[ok, k] = cand[rows[ok], best[ok]]
        between = ((vec - vec[rows, best][:, None, :]) ** 2).sum(axis=2)
        gone = (alpha * alpha * between <= d) & ok[:, None]
        gone[rows, best] = True
        d[gone] = np.inf
    return out


def build_graph(x: np.ndarray, edges: int = EDGES, beam: int = BUILD_BEAM, alpha: float = ALPHA,
                seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Out-edges of every node (-1: none; an extra last row for "no node") and entry nodes."""
    n = len(x)
    sq = (x * x).sum(axis=1)
    sq = np.append(sq, np.float32(0))
    xp = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
    order = np.random.default_rng(seed).permutation(n)
    centre = int((sq[:n] - 2 * x @ x.mean(axis=0)).argmin())
    entry = np.unique(np.append(order[:4], centre))
    graph = np.full((n + 1, edges), -1)
    first = np.unique(np.append(order[:min(n, edges)], entry))
    graph[first] = robust_prune(xp, first, np.tile(first, (len(first), 1)), edges, alpha)
    done = np.zeros(n, dtype=bool)
    done[first] = True
    rest, at = order[~done[order]], 0
    while at < len(rest):
        size = min(512, max(32, (len(first) + at) // 2))
        batch = rest[at:at + size]
        at += size
        found, _ = beam_search(xp, sq, graph, entry, xp[batch], beam)
        graph[batch] = robust_prune(xp, batch, found, edges, alpha)
        # reverse edges, gathered by their new tail
        src, dst = np.repeat(batch, edges), graph[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        tails, start, many = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(tails), 512):
            t, s, m = tails[lo:lo + 512], start[lo:lo + 512], many[lo:lo + 512]
            extra = np.full((len(t), m.max()), -1)
            col = np.arange(m.max())[None, :]
            extra[col < m[:, None]] = src[(s[:, None] + col)[col < m[:, None]]]
            both = np.concatenate([graph[t], extra], axis=1)
            room = (both >= 0).sum(axis=1) <= edges
            packed = np.sort(both, axis=1)[:, ::-1][:, :edges]  # nodes first, gaps last
            graph[t[room]] = packed[room]
            if (~room).any():
                graph[t[~room]] = robust_prune(xp, t[~room], both[~room], edges, alpha)
    return graph, entry


def lift(x: np.ndarray) -> np.ndarray:
    """Scaled vectors with the component that turns inner product into distance."""
    x = x / max(np.abs(x).max(), 1e-300)
    norm = (x * x).sum(axis=1)
    return np.hstack([x, np.sqrt(np.maximum(0, norm.max() - norm))[:, None]]).astype(np.float32)


def _build(edges: int, beam: int, alpha: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")  # the same graph whatever order the rows come in
        x = np.array(pdf["vec"].tolist(), dtype=np.float64)
        graph, entry = build_graph(lift(x), edges, beam, alpha)
        ids = pdf["ids"].tolist()
        with np.errstate(over="ignore"):
            single = x.astype("<f4")
        kept = single if (single == x).all() else x.astype("<f8")  # the vectors as they are, in the fewest bytes
        return pd.DataFrame([{
            "dim": pdf["dim"].iloc[0], "shard": pdf["shard"].iloc[0], "n": len(x), "vectors": kept.tobytes(),
            "graph": graph.astype("<i4").tobytes(), "entry": entry.astype("<i4").tobytes(),
            "ids": np.concatenate(ids).astype("<i8").tobytes(), "many": np.array([len(i) for i in ids], "<i4").tobytes()}])

    return run


INDEX = "dim int, shard int, n int, vectors binary, graph binary, entry binary, ids binary, many binary"
NODE_COLUMNS = ["n", "vectors", "graph", "entry", "ids", "many"]
NODE = "struct<n:int,vectors:binary,graph:binary,entry:binary,ids:binary,many:binary>"


class Shard:
    """A shard's graph and vectors, ready for beam searches."""

    def __init__(self, row: dict, dim: int, k: int, beam: int):
        n = row["n"]
        self.x = np.frombuffer(row["vectors"], f"<f{len(row['vectors']) // (n * dim)}").reshape(n, dim)
        self.graph = np.frombuffer(row["graph"], "<i4").reshape(n + 1, -1)
        self.entry = np.frombuffer(row["entry"], "<i4")
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.ends = np.append(0, np.cumsum(np.frombuffer(row["many"], "<i4")))
        lifted = lift(self.x.astype(np.float64))
        self.xp = np.vstack([lifted, np.zeros((1, lifted.shape[1]), np.float32)])
        self.sq = (self.xp * self.xp).sum(axis=1)
        self.k, self.beam = k, max(int(beam * max(1.0, n / SHARD_ROWS) ** 0.5), k + 1)

    def nearest(self, q: np.ndarray, own: np.ndarray) -> Iterator[tuple[list, list]]:
        """Ids and scores of the ``k`` best found for each row of ``q``, without the query's own id."""
        scaled = q / np.abs(q).max(axis=1, keepdims=True)
        found, _ = beam_search(self.xp, self.sq, self.graph, self.entry,
                               np.hstack([scaled, np.zeros((len(q), 1))]).astype(np.float32), self.beam)
        for i, me in enumerate(own.tolist()):
            near = found[i][found[i] >= 0]
            score = (self.x[near].astype(np.float64) * q[i]).sum(axis=1)
            if len(near) > self.k + 1:  # one node may be the query's alone; ties at the end stay
                top = score >= np.partition(score, -self.k - 1)[-self.k - 1]
                near, score = near[top], score[top]
            got = sorted((-s, v) for s, g in zip(score.tolist(), near.tolist())
                         for v in self.ids[self.ends[g]:self.ends[g + 1]].tolist() if v != me)[:self.k]
            yield [v for _, v in got], [-s for s, _ in got]


FOUND = "q long, query_id long, ids array<long>, scores array<double>"


def _search(k: int, beam: int, block: int):
    """Rows sorted by shard, each shard's index before its queries: one index is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "kind")])
            cuts = np.append(0, np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows]):
                if lo == hi:
                    continue
                dim, name, kind = place[:, lo].tolist()
                if kind == 0:
                    at, shard = (dim, name), Shard(batch.column("node")[lo].as_py(), dim, k, beam)
                    continue
                if at != (dim, name):
                    raise RuntimeError("a query came before its shard")
                for start in range(lo, hi, block):
                    part = batch.slice(start, min(block, hi - start))
                    q = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    own = part.column("query_id").to_numpy()
                    ids, scores = zip(*shard.nearest(q, own))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("q"), part.column("query_id"), pa.array(ids, pa.list_(pa.int64())),
                         pa.array(scores, pa.list_(pa.float64()))], names=["q", "query_id", "ids", "scores"])

    return run


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K,
                shard_rows: int = SHARD_ROWS, edges: int = EDGES, beam: int = BUILD_BEAM, alpha: float = ALPHA,
                spread: int = SPREAD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard (graph, vectors, ids), written to the shared folder. Every usable
    vector is indexed: equal ones as one node with its ``k`` + 1 smallest ids, all that a search
    for ``k`` without the query's own can return. Up to ``spread`` shards hold ``shard_rows``
    vectors; beyond that shards grow until their vectors and edges fill ``shard_bytes``."""
    ship(vectors.sparkSession)
    rows = vectors.where(usable(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("vec")).distinct()
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1)
    nodes = few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = materialize(nodes.select("vec", "ids", F.size("vec").alias("dim"), F.col("ids")[0].alias("c")), "nodes")
    n, node_bytes = F.count(F.lit(1)), 8 * F.col("dim") + 4 * edges
    shards = materialize(nodes.groupBy("dim").agg(n.alias("n")).select("dim", F.greatest(
        F.least(F.ceil(F.col("n") / shard_rows), F.lit(spread)),
        F.ceil(F.col("n") * node_bytes / shard_bytes)).cast("int").alias("shards")), "dims")
    dealt = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards")).cast("int"))
    # building a graph is work far beyond its bytes: an own task for nearly every shard
    tasks = shards.agg(F.sum("shards")).first()[0] or 1
    dealt = dealt.repartition(2 * tasks, "dim", "shard")
    return materialize(dealt.groupBy("dim", "shard").applyInPandas(_build(edges, beam, alpha), INDEX), "index")


def search(index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K,
           beam: int = BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` nearest found of every query row: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    ``score`` is the inner product of the original vectors in double precision; ties go to the
    smaller id. Ids equal to the query's are no candidates. Queries whose vector is null,
    zero or holds null or non-finite components, or whose key is null, give no rows; a
    repeated query row counts once; vectors of another length are never compared.
    Every query visits every shard of its length, ``block`` queries at once; a shard returns one
    row of at most ``k`` candidates a query. ``beam`` is the width at ``SHARD_ROWS`` nodes.
    """
    ship(index.sparkSession)
    asked = queries.where(usable(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("query_id"), F.col(vector).alias("vec")).distinct()
    asked = materialize(asked.withColumn("q", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "queries")
    shards = index.groupBy("dim").agg(F.collect_set("shard").alias("shards"))
    sent = asked.join(shards, "dim").select("dim", F.explode("shards").alias("shard"), F.lit(1).alias("kind"),
                                            F.lit(None).cast(NODE).alias("node"), "q", "query_id", "vec")
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in asked.schema.fields}
    held = index.select("dim", "shard", F.lit(0).alias("kind"), F.struct(*NODE_COLUMNS).cast(NODE).alias("node"),
                        none["q"], none["query_id"], none["vec"])
    tasks = 2 * max(index.count(), 1)
    dealt = held.unionByName(sent).repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "kind", "q")
    found = dealt.mapInArrow(_search(k, beam, block), FOUND)
    # a shard's candidates cross the shuffle as one row; ranks are taken where they arrive
    each = found.repartition("q").select("q", "query_id", F.explode(F.arrays_zip("ids", "scores")).alias("c"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("c.scores"), "c.ids"))
    best = each.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("c.ids").alias("vec_id"), F.col("c.scores").alias("score"))
