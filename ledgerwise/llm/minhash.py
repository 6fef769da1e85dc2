"""MinHash near-dedup with sequential Bayesian verification.

1. Every text becomes a set of hashed word shingles, a digest of the set and a MinHash
   signature. Texts with equal sets form a class; one text stands for each class.
2. Signatures are cut into bands; classes that agree on a band share a bucket.
3. Candidates are verified in steps. Batches of signature rows are compared; after each, a
   pair is dropped when the posterior probability (uniform prior) that its similarity reaches
   the threshold is below ``MISS``. Survivors are compared exactly, on their full sets.
4. Links give connected components.

A bucket may hold very many near copies, so its pairs are not all listed. First every member
is compared with the bucket's hub (drawn anew in every bucket), which joins most of a group of
near copies into one component. Then only members outside the bucket's largest component are
compared with the members of other components: pair by pair in buckets of at most ``SMALL``
classes, in larger ones block by block, where a task verifies all pairs of two blocks and
returns a forest of their links. A pair that is never compared is already connected, or its
set sizes rule it out: components are those of all candidate pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, id_filter, identity, materialize, ship, text_of, with_row

#: A link: 100 * |A & B| >= PERCENT * |A | B|, on sets of shingles of SHINGLE words.
SHINGLE, PERCENT = 5, 80
HASHES, STEP = 128, 32
#: Probability at which a pair at the threshold may share no bucket (0.85: 25 bands of 5 rows, 4e-7).
MISS_BANDS = 1e-6
#: Probability at which a verified pair may be dropped although it reaches the threshold.
MISS = 1e-9
#: Largest bucket whose pairs are listed (so at most SMALL / 2 a member); classes, and shingles,
#: of a block in larger buckets; distinct shingles that are compared at once there.
SMALL, BLOCK, BLOCK_SHINGLES, COLUMNS = 48, 2048, 1 << 20, 4096
MEMORY = 300_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _WordHashes()


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``k``-word shingles (ASCII letters in lower
    case, words split at ASCII white space); fewer words are one shingle, no words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(words) - k + 1
    v = h[:n].copy()
    for i in range(1, k):
        v ^= v >> np.uint64(31)
        v *= _M1
        v += h[i:n + i] * _M2
    v ^= v >> np.uint64(32)
    v *= _M3
    v ^= v >> np.uint64(29)
    return np.unique(v)


def banding(threshold: float, miss: float = MISS_BANDS, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the longest rows whose bands miss a pair at the threshold rarely enough."""
    fitting = [(hashes // r, r) for r in range(1, hashes + 1) if (1 - threshold ** r) ** (hashes // r) <= miss]
    return fitting[-1] if fitting else (hashes, 1)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240817)
    a = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


_A, _B = _permutations()


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of ``HASHES`` hash functions, upper 32 bits."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for s in range(0, len(hashes), 256):
        low = np.minimum(low, (hashes[s:s + 256, None] * _A + _B).min(axis=0))
    return (low >> np.uint64(32)).astype("<u4")


def least_matches(threshold: float, miss: float = MISS, step: int = STEP, hashes: int = HASHES) -> list[tuple[int, int]]:
    """(rows compared, fewest equal rows to go on) after each batch.

    With m of n rows equal and a uniform prior the similarity is Beta(m + 1, n - m + 1), so it
    reaches t with the probability that Bin(n + 1, t) is at most m.
    """
    out = []
    for n in range(step, hashes + 1, step):
        p, m = 0.0, -1
        while p < miss:
            m += 1
            p += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _sign(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, cls, sig = [], [], []
            for t in batch.column(1):
                h = shingle_set(t.as_py(), shingle)
                size.append(len(h))
                cls.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sig.append(signature(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "cls", "sig"])

    return run


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, bands + 1, dtype=np.uint64) * _M1
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u4").reshape(n, HASHES)
            parts = sig[:, :bands * rows].reshape(n, bands, rows).astype(np.uint64)
            key = np.broadcast_to(salt, (n, bands)).copy()
            for r in range(rows):
                key = (key ^ (key >> np.uint64(30))) * _M2 + parts[:, :, r] * _M3
            key ^= key >> np.uint64(31)
            at = pa.array(np.repeat(np.arange(n), bands))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int32), n)),
                 batch.column(0).take(at), batch.column(1).take(at)], names=["key", "band", "cls", "n"])

    return run


def _bayes(threshold: float):
    rule = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u4").reshape(n, HASHES) for i in (2, 3))
            alive, equal, done = np.arange(n), np.zeros(n, dtype=np.int64), 0
            for upto, least in rule:
                equal[alive] += (a[alive, done:upto] == b[alive, done:upto]).sum(axis=1)
                alive, done = alive[equal[alive] >= least], upto
            keep = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return run


def _full_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())],
                names=["cls", "members"])

    return run


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all of ``a`` with all of ``b`` (sorted distinct hashes), exact:
    sums of products of 0 / 1 matrices over a slice of the shared hashes at a time."""
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    place = []
    for sets in (a, b):
        rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        place.append((rows[hit][order], at[hit][order]))
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for lo in range(0, len(shared), COLUMNS):
        parts = []
        for (rows, at), n in zip(place, (len(a), len(b))):
            s, e = np.searchsorted(at, [lo, lo + COLUMNS])
            m = np.zeros((n, min(COLUMNS, len(shared) - lo)), dtype=np.float32)
            m[rows[s:e], at[s:e] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _block_links(percent: int, bands: int, rows: int):
    """Verify all pairs of askers and answerers of a bucket's two blocks; a forest of links."""
    rule = least_matches(percent / 100)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, ans = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        empty = pd.DataFrame({"a": pd.Series(dtype=object), "b": pd.Series(dtype=object)})
        if ask.empty or ans.empty:
            return empty
        band = int(pdf["band"].iloc[0])
        sig = [np.frombuffer(b"".join(x["sig"]), dtype="<u4").reshape(len(x), HASHES) for x in (ask, ans)]
        roots, at = np.unique(np.concatenate([ask["root"], ans["root"]]), return_inverse=True)
        ra, rb = at[:len(ask)], at[len(ask):]
        na, nb = ask["n"].to_numpy(), ans["n"].to_numpy()
        # where a component asks, it answers too: one of the two directions is enough
        open_ = (ra[:, None] != rb[None, :]) & (ans["in_large"].to_numpy()[None, :] | (ra[:, None] < rb[None, :]))
        open_ &= 100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :])
        for k in range(band):  # pairs that share an earlier band are verified in that bucket
            keys = [np.ascontiguousarray(x[:, k * rows:(k + 1) * rows]).view(f"V{4 * rows}").ravel() for x in sig]
            _, same = np.unique(np.concatenate(keys), return_inverse=True)
            open_ &= same[:len(ask), None] != same[None, len(ask):]
        i, j = np.nonzero(open_)
        equal, done = np.zeros(len(i), dtype=np.int64), 0
        for upto, least in rule:  # the sequential test, a slice of pairs at a time
            for lo in range(0, len(i), 1 << 17):
                s = slice(lo, lo + (1 << 17))
                equal[s] += (sig[0][i[s], done:upto] == sig[1][j[s], done:upto]).sum(axis=1)
            live = equal >= least
            i, j, equal, done = i[live], j[live], equal[live], upto
        if not len(i):
            return empty
        asked, u = np.unique(i, return_inverse=True)
        answered, v = np.unique(j, return_inverse=True)
        sets = [[np.frombuffer(m, dtype=np.uint64) for m in x["members"].iloc[k]] for x, k in ((ask, asked), (ans, answered))]
        if len(i) * 20 < len(asked) * len(answered):
            both = np.array([len(np.intersect1d(sets[0][p], sets[1][q], assume_unique=True)) for p, q in zip(u, v)])
        else:
            both = _intersections(*sets)[u, v].astype(np.int64)
        ok = 100 * both >= percent * (na[i] + nb[j] - both)
        # a spanning forest over the components that the links join
        up, keep = list(range(len(roots))), []
        for p, q in zip(i[ok].tolist(), j[ok].tolist()):
            x, y = int(ra[p]), int(rb[q])
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x != y:
                up[max(x, y)] = min(x, y)
                keep.append((p, q))
        if not keep:
            return empty
        p, q = (list(x) for x in zip(*keep))
        return pd.DataFrame({"a": ask["cls"].iloc[p].to_numpy(), "b": ans["cls"].iloc[q].to_numpy()})

    return run


class _Verifier:
    """Verifies candidate pairs of classes; keeps the full sets that it has read."""

    def __init__(self, rows: DataFrame, classes: DataFrame, percent: int, shingle: int):
        self.rows, self.classes, self.percent, self.shingle, self.sets = rows, classes, percent, shingle, None

    def links(self, pairs: DataFrame) -> DataFrame:
        sig = self.classes.select("cls", "sig")
        both = pairs.join(sig.select(F.col("cls").alias("a"), F.col("sig").alias("sa")), "a").join(
            sig.select(F.col("cls").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
        alive = materialize(both.mapInArrow(_bayes(self.percent / 100), "a binary, b binary"), "alive")
        self.read_sets(alive.select(F.col("a").alias("cls")).union(alive.select(F.col("b").alias("cls"))))
        full = lambda c: self.sets.select(F.col("cls").alias(c), F.col("members").alias(f"s{c}"))
        found = alive.join(full("a"), "a").join(full("b"), "b").select("a", "b", "sa", "sb")
        return materialize(found.mapInArrow(_exact(self.percent), "a binary, b binary"), "links")

    def read_sets(self, need: DataFrame) -> None:
        need = need.distinct()
        if self.sets is not None:
            need = need.join(self.sets.select("cls"), "cls", "left_anti")
        need = materialize(need.join(self.classes.select("cls", "rep"), "cls").select("cls", F.col("rep").alias("key")),
                           "need")
        texts = id_filter(self.rows, "key", need.select("key").where("key IS NOT NULL").distinct())
        # classes that have null keys only are found among the rows without a key
        texts = texts.unionByName(self.rows.where("key IS NULL"))
        # a repeated key may hold other texts as well: the digest says which are meant
        sets = texts.select("text").mapInArrow(_full_sets(self.shingle), "cls binary, members binary").join(
            need.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
        new = materialize(sets, "sets")
        self.sets = new if self.sets is None else self.sets.union(new)


def _fits(a: str, b: str, percent: int):
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _listed(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs still open in small buckets."""
    left = members.where("NOT in_large AND cls <> hub").select(
        "key", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    right = members.where("cls <> hub").select(
        "key", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), "in_large")
    pairs = left.join(right, "key").where("ra <> rb AND (in_large OR a < b)").where(_fits("na", "nb", percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _blocks(verifier: _Verifier, members: DataFrame, percent: int, band_rows: tuple[int, int]) -> DataFrame:
    """Links found in large buckets, by pairs of blocks. Blocks hold at most about ``BLOCK`` classes
    and ``BLOCK_SHINGLES`` shingles (one set at least), so a task's size does not follow the bucket's."""
    verifier.read_sets(members.select("cls"))
    n_blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    full = members.withColumn("blocks", n_blocks).join(verifier.classes.select("cls", "sig"), "cls").join(
        verifier.sets, "cls").select("key", "band", "cls", "n", "root", "in_large", "blocks", "sig", "members")
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cols = ["key", "band", "cls", "n", "root", "in_large", "sig", "members"]
    asks = full.where("NOT in_large").select(*cols, own.alias("ask"), every.alias("answer"), F.lit(True).alias("asks"))
    answers = full.select(*cols, every.alias("ask"), own.alias("answer"), F.lit(False).alias("asks"))
    found = asks.unionByName(answers).groupBy("key", "ask", "answer").applyInPandas(
        _block_links(percent, *band_rows), "a binary, b binary")
    return materialize(found, "block_links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
                    shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``key``, ``n_shingles``, ``component_id`` (smallest key that links
    reach, itself included) and ``kept`` (``key`` = ``component_id``).

    Texts that are null, empty or white space have no shingles and link with nothing. A row with a
    null key links others like any, but names no component and is kept, its ``component_id`` null. Rows with equal texts are
    one class; a key may repeat, each row counts by its own text. Empty in, empty out.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    signed = materialize(rows.mapInArrow(_sign(shingle), f"doc_id {kind}, n_shingles long, cls binary, sig binary"), "signed")
    classes = materialize(signed.where("cls IS NOT NULL").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")

    # buckets of two classes or more, with a hub each: the class with the smallest hash there
    band_rows = banding(percent / 100)
    bands = classes.select("cls", "n", "sig").mapInArrow(_bands(*band_rows), "key long, band int, cls binary, n long")
    hub = F.min(F.struct(F.xxhash64("cls", "key").alias("x"), "cls", "n"))
    hubs = materialize(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), hub.alias("h"))
                       .where("size > 1").select("key", "size", "shingles", F.col("h.cls").alias("hub"),
                                                 F.col("h.n").alias("hub_n")), "hubs")
    members = materialize(bands.join(hubs, "key"), "members")

    verifier = _Verifier(rows, classes, percent, shingle)
    star = members.where("cls <> hub").where(_fits("n", "hub_n", percent))
    star = star.select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b")).distinct()
    links = verifier.links(materialize(star, "star"))
    roots = materialize(components(links), "roots")

    # what is not connected yet: members outside a bucket's largest component against the others
    placed = materialize(members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
        "key", "band", "cls", "n", "hub", "size", "shingles", F.coalesce("root", "cls").alias("root")), "placed")
    per_root = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    open_ = materialize(per_root.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("k"))
                        .where("k > 1").select("key", F.col("m.root").alias("large")), "open")
    open_members = materialize(placed.join(open_, "key").withColumn("in_large", F.col("root") == F.col("large")), "rest")
    more = verifier.links(materialize(_listed(open_members.where(F.col("size") <= SMALL), percent), "listed"))
    blocks = _blocks(verifier, open_members.where(F.col("size") > SMALL), percent, band_rows)
    roots = components(links.union(more).union(blocks))

    by_class = classes.select("cls", "rep").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "rep", F.coalesce("root", "cls").alias("root"))
    by_class = materialize(by_class, "by_class")
    smallest = by_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = materialize(by_class.join(smallest, "root").select("cls", "component_id"), "ids")
    out = signed.select("doc_id", "n_shingles", "cls").join(ids, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col(key).eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
             shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, one of each group of near duplicates: the smallest key. A row is told
    by its key and text, so a null or repeated key is no special case; of equal rows one stays.
    """
    named = docs.select(identity(key, text=text).alias("row_id"), F.col(text).alias("text"))
    kept = near_duplicates(named, "row_id", "text", percent, shingle).where("kept").select("row_id").distinct()
    rows = with_row(docs, id=identity(key, text=text), bare=text_of(text).rlike("^[ \\t-\\r]*$"))
    k = F.col("id")
    joined = rows.join(materialize(kept, "kept"), k.eqNullSafe(F.col("row_id")), "left_semi")
    # rows without words link with nothing: all of them stay
    nth = F.row_number().over(Window.partitionBy("id").orderBy("id"))
    return joined.withColumn("nth", nth).where("nth = 1 OR bare").select("row.*")
