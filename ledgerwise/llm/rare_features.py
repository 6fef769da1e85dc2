"""Similarity digests of documents from their improbable byte windows.

Every window of ``WINDOW`` bytes has a Shannon entropy, in one of ``BINS`` steps. How often each
step occurs in the corpus, counted over all windows of all texts, ranks the steps: the rarer,
the more improbable the window. Among every ``WINDOW`` consecutive windows the leftmost of the
best rank gets a point; windows with ``POINTS`` points are the text's features. Their distinct
hashes go, in order of first appearance, into a chain of Bloom filters, ``FEATURES`` each.
Two digests are compared filter by filter: the bits in common above those expected by chance,
as a share of the most that could be in common; the best partner of each filter counts.

Documents are sorted once by range. A task takes its rows in that order, so each meets the next
one without a join; only a task's first and last rows wait for the neighbouring tasks' rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship, text_of

#: Bytes of a window, and windows that compete for a point; points that make a feature; steps of entropy.
WINDOW, POINTS, BINS = 32, 8, 1280
#: Steps below this are near-constant bytes, which tell no texts apart: they rank last.
LEAST_BIN = 128
#: Bytes of a filter, features of a filter, bits that a feature sets (11 of its hash each).
FILTER, FEATURES, HASHES = 256, 160, 5
#: Standard deviations by which an overlap must exceed chance.
CHANCE = 3.0
#: Bytes worked on at once, and bytes of texts whose features are taken together.
PIECE, GROUP = 1 << 16, 4 << 20

_COUNT = np.arange(WINDOW + 1, dtype=np.float64)
# c * log2(c) in units of 2^-16, whole numbers: sums do not depend on where a piece starts
_PLOGP = np.rint(_COUNT * np.log2(np.maximum(_COUNT, 1)) * (1 << 16)).astype(np.int32)
_STEP = np.diff(_PLOGP)
_FULL = int(_PLOGP[WINDOW])
_CUTS = np.arange(0, 11 * HASHES, 11, dtype=np.uint64)
_SHIFT = (_FULL // BINS).bit_length() - 1  # WINDOW * log2(WINDOW) = 160 units of entropy, 8 steps each


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """The entropy step (0 to ``BINS``) of every window of ``data`` (bytes).

    A byte that enters a window changes the sum of c * log2(c) by what its count before tells, one
    that leaves by what its count after does; both counts come from comparing the bytes with
    themselves at every distance within a window.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    # running sums may wrap around; their difference, the sum of one window, does not
    total = np.cumsum(_STEP[before], dtype=np.int32)[WINDOW - 1:]
    total[1:] -= np.cumsum(_STEP[after[:n - 1]], dtype=np.int32)
    return (_FULL - total) >> _SHIFT


def _pieces(n: int, halo: int):
    for at in range(0, n, PIECE):
        yield at, min(n, at + PIECE), max(0, at - halo)


def _valid(ends: np.ndarray, n: int) -> np.ndarray:
    """Whether a window starting at each byte of joined texts (ending at ``ends``) stays in its text."""
    ok = np.ones(n, bool)
    for back in range(1, WINDOW):
        at = ends - back
        ok[at[at >= 0]] = False
    return ok


def histogram(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Windows in each entropy step, over the texts joined in ``data``."""
    out = np.zeros(BINS + 1, np.int64)
    ok = _valid(ends, len(data))
    for at, end, _ in _pieces(len(data) - WINDOW + 1, 0):
        bins = entropy_bins(data[at:end + WINDOW - 1])
        out += np.bincount(bins[ok[at:end]], minlength=BINS + 1)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Place of each entropy step from the rarest on; near-constant windows last."""
    bins = np.arange(BINS + 1)
    order = np.lexsort((bins, counts, bins < LEAST_BIN))
    out = np.empty(BINS + 1, np.int32)
    out[order] = bins
    return out


def points(data: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Points of the window starting at each byte; windows that leave their text have none."""
    n = max(0, len(data) - WINDOW + 1)
    out = np.zeros(n, np.uint8)
    ok = _valid(ends, len(data))
    for at, end, low in _pieces(n, WINDOW - 1):
        # the places of this piece can win in competitions from up to a window before to its end
        high = min(n, end + WINDOW - 1)
        key = rank[entropy_bins(data[low:high + WINDOW - 1])]
        key[~ok[low:high]] = BINS + 1  # a text's last WINDOW - 1 places: no competition reaches the next text
        key = (key << 20) + np.arange(high - low, dtype=np.int32)
        best = np.concatenate([key, np.full(WINDOW - 1, np.iinfo(np.int32).max, np.int32)])
        span = 1
        while span < WINDOW:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        won = (best[:end - low][ok[low:end]] & ((1 << 20) - 1)) + low
        won = won[(won >= at) & (won < end)]
        out[at:end] += np.bincount(won - at, minlength=end - at).astype(np.uint8)
    return out


class Digest:
    """A chain of filters: ``count`` features altogether, all filters full but the last."""

    def __init__(self, count: int, filters: np.ndarray):
        self.count, self.filters = count, filters

    @classmethod
    def of(cls, hashes: np.ndarray) -> Digest:
        """From the features' 64-bit hashes, distinct, in order."""
        n = -(-len(hashes) // FEATURES)
        bits = np.zeros(n * FILTER * 8, bool)
        at = ((hashes[:, None] >> _CUTS) & np.uint64(FILTER * 8 - 1)).astype(np.int64)
        at += (np.arange(len(hashes)) // FEATURES * (FILTER * 8))[:, None]
        bits[at.ravel()] = True
        return cls(len(hashes), np.packbits(bits).reshape(n, FILTER))

    def __bytes__(self) -> bytes:
        return self.count.to_bytes(8, "little") + self.filters.tobytes()

    def __str__(self) -> str:
        return base64.b64encode(bytes(self)).decode()

    @classmethod
    def parse(cls, text: str) -> Digest:
        raw = base64.b64decode(text)
        return cls(int.from_bytes(raw[:8], "little"), np.frombuffer(raw[8:], np.uint8).reshape(-1, FILTER))

    def weights(self) -> np.ndarray:
        return np.diff(np.minimum(np.arange(len(self.filters) + 1) * FEATURES, self.count))


def _one_way(a: Digest, b: Digest) -> float:
    x, y = a.filters.view(np.uint64), b.filters.view(np.uint64)
    bits_y = np.bitwise_count(y).sum(axis=1, dtype=np.float64)
    m, score = FILTER * 8.0, np.zeros(len(x))
    step = max(1, (1 << 21) // (len(y) * x.shape[1]))
    for at in range(0, len(x), step):
        part = x[at:at + step]
        common = np.bitwise_count(part[:, None, :] & y[None, :, :]).sum(axis=2, dtype=np.float64)
        bits_x = np.bitwise_count(part).sum(axis=1, dtype=np.float64)[:, None]
        mean = bits_x * bits_y / m
        least = mean + CHANCE * np.sqrt(mean * (1 - bits_x / m) * (1 - bits_y / m))
        most = np.minimum(bits_x, bits_y)
        share = np.where(common >= most, 1.0, (common - least) / np.maximum(most - least, 1e-9))
        score[at:at + step] = np.clip(np.where(common > least, share, 0.0), 0, 1).max(axis=1)
    return float((score * a.weights()).sum() / a.count)


def likeness(a: Digest | str, b: Digest | str) -> float:
    """0 to 1: how much of the digest with fewer features the other holds (equally many: the mean of
    both ways). Equal digests have 1, two without features too, one without features 0."""
    a, b = (Digest.parse(d) if isinstance(d, str) else d for d in (a, b))
    if a.count == b.count and np.array_equal(a.filters, b.filters):
        return 1.0
    if not a.count or not b.count:
        return 0.0
    if a.count == b.count:
        return (_one_way(a, b) + _one_way(b, a)) / 2
    return _one_way(a, b) if a.count < b.count else _one_way(b, a)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


def digests(texts: list[bytes], rank: np.ndarray) -> list[Digest]:
    """A digest per text. A text shorter than a window is one feature, an empty one has none; a text in
    which no window has ``POINTS`` points takes those with the most."""
    data, ends = _joined(texts)
    score = points(data, ends, rank)
    out, start = [], 0
    for text, end in zip(texts, ends.tolist()):
        if len(text) < WINDOW:
            found = [text] if text else []
        else:
            mine = score[start:end - WINDOW + 1]
            at = np.flatnonzero(mine >= min(POINTS, int(mine.max()))).tolist()
            found = [text[i:i + WINDOW] for i in at]
        # distinct, in order of first appearance
        hashes = np.fromiter(dict.fromkeys(map(xxhash.xxh3_64_intdigest, found)), np.uint64)
        out.append(Digest.of(hashes))
        start = end
    return out


def _groups(texts: list[bytes]) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BINS + 1, np.int64)
    for batch in batches:
        texts = [_raw(t) for t in batch.column(0).to_pylist()]
        for part in _groups(texts):
            total += histogram(*_joined(texts[part]))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bin", "n"])


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Windows of all texts in each entropy step (``BINS`` + 1 numbers). No text is shuffled."""
    ship(docs.sparkSession)
    counts = docs.select(text_of(text).alias("text")).mapInArrow(_count, "bin int, n long")
    out = np.zeros(BINS + 1, np.int64)
    for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


# digests and hashes are written as bytes, a quarter and a half shorter than their texts
_OUT = ("n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, "
        "near_next double")
_NAMES = [f.split()[0] for f in _OUT.split(", ")]


def _compare(text: str, own: Digest, after: str, after_digest: Digest, changed: bytes, changed_digest: Digest) -> tuple:
    return (len(text), hashlib.sha256(changed).digest(), bytes(own), bytes(changed_digest), likeness(own, changed_digest),
            likeness(own, after_digest))


def _walk(rank: np.ndarray, schema: pa.Schema):
    """Sorted rows (key, text, part) of a task: all but the last are compared with the row after them;
    the first and the last also carry their texts, for the tasks beside this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row so far: key, part, text, digest
        first = True
        for batch in batches:
            keys, parts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            whole = batch.column(1).to_pylist()
            raw = [_raw(t) for t in whole]
            for group in _groups(raw):
                texts = whole[group]
                rows = list(zip(keys[group], parts[group], texts, digests(raw[group], rank)))
                chain = [held, *rows] if held else rows
                changed = [_raw(edited(a[2], b[2])) for a, b in zip(chain, chain[1:])]
                out = []
                for (key, part, text, own), b, new, new_digest in zip(chain, chain[1:], changed, digests(changed, rank)):
                    out.append((key, *_compare(text, own, b[2], b[3], new, new_digest), part, first, False, text if first else None))
                    first = False
                held = chain[-1]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else
                                                 [pa.array([], f.type) for f in schema], schema=schema)
        if held:
            key, part, text, own = held
            last = (key, len(text), None, bytes(own), None, None, None, part, first, True, text)
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(last, schema)], schema=schema)

    return run


def _edge(rank: np.ndarray, schema: pa.Schema):
    """(key, text, after) of the tasks' last rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, after in zip(*(batch.column(i).to_pylist() for i in range(3))):
                new = _raw(edited(text, after))
                own, next_digest, new_digest = digests([_raw(text), _raw(after), new], rank)
                out.append((key, *_compare(text, own, after, next_digest, new, new_digest)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def fingerprint(docs: DataFrame, counts: np.ndarray | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``.

    Documents follow one another by falling ``key`` (nulls last; rows of one key by a hash of
    their texts), the first after the last; a single document follows itself. The edited text is
    the text with its last half replaced by the start of the next one's. ``counts`` (default:
    ``rarity`` of these documents) ranks the windows: digests compare only under equal counts.
    Whole texts count; a null text is empty; equal texts have equal digests, repeated rows each
    their row; empty in, empty out.
    """
    spark = docs.sparkSession
    ship(spark)
    rank = ranks(rarity(docs, text) if counts is None else counts)
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    kind = rows.schema["key"].dataType
    # the last column splits a row that repeats very often over many ranges
    ordered = rows.withColumn("_row", F.monotonically_increasing_id()).orderBy(
        F.desc_nulls_last("key"), F.xxhash64("text"), "_row")
    head = f"key {kind.simpleString()}, {_OUT}"
    full = f"{head}, part int, first boolean, last boolean, text string"
    arrow = _arrow_schema(spark, full)
    walked = materialize(ordered.select("key", "text", F.spark_partition_id().alias("part")).mapInArrow(
        _walk(rank, arrow), full), "fingerprints")
    # the row after a task's last one is the first of the next task that has rows
    parts = walked.where("first").select("part")
    around = Window.orderBy("part")  # a number a task
    order = parts.select("part", F.lead("part").over(around).alias("n"), F.min("part").over(
        around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("least"))
    order = order.select("part", F.coalesce("n", "least").alias("next_part"))
    starts = walked.where("first").select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    tails = walked.where("last").select("key", "part", "text").join(order, "part").join(starts, "next_part")
    done = tails.select("key", "text", "after").mapInArrow(_edge(rank, _arrow_schema(spark, head)), head)
    out = walked.where("NOT last").select("key", *_NAMES).unionByName(done)
    as_text = lambda c: F.translate(F.base64(c), "\r\n", "").alias(c)  # noqa: E731  (Spark may break lines)
    return out.select(F.col("key").alias(key), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
                      as_text("fingerprint"), as_text("edited_fingerprint"), "near_edited", "near_next")


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
