"""Packing by Karmarkar-Karp multiway differencing.

Documents are tokenized and cut into pieces; the pieces of a bounded batch of documents are
spread over windows of near-equal sums by the differencing method: every piece starts as a
partial partition, and the two partitions with the largest spreads merge, the fuller windows
of one on the emptier windows of the other, until one is left. When its fullest window
exceeds the capacity, the number of windows rises and the batch is spread anew.

Batches are formed inside a task, so no row is shuffled and each task's windows are its own:
a retried task gives the same rows. Full windows (``capacity`` ids of one document) are cut
off first; a document's rest is cut further, so that windows hold several pieces and their
sums come near each other.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, ship, text_of

CAPACITY = 2048
#: Documents that are spread together, and the largest piece of a document's rest.
BATCH_DOCS, PIECE = 512, 256
END_ID = 1
#: Entries of a worker's memory of encoded parts of words, and of the words that are not cut.
MEMORY, WHOLE_MEMORY = 450_000, 150_000
#: Bytes of text (one text at least) whose words are looked up together.
BLOCK = 2 << 20

# White space that every splitter here agrees on, and characters whose lower case, normal form
# and class need no tables: words of these are cut into the parts that the tokenizer encodes.
_ODD_SPACE = r"[\x{1c}-\x{1f}\x{85}\x{180e}]"
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
_PARTS = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"


class Memory:
    """Remembers what ``make`` returned for short keys. When half of ``size`` is new, what was
    not asked for since the last such time is forgotten, so frequent keys stay."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        self.make, self.half = make, max(1, size // 2)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, keys: list[str]) -> list[bytes]:
        got = list(map(self.new.get, keys))
        for i, key in enumerate(keys):
            if got[i] is None:
                value = self.old.get(key)
                got[i] = value = self.make(key) if value is None else value
                if len(key) <= 64:
                    if len(self.new) >= self.half:
                        self.old, self.new = self.new, {}
                    self.new[key] = value
        return got


def _strings(of: pa.Array) -> list[str]:
    return of.to_numpy(zero_copy_only=False).tolist()


def _joined(lists: pa.Array, ids_of: Callable) -> pa.Array:
    """The ids of each list of strings in a row; ``ids_of`` is asked once for the distinct strings."""
    strings = lists.flatten().dictionary_encode()
    ids = ids_of(strings.dictionary)
    joined = pa.ListArray.from_arrays(lists.offsets, ids.take(strings.indices))
    return pc.binary_join(joined, pa.scalar(b"", ids.type))


class WordEncoder:
    """Ids (little-endian unsigned 32 bit) of whole texts by a word-level BPE with word ends.

    White space always ends a word, so a text's ids are its words' ids in a row, and a word's
    are those of its parts. The distinct words of a block of texts are cut once, their distinct
    parts looked up once, and frequent parts are remembered. Words outside the plain letters go
    to the tokenizer itself, and so do whole texts that hold an added token, such as
    ``<|endoftext|>``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        added = self.full.get_added_tokens_decoder().values()
        if any(t.normalized for t in added):
            raise ValueError(f"{path}: added tokens that are looked for in normalized texts are not supported")
        self.added = [t.content for t in added]
        self.model = self.full.model
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in kept]
        self.as_char = {**{b: chr(b) for b in kept}, **{b: chr(256 + i) for i, b in enumerate(rest)}}
        self.as_bytes = [i.to_bytes(4, "little") for i in range(max(self.full.get_vocab().values()) + 1)]
        self.parts, self.words = Memory(self._part, MEMORY), Memory(self._ids, WHOLE_MEMORY)

    def _ids(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        chars = part if part.isascii() else part.encode().decode("latin-1").translate(self.as_char)
        return b"".join([self.as_bytes[t.id] for t in self.model.tokenize(chars)])

    def _word_ids(self, words: pa.Array) -> pa.Array:
        plain = pc.match_substring_regex(words, _PLAIN)
        lower = pc.utf8_lower(pc.if_else(plain, words, pa.scalar("", words.type)))
        cut = pc.split_pattern(pc.replace_substring_regex(lower, _PARTS, r"\1" "\n"), "\n")
        ids = _joined(cut, lambda parts: pa.array(self.parts(_strings(parts)), pa.large_binary()))
        other = pc.invert(plain)
        return pc.replace_with_mask(ids, other, pa.array(self.words(_strings(words.filter(other))), ids.type))

    def _block(self, texts: pa.Array) -> list[bytes]:
        whole = pc.match_substring_regex(texts, _ODD_SPACE)
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        split = pc.utf8_split_whitespace(pc.if_else(whole, pa.scalar("", texts.type), texts))
        out = _joined(split, self._word_ids).to_pylist()
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._ids(texts[i].as_py())
        return out

    def many(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text in order; no text is null."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        texts, at = texts.cast(pa.large_string()), 0  # parts of one long text may pass 2 GB
        while at < len(texts):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right"))
            to = max(to, at + 1)
            yield from self._block(texts.slice(at, to - at))
            at = to

    def __call__(self, text: str) -> bytes:
        return next(self.many(pa.array([text], pa.large_string())))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def spread(lengths: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: places of ``lengths`` over ``windows`` windows with near-equal sums."""
    # a partial partition: its non-empty windows' (sum, places), fullest first
    heap = [(-n, i, [(n, [i])]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        # fullest on emptiest: b's windows land on a's empty windows as far as there are any
        free = windows - len(a)
        merged = a + b[:free] if free >= len(b) else a[:]
        if free < len(b):
            merged += b[:free]
            over = b[free:]  # in falling order, on a's windows from the emptiest up
            for j, (n, places) in enumerate(over):
                k = len(a) - 1 - j
                merged[k] = (a[k][0] + n, a[k][1] + places)
        merged.sort(key=lambda w: -w[0])
        if len(merged) == windows and (low := merged[-1][0]):  # only differences matter
            merged = [(n - low, p) for n, p in merged]
        heapq.heappush(heap, (-(merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)), tie, merged))
        tie += 1
    return [sorted(p) for _, p in heap[0][2]] if heap else []


def pack_pieces(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows (lists of places) of at most ``capacity``; every piece is at most that long."""
    windows = max(1, -(-sum(lengths) // capacity))
    while lengths:
        found = spread(lengths, windows)
        if max(sum(lengths[i] for i in w) for w in found) <= capacity:
            return found
        windows += 1
    return []


def _pack_task(tokenizer_path: str, capacity: int, batch_docs: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        end = np.array([END_ID], dtype="<u4").tobytes()
        sequence, pending, out = part << 40, [], []
        key_type = None

        def flush():
            nonlocal sequence, pending
            lengths = [len(p[2]) // 4 for p in pending]
            for window in pack_pieces(lengths, capacity):
                offset = 0
                for i in window:
                    out.append((*pending[i], sequence, offset))
                    offset += lengths[i]
                sequence += 1
            pending = []

        def ready():
            nonlocal out
            cols = list(zip(*out)) if out else [[]] * 6
            out = []
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], key_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()),
                 *[pa.array(c, pa.int64()) for c in cols[3:]]],
                names=["key", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        docs = 0
        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, ids in zip(batch.column(0).to_pylist(), encode.many(batch.column(1))):
                ids += end
                total = len(ids) // 4
                full = total // capacity * capacity
                for s in range(0, full, capacity):
                    out.append((key, s, ids[4 * s:4 * (s + capacity)], total, sequence, 0))
                    sequence += 1
                for s in range(full, total, piece):
                    pending.append((key, s, ids[4 * s:4 * min(s + piece, total)], total))
                docs += 1
                if docs % batch_docs == 0:
                    flush()
                if len(out) >= 4096:
                    yield ready()
            release()
        flush()
        if out:
            yield ready()
        release()

    return run


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         batch_docs: int = BATCH_DOCS, piece: int = PIECE) -> DataFrame:
    """One row per piece: ``key``, ``start``, ``ids`` (binary, little-endian unsigned 32 bit),
    ``doc_tokens``, ``sequence_id``, ``offset`` (place in its sequence, gapless from 0).

    Every document has its text's ids and the end id 1; a null or empty text has the end id
    alone; repeated rows and null keys are documents of their own; a text of any length is cut
    into pieces, none longer than a window; empty in, empty out. Sequence ids hold the task in
    their upper bits.
    """
    if piece > capacity or capacity < 1:
        raise ValueError("piece must not exceed capacity")
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(_pack_task(tokenizer_path, capacity, batch_docs, piece),
                          f"key {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("key", key)
