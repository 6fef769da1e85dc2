"""Edit-aware token counts over segment trees of pre-tokens.

A document's pre-tokens are grouped into segments, the leaves of a sum tree of token counts.
Segments end only where the pre-tokenizer must break whatever stands on either side: between
a character that is no white space and a single space followed by a letter. So a segment's
tokens depend on its own text alone, and the document's count is the tree's root. An edit
re-encodes the segments it touches, plus the neighbour whose boundary characters it touches,
and adds the differences up the tree; all other counts stay.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, text_of

#: Characters after which a segment ends at the next sure boundary.
SEGMENT = 256
_SURE = re.compile(r"\S(?=[ \n]\S)")
# -- fixed value: the vocabulary's pre-token pattern ---------------------------------------
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

TREE = T.StructType([T.StructField("lengths", T.ArrayType(T.IntegerType())),
                     T.StructField("tree", T.ArrayType(T.LongType()))])
EDITED = T.StructType([*TREE.fields, T.StructField("text", T.StringType()),
                       T.StructField("encoded_chars", T.LongType())])


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(text: str, size: int = SEGMENT) -> list[int]:
    """Ends of the segments of ``text``; the last is its length."""
    ends, at = [], 0
    while (m := _SURE.search(text, at + size - 1)) is not None:
        at = m.end()
        ends.append(at)
    if at < len(text) or not ends:
        ends.append(len(text))
    return ends


def count_segments(enc, text: str, start: int, ends: list[int]) -> list[int]:
    out = []
    for e in ends:
        out.append(len(enc.encode_ordinary(text[start:e])))
        start = e
    return out


def sum_tree(counts: list[int]) -> np.ndarray:
    """Heap order: node 1 is the root, leaves from a power of two on, unused ones 0."""
    width = 1 << max(0, (len(counts) - 1).bit_length())
    tree = np.zeros(2 * width, dtype=np.int64)
    tree[width:width + len(counts)] = counts
    level = width
    while level > 1:
        tree[level // 2:level] = tree[level:2 * level].reshape(-1, 2).sum(axis=1)
        level //= 2
    return tree


def add_up(tree: np.ndarray, leaf: int, difference: int) -> None:
    """Add to a leaf's count and to every subtree that holds it."""
    node = len(tree) // 2 + leaf
    while node:
        tree[node] += difference
        node //= 2


def apply_edit(enc, text: str, ends: list[int], tree: np.ndarray, edit) -> tuple[str, list[int], np.ndarray, int]:
    """One edit ``(start, end, replacement)`` in code points; clipped to the text."""
    start = min(max(edit[0], 0), len(text))
    end = min(max(edit[1], start), len(text))
    new = edit[2] or ""
    # A boundary at b is sure because of the characters b-1, b and b+1. Segments whose
    # boundaries keep these three stay; the rest, first .. last, are encoded again.
    first = bisect_right(ends, start - 2)          # boundaries before stay if b + 1 < start
    last = bisect_right(ends, end)                 # boundaries after stay if b - 1 >= end
    first, last = min(first, len(ends) - 1), min(last, len(ends) - 1)
    left, right = (ends[first - 1] if first else 0), ends[last]
    text = text[:start] + new + text[end:]
    shift = len(new) - (end - start)
    middle = text[left:right + shift]
    cuts = [left + e for e in cut(middle)]
    if not middle and len(ends) > last - first + 1:
        cuts = []                                  # everything between two boundaries went
    counts = count_segments(enc, text, left, cuts)
    if len(cuts) == last - first + 1:              # same shape: only sums on the way to the root change
        width = len(tree) // 2
        for k, c in enumerate(counts):
            if c != tree[width + first + k]:
                add_up(tree, first + k, c - int(tree[width + first + k]))
    else:
        width, n = len(tree) // 2, len(ends)
        tree = sum_tree([*tree[width:width + first].tolist(), *counts, *tree[width + last + 1:width + n].tolist()])
    return text, [*ends[:first], *cuts, *[e + shift for e in ends[last + 1:]]], tree, len(middle)


def state_of(enc, text: str) -> tuple[list[int], np.ndarray]:
    ends = cut(text)
    return ends, sum_tree(count_segments(enc, text, 0, ends))


def build(path: str, text: Column) -> Column:
    """A document's state: segment lengths and the sum tree (a struct of two arrays)."""

    @F.pandas_udf(TREE)
    def trees(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for texts in batches:
            rows = []
            for t in texts:
                ends, tree = state_of(enc, t or "")
                rows.append((np.diff([0, *ends]), tree))
            yield pd.DataFrame(rows, columns=["lengths", "tree"])

    return trees(text)


def edit(path: str, text: Column, state: Column, edits: Column) -> Column:
    """Text and state after ``edits``, an array of structs (start, end, replacement), each
    in the code points of the text that the one before left. A null edit, and one with a null
    start or end, does nothing; a null replacement is the empty text, and so is a null text."""

    @F.pandas_udf(EDITED)
    def edited(batches: Iterator[tuple[pd.Series, pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for texts, states, changes in batches:
            rows = []
            for t, lengths, tree, todo in zip(texts, states["lengths"], states["tree"], changes):
                t, done = t or "", 0
                if lengths is None:
                    ends, tree = state_of(enc, t)
                else:
                    ends, tree = np.cumsum(lengths).tolist(), np.array(tree, dtype=np.int64)
                for e in (todo if todo is not None else ()):
                    e = tuple(e.values()) if isinstance(e, dict) else e
                    if e is None or any(x is None or x != x for x in e[:2]):  # pandas may turn null into NaN
                        continue
                    t, ends, tree, n = apply_edit(enc, t, ends, tree, (int(e[0]), int(e[1]), e[2]))
                    done += n
                rows.append((np.diff([0, *ends]), tree, t, done))
            yield pd.DataFrame(rows, columns=["lengths", "tree", "text", "encoded_chars"])

    return edited(text, state, edits)


def total(state: Column) -> Column:
    """A document's tokens: the root of its tree (with a single segment, that leaf)."""
    return F.element_at(state["tree"], 2)


def count_with_edits(docs: DataFrame, edits: Column, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token counts before and after ``edits`` (an array column of ``docs``; null: none).

    Returns ``key``, ``tokens_before``, ``tokens_after``, ``n_segments``, ``encoded_chars``
    (re-encoded for the edits), ``n_chars_after``. A null text is empty (0 tokens, one empty
    segment); keys may be null or repeated: each row is counted by itself, no shuffle.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"), edits.alias("edits"))
    rows = rows.withColumn("state", build(path, F.col("text")))
    rows = rows.withColumn("after", edit(path, F.col("text"), F.col("state"), F.col("edits")))
    return rows.select(F.col("key").alias(key), total(F.col("state")).alias("tokens_before"),
                       total(F.col("after")).alias("tokens_after"),
                       F.size(F.col("after.lengths")).cast("long").alias("n_segments"),
                       F.col("after.encoded_chars").alias("encoded_chars"),
                       F.length(F.col("after.text")).cast("long").alias("n_chars_after"))


def apply_edit_table(states: DataFrame, edits: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Apply a table of edits (``key``, ``seq``, ``start``, ``end``, ``replacement``) to stored
    documents (``key`` unique, ``text``, ``state``): edits of a document are gathered in the
    order of ``seq``; documents without edits keep their state and are not encoded."""
    ship(states.sparkSession)
    todo = edits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("_t"))
    todo = todo.select(F.col(key), F.transform("_t", lambda x: F.struct(x["start"], x["end"], x["replacement"])).alias("_t"))
    joined = states.join(todo, key, "left").withColumn("_a", edit(path, F.col("text"), F.col("state"), F.col("_t")))
    return joined.select(key, F.col("_a.text").alias("text"),
                         F.struct(F.col("_a.lengths").alias("lengths"), F.col("_a.tree").alias("tree")).alias("state"),
                         F.col("_a.encoded_chars").alias("encoded_chars"))
