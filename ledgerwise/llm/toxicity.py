"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other: each is a logistic regression over the terms
that tell the category apart (words and beginnings of words, the best by chi-squared) and the
probabilities of the categories before it. While training, those probabilities come from
models that did not see the row (out-of-fold predictions, terms chosen anew for each), so a
later model meets inputs as reliable as those it gets on unseen documents.

Terms are hashed into ``BUCKETS`` buckets. Spark counts them in the bounded sample of labelled documents and chooses
every model's; the whole chain is fitted by one task that gets the chosen terms only, with sparse matrices. Every
document is then scored in one pass over its words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, ship, text_of, with_row

#: The fit reads at most this many labelled documents, those with the smallest hashes of their keys.
SAMPLE_ROWS = 20_000
FOLDS = 3
#: Terms of a model, and the labelled documents that must hold a term.
TERMS, LEAST_DOCS = 1000, 3
#: Lengths of the words' beginnings that are terms of their own.
BEGINNINGS = (4, 5)
#: Rejecting probability: toxic documents are rare among the labels, so well under a half.
THRESHOLD = 0.25
#: Of the solver: weight of the squared weights in the mean loss, steps, steps remembered, smallest gradient.
DECAY, STEPS, REMEMBERED, FLAT = 1e-4, 60, 10, 1e-6
#: Words whose terms are remembered; buckets that terms are hashed to.
MEMORY, BUCKETS = 300_000, 1 << 22
#: Documents whose terms are held together.
SLICE = 1024

_WORD = re.compile(r"[^\W_]+")


def _hash(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


class _Terms(dict):
    """Word to the hashes of its terms: itself and its beginnings, which carry over to inflected words
    that no label has shown; with ``known``, to the places of those that it holds."""

    def __init__(self, known: dict[int, int] | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple:
        if len(self) >= MEMORY:
            self.clear()
        terms = {_hash(word), *(_hash(f"{n}:{word[:n]}") for n in BEGINNINGS)}
        if self.known is not None:
            terms = {self.known[t] for t in terms if t in self.known}
        out = self[word] = tuple(terms)
        return out


def terms_of(text: str, memory: _Terms) -> list[int]:
    """The whole text's distinct terms, sorted."""
    out: set = set()
    for word in set(_WORD.findall(text.lower())):
        out.update(memory[word])
    return sorted(out)


@dataclass
class Model:
    """One link of a chain: weights of terms and of the categories before it, or a constant."""

    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    before: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    constant: float | None = None

    def predict(self, rows: np.ndarray, terms: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        """Probabilities of ``n`` documents, given as (document, term) pairs and earlier probabilities."""
        if self.constant is not None:
            return np.full(n, self.constant)
        margin = np.full(n, self.intercept) + before @ self.before
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            hit = self.terms[at] == terms
            margin += np.bincount(rows[hit], weights=self.weights[at[hit]], minlength=n)
        return sigmoid(margin)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def best_terms(codes: np.ndarray, rows: np.ndarray, y: np.ndarray, limit: int = TERMS) -> np.ndarray:
    """The ``limit`` terms whose presence depends most on ``y`` (chi-squared), in order."""
    n, positive = float(len(y)), float(y.sum())
    has = np.bincount(codes)
    both = np.bincount(codes[(y > 0)[rows]], minlength=len(has))
    often = np.flatnonzero(has >= LEAST_DOCS)
    has, both = has[often].astype(np.float64), both[often]
    off = both * n - has * positive
    score = off * off / (has * (n - has + 1))
    return np.sort(often[np.lexsort((often, -score))[:limit]])


def minimise(loss, start: np.ndarray) -> np.ndarray:
    """Limited-memory BFGS with a halving line search; ``loss`` returns value and gradient."""
    x, (value, grad) = start, loss(start)
    kept: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(STEPS):
        if np.abs(grad).max() < FLAT:
            break
        way = -grad
        used = []
        for s, d, rho in reversed(kept):
            a = rho * (s @ way)
            way = way - a * d
            used.append(a)
        if kept:
            s, d, _ = kept[-1]
            way = way * ((s @ d) / (d @ d))
        for (s, d, rho), a in zip(kept, reversed(used)):
            way = way + (a - rho * (d @ way)) * s
        slope = grad @ way
        step = 1.0 if kept else min(1.0, 1.0 / max(np.abs(grad).sum(), 1e-12))
        while step > 1e-10:
            new_value, new_grad = loss(x + step * way)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        moved, turned = step * way, new_grad - grad
        x, value, grad = x + moved, new_value, new_grad
        if moved @ turned > 1e-12:
            kept = [*kept, (moved, turned, 1 / (moved @ turned))][-REMEMBERED:]
    return x


def fit(rows: np.ndarray, codes: np.ndarray, before: np.ndarray, y: np.ndarray) -> Model:
    """A model of ``y`` from (document, term) pairs and earlier probabilities.

    Without two classes the model is a constant, without terms and earlier categories the rate."""
    n, positive = len(y), float(y.sum())
    if positive in (0.0, float(n)):
        return Model(constant=float(n > 0 and positive == n))
    chosen = best_terms(codes, rows, y)
    if not len(chosen):
        return Model(constant=positive / n)
    place = np.full(int(codes.max()) + 1, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    col = place[codes]
    r, c = rows[col >= 0], col[col >= 0]
    k, e = len(chosen), before.shape[1]

    def loss(w):
        margin = np.bincount(r, weights=w[c], minlength=n) + before @ w[k:k + e] + w[-1]
        value = np.logaddexp(0, margin).sum() - (y * margin).sum()
        off = sigmoid(margin) - y
        grad = np.concatenate([np.bincount(c, weights=off[r], minlength=k), before.T @ off, [off.sum()]]) / n
        grad[:-1] += DECAY * w[:-1]
        return value / n + DECAY / 2 * (w[:-1] @ w[:-1]), grad

    w = minimise(loss, np.zeros(k + e + 1))
    return Model(chosen, w[:k], w[k:k + e], float(w[-1]))


def fit_models(terms: list[np.ndarray], y: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> tuple[list[Model], np.ndarray]:
    """The chain's models for the columns of ``y`` (documents x categories, 0 or 1), and the
    out-of-fold probabilities that later models were fitted with.

    A document's probability comes from a model of all other folds' documents, whose own inputs were
    out-of-fold too. A document whose fold holds all documents gets a constant."""
    n, many = y.shape
    # pairs of the bounded sample, four bytes each side
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in terms])
    codes = np.concatenate([np.zeros(0, np.int32), *terms]).astype(np.int32, copy=False)
    unseen, models = np.zeros((n, many)), []
    for i in range(many):
        models.append(fit(rows, codes, unseen[:, :i], y[:, i]))
        if i == many - 1:
            break
        for k in range(folds):
            own = fold == k
            if not own.any():
                continue
            others = ~own[rows]
            place = np.cumsum(~own, dtype=np.int32) - 1
            model = fit(place[rows[others]], codes[others], unseen[~own, :i], y[~own, i])
            place = np.cumsum(own, dtype=np.int32) - 1
            unseen[own, i] = model.predict(place[rows[~others]], codes[~others], int(own.sum()), unseen[own, :i])
    return models, unseen


@dataclass
class Chain:
    categories: list[str]
    models: list[Model]

    def scorer(self):
        """A column function: text to its probabilities, in the order of the chain."""
        models = self.models
        union = np.unique(np.concatenate([np.zeros(0, np.int64), *[m.terms for m in models]]))
        weights = np.zeros((len(models), len(union)))
        for i, m in enumerate(models):
            weights[i, np.searchsorted(union, m.terms)] = m.weights
        known = {t: i for i, t in enumerate(union.tolist())}

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            memory = _Terms(known)
            for texts in batches:
                p = np.zeros((len(texts), len(models)))
                margin = np.array([weights[:, terms_of(t, memory)].sum(axis=1) for t in texts]).reshape(len(texts), -1)
                for i, m in enumerate(models):
                    p[:, i] = m.constant if m.constant is not None else sigmoid(
                        margin[:, i] + m.intercept + p[:, :i] @ m.before)
                yield pd.Series(list(p))
            release()

        return score

    def probabilities(self, text: Column) -> Column:
        return self.scorer()(F.coalesce(text, F.lit("")))


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory = _Terms()
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            found = [np.array(terms_of(t, memory), np.int32) for t in batch.column("text").to_pylist()]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, pa.list_(pa.int32()))],
                                             names=[*keep, "terms"])
    release()


def _only(chosen: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column("terms")
            flat = terms.flatten().to_numpy(zero_copy_only=False)
            hit = np.isin(flat, chosen)
            sizes = np.bincount(pc.list_parent_indices(terms).to_numpy(zero_copy_only=False)[hit], minlength=len(terms))
            left = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat[hit])
            yield batch.set_column(batch.schema.get_field_index("terms"), "terms", left)

    return run


def _fit_task(categories: int, folds: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fold_key")  # the same chain whatever order the rows come in
        y = pdf[[f"y{i}" for i in range(categories)]].to_numpy(np.float64)
        models, _ = fit_models(pdf["terms"].tolist(), y, pdf["fold"].to_numpy(), folds)
        return pd.DataFrame([{
            "category": i, "terms": m.terms.astype("<i8").tobytes(), "weights": m.weights.astype("<f8").tobytes(),
            "before": m.before.astype("<f8").tobytes(), "intercept": m.intercept, "constant": m.constant}
            for i, m in enumerate(models)]).astype({"constant": "float64"})

    return run


def choose_terms(rows: DataFrame, categories: int, folds: int = FOLDS, limit: int = TERMS) -> list[int]:
    """All terms that ``best_terms`` chooses for a model of ``fit_models``, counted by Spark.

    ``rows``: ``fold``, ``terms`` and the categories' columns. Terms depend on the labels alone and not on
    earlier probabilities, so a fit that sees these terms only (with all their documents) is the same."""
    flags = [f"y{i}" for i in range(categories)]
    sizes = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in flags]).collect()}
    if not sizes:
        return []
    in_fold = lambda k, value: F.sum(F.when(F.col("fold") == k, value).otherwise(0.0))
    pairs = rows.select("fold", *flags, F.explode("terms").alias("term"))
    counts = pairs.groupBy("term").agg(
        *[in_fold(k, F.lit(1.0)).alias(f"n_{k}") for k in sizes],
        *[in_fold(k, F.col(y)).alias(f"{y}_{k}") for y in flags for k in sizes]).where(
        sum(F.col(f"n_{k}") for k in sizes) >= LEAST_DOCS)
    counts, best = materialize(counts, "terms"), []
    for i, y in enumerate(flags):
        for own in [None, *(sizes if i < categories - 1 else ())]:
            others = [k for k in sizes if k != own]
            n, positive = (float(sum(sizes[k][c] for k in others)) for c in ("n", y))
            if positive in (0.0, n):
                continue
            both = sum(F.col(f"{y}_{k}") for k in others)
            model = counts.select("term", sum(F.col(f"n_{k}") for k in others).alias("has"), both.alias("both"))
            off = F.col("both") * n - F.col("has") * positive
            score = off * off / (F.col("has") * (F.lit(n) - F.col("has") + 1))
            best.append(model.where(F.col("has") >= LEAST_DOCS).orderBy(score.desc(), "term").limit(limit).select("term"))
    return [r["term"] for r in reduce(DataFrame.union, best).distinct().collect()] if best else []


def fit_chain(labelled: DataFrame, categories: list[str], folds: int = FOLDS) -> Chain:
    """``labelled``: ``fold_key`` (unique), ``terms`` and 0 / 1 columns ``y0``, ``y1``, ... per category, no nulls;
    it is read three times.

    One task fits, from the bounded sample's terms that some model chooses. A category that has one value only
    gets a constant model (its rate), and so has every category without labelled documents (0)."""
    rows = labelled.withColumn("fold", F.pmod(F.xxhash64("fold_key", F.lit(11)), F.lit(folds)).cast("int"))
    chosen = np.array(sorted(choose_terms(rows, len(categories), folds)), np.int32)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    found = rows.mapInArrow(_only(chosen), kinds).groupBy().applyInPandas(
        _fit_task(len(categories), folds),
        "category int, terms binary, weights binary, before binary, intercept double, constant double").collect()
    models = [Model(constant=0.0) for _ in categories]
    for r in found:
        get = lambda c, kind, r=r: np.frombuffer(bytes(r[c]), kind).copy()
        constant = None if r["constant"] is None or np.isnan(r["constant"]) else r["constant"]
        models[r["category"]] = Model(get("terms", "<i8"), get("weights", "<f8"), get("before", "<f8"), r["intercept"], constant)
    return Chain(list(categories), models)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample_rows: int = SAMPLE_ROWS,
          key: str = "doc_id", text: str = "text") -> Chain:
    """A chain for ``categories`` (name: SQL condition on ``labels``, in the chain's order).

    The fit reads at most ``sample_rows`` labelled documents. Labels of a null key, and a
    category's null conditions, count as 0; a key with several labels has a category if one
    of them says so. Without labelled documents every probability is 0.
    """
    ship(docs.sparkSession)
    flags = [F.coalesce(F.expr(cond).cast("int"), F.lit(0)).alias(f"y{i}") for i, cond in enumerate(categories.values())]
    truth = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("fold_key"), *flags)
    truth = truth.groupBy("fold_key").agg(*[F.max(f"y{i}").cast("double").alias(f"y{i}") for i in range(len(categories))])
    sample = truth.orderBy(F.xxhash64("fold_key", F.lit(5)), "fold_key").limit(sample_rows)
    # at most sample_rows short rows: a broadcast of a bounded size
    rows = docs.select(F.col(key).alias("fold_key"), text_of(text).alias("text")).join(F.broadcast(sample), "fold_key")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    gathered = rows.mapInArrow(_gather, f"{kinds}, terms array<int>")
    # of several documents under one key the one with the first terms: the labels cannot tell them apart
    flags = [F.first(f"y{i}").alias(f"y{i}") for i in range(len(categories))]
    one = gathered.groupBy("fold_key").agg(F.min("terms").alias("terms"), *flags)
    return fit_chain(materialize(one, "labelled"), list(categories))


def classify(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``key``, ``p_<category>`` for every category, and ``rejected``, whether
    the last category's probability reaches ``threshold``.

    The whole text counts; a null or empty text has no words and only the models' intercepts;
    repeated rows and null keys are scored like any; empty in, empty out. No shuffle.
    """
    ship(docs.sparkSession)
    scored = docs.select(F.col(key).alias(key), chain.probabilities(F.col(text)).alias("p"))
    cols = [F.col("p")[i].alias(f"p_{c}") for i, c in enumerate(chain.categories)]
    return scored.select(key, *cols, (F.col("p")[len(cols) - 1] >= threshold).alias("rejected"))


def drop_rejected(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``classify`` does not reject, scored in place (no join)."""
    ship(docs.sparkSession)
    scored = with_row(docs, p=chain.probabilities(F.col(text)))
    return scored.where(F.col("p")[len(chain.categories) - 1] < threshold).select("row.*")
