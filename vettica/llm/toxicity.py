"""Toxicity by class-conditional Kneser-Ney models of word spellings.

Two models of order 5 over the bytes of words, one of toxic and one of ordinary
labelled texts, discount their own highest-order counts; what the discount frees
goes to lower orders that both share, interpolated Kneser-Ney over the pooled
continuation counts.  An expression seen in neither class therefore weighs the
same in both, and rare ones weigh little.  A text's value is the difference of
the two log-likelihoods divided by its symbols; a rising curve fitted on
cross-scored labelled texts (isotonic regression, straight between its blocks)
turns it into 0 to 1, so that each range of values has the precision seen there.

Because the lower orders are shared they cancel in the difference: it is one
number per known 5-gram, else one per known context, else 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettica.llm.bytegrams import looked_up, spelled, summed
from vettica.llm.common import bound_batches, lower_words, remainder, texts

ORDER = 5
#: Each fold is scored by a model of the others; with few folds those models know
#: less than the final one, and their values say too little of its precision.
FOLDS = 10
#: The classifier is fitted on at most so many labelled texts of each class,
#: those with the smallest hash of their id.
SAMPLE = 8_000
#: Distinct words whose weight a worker remembers.
REMEMBERED = 400_000


class Weights(NamedTuple):
    """Log-likelihood differences by gram and, for unknown ones, by context."""

    grams: np.ndarray
    gram_weight: np.ndarray
    contexts: np.ndarray
    context_weight: np.ndarray

    def of_words(self, words: list[bytes]) -> np.ndarray:
        codes, number = spelled(words, ORDER)
        fallback = looked_up(codes >> 8, self.contexts, self.context_weight, 0.0)
        value = looked_up(codes, self.grams, self.gram_weight, np.nan)
        value = np.where(np.isnan(value), fallback, value)
        return np.bincount(number, value, len(words))


class Model(NamedTuple):
    weights: Weights
    #: Values and the shares of toxic texts there, both rising.
    values: np.ndarray
    shares: np.ndarray


class Scorer:
    """Length-normalised differences of texts; remembers the words it has seen."""

    def __init__(self, weights: Weights):
        self.weights = weights
        self.known: dict[bytes, float] = {}

    def values(self, rows: list[str]) -> np.ndarray:
        split = [lower_words(t) for t in rows]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list({w for ws in split for w in ws if w not in self.known})
        if new:
            self.known.update(zip(new, self.weights.of_words(new).tolist(), strict=True))
        known = self.known
        out = np.zeros(len(rows))
        for i, ws in enumerate(split):
            if ws:
                out[i] = sum(known[w] for w in ws) / (sum(map(len, ws)) + len(ws))
        return out


def discount(counts: np.ndarray) -> float:
    """The usual absolute discount n1 / (n1 + 2 n2), kept inside (0, 1)."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def shared_probability(codes: np.ndarray) -> np.ndarray:
    """Interpolated Kneser-Ney of the last byte of each distinct gram given the
    three bytes before it, from the continuation counts of all of ``codes``."""
    below = np.full(len(codes), 1 / 256)
    for order in range(1, ORDER):
        mask = np.int64((1 << 8 * order) - 1)
        # distinct grams one longer: each is one continuation of its last bytes
        longer = np.unique(codes & np.int64((1 << 8 * (order + 1)) - 1))
        grams, counts = summed(longer & mask, np.ones(len(longer)))
        contexts, totals = summed(grams >> 8, counts)
        kinds = summed(grams >> 8, np.ones(len(grams)))[1]
        d = discount(counts)
        own = looked_up(codes & mask, grams, counts, 0.0)
        at = np.searchsorted(contexts, (codes & mask) >> 8)
        below = np.maximum(own - d, 0) / totals[at] + d * kinds[at] / totals[at] * below
    return below


def fit_weights(codes: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Weights:
    """From the distinct grams and their counts in either class."""
    if not len(codes) or not toxic.sum() or not ordinary.sum():
        empty = np.empty(0)
        return Weights(np.empty(0, np.int64), empty, np.empty(0, np.int64), empty)
    shared = shared_probability(codes)
    contexts = np.unique(codes >> 8)
    at = np.searchsorted(contexts, codes >> 8)
    logs, left = [], []
    for counts in (toxic, ordinary):
        d = discount(counts)
        totals = np.bincount(at, counts, len(contexts))
        kinds = np.bincount(at, counts > 0, len(contexts))
        rest = np.where(totals > 0, d * kinds / np.maximum(totals, 1), 1.0)
        own = np.maximum(counts - d, 0) / np.maximum(totals, 1)[at]
        logs.append(np.log(own + rest[at] * shared))
        left.append(np.log(rest))
    return Weights(codes, logs[0] - logs[1], contexts, left[0] - left[1])


def fit_curve(values: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean value and share of toxic texts of each block of an isotonic regression.

    Shares count half a text of either class more, so none is 0 or 1."""
    if not len(values) or labels.min() == labels.max():
        return np.zeros(1), np.array([1 / (1 + math.e)])
    distinct, texts_at = summed(values, np.ones(len(values)))
    toxic_at = summed(values, labels.astype(float))[1]
    blocks: list[tuple[float, float, float]] = []
    for value, ones, n in zip(distinct.tolist(), toxic_at.tolist(), texts_at.tolist(), strict=True):
        block = (value * n, ones, n)
        while blocks and blocks[-1][1] * block[2] >= block[1] * blocks[-1][2]:
            block = tuple(x + y for x, y in zip(blocks.pop(), block, strict=True))
        blocks.append(block)
    total, ones, n = np.array(blocks).T
    return total / n, np.maximum.accumulate((ones + 0.5) / (n + 1))


def labelled_sample(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic, fold) of at most ``sample`` labelled texts per class whose
    crc32 remainder is not 1.  The drawn ids, a bounded number, are broadcast."""
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", 3) != 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    draw = F.xxhash64("doc_id")
    fold = F.pmod(draw, F.lit(FOLDS)).cast("int").alias("fold")
    parts = [known.where(F.col("toxic") == k).orderBy(draw, "doc_id").limit(sample) for k in (0, 1)]
    drawn = parts[0].unionByName(parts[1]).select("doc_id", "toxic", fold)
    return documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic", "fold")


_COUNTS = pa.schema([("fold", pa.int32()), ("toxic", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])


def _count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        by: dict[tuple[int, int], Counter] = {}
        keys = zip(batch.column("fold").to_pylist(), batch.column("toxic").to_pylist(), strict=True)
        for key, text in zip(keys, texts(batch), strict=True):
            by.setdefault(key, Counter()).update(lower_words(text))
        for (fold, toxic), counter in by.items():
            codes, number = spelled(list(counter), ORDER)
            times = np.fromiter(counter.values(), np.int64, len(counter))
            grams, n = summed(codes, times[number])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(grams), fold, np.int32)), pa.array(np.full(len(grams), toxic, np.int32)), pa.array(grams), pa.array(n)],
                schema=_COUNTS,
            )


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts, models and curve from the labelled sample.

    Each fold is scored by the model of the other ones, so the curve sees values as
    unseen texts have them; the final weights use all."""
    spark = bound_batches(documents)
    drawn = labelled_sample(documents, labels, sample)
    counted = (
        drawn.mapInArrow(_count, "fold int, toxic int, gram long, n long")
        .groupBy("fold", "toxic", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    fold, toxic, gram, n = (counted.column(c).to_numpy() for c in ("fold", "toxic", "gram", "n"))
    codes, at = np.unique(gram, return_inverse=True)
    counts = np.zeros((2, len(codes)))
    np.add.at(counts, (toxic, at), n)

    def weights(without: int | None = None) -> Weights:
        ordinary, harmful = counts
        if without is not None:
            rest = counts.copy()
            own = fold == without
            np.subtract.at(rest, (toxic[own], at[own]), n[own])
            ordinary, harmful = rest
        seen = (ordinary + harmful) > 0
        return fit_weights(codes[seen], harmful[seen], ordinary[seen])

    others = spark.sparkContext.broadcast([tuple(weights(k)) for k in range(FOLDS)])

    def cross(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(Weights(*w)) for w in others.value]
        for batch in source:
            own = batch.column("fold").to_numpy()
            rows = texts(batch)
            value = np.zeros(len(rows))
            for k in range(FOLDS):
                mine = np.flatnonzero(own == k)
                value[mine] = scorers[k].values([rows[i] for i in mine])
            yield pa.RecordBatch.from_arrays([pa.array(value), batch.column("toxic")], ["value", "toxic"])

    scored = drawn.mapInArrow(cross, "value double, toxic int").toArrow()
    return Model(weights(), *fit_curve(scored.column("value").to_numpy(), scored.column("toxic").to_numpy()))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, llr, score) of every whole text, one map stage.

    ``llr`` is the difference per symbol; null and empty texts have 0 and the
    score of that value.  Copies and repeated ids are rows of their own; other
    columns are not read."""
    shared = bound_batches(documents).sparkContext.broadcast((tuple(model.weights), model.values, model.shares))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, values, shares = shared.value
        scorer = Scorer(Weights(*weights))
        for batch in source:
            value = scorer.values(texts(batch))
            curve = np.interp(value, values, shares)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value), pa.array(curve)], ["doc_id", "llr", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, llr double, score double")
