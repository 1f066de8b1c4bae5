"""Periodic runs of words, found online by a sparse dynamic program over lags.

A run is a stretch of words in which words q apart are equal, q its smallest such
period, that no neighbouring word extends.  Going through a text once, each word looks
up its earlier occurrences; each of them lies on the diagonal of its lag and lengthens
the match that is active there.  A diagonal that the next word does not lengthen has
ended, and if its stretch is long enough the run is emitted at once.

What keeps it sparse: a run of period q repeats q at least twice more, so the earlier
occurrences that matter for lags from K to 2K agree in the K words from there on, not
in one word only.  The lags are therefore taken in bands that double, each with grams
of its own length (exact ranks, doubled from the band before), and an occurrence whose
stretch lies within a shorter period already found cannot be part of a primitive run
(Fine and Wilf) and is not looked at.  A constant text is linear times the number of
bands, not quadratic.

A text is read by the task that holds its row; nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettica.llm.common import bound_batches, words

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Gram length of the first band, whose lags go from 1 to twice that.
FIRST_GRAM = 8

RUN_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]


def _ranks(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal numbers for equal pairs, and how many there are."""
    pairs = left.astype(np.int64) * (int(right.max(initial=0)) + 1) + right
    distinct, ranks = np.unique(pairs, return_inverse=True)
    return ranks, len(distinct)


def runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of codes, by start and period."""
    count = len(codes)
    grams, length = np.asarray(codes, np.int64), 1
    found: dict[tuple[int, int], int] = {}
    settled = np.arange(count)  # where the longest stretch of a shorter period begins that holds a word
    while count >= max(LEAST_WORDS, LEAST_PERIODS * length):
        grams, distinct = _ranks(grams[: len(grams) - length], grams[length:])
        length *= 2
        if distinct == len(grams):
            break  # no gram occurs twice, so no longer one does
        if length < FIRST_GRAM:
            continue
        band = (1 if length == FIRST_GRAM else length, 2 * length)
        fresh: dict[tuple[int, int], int] = {}
        for start, end, lag in _stretches(codes, grams, length, band, settled):
            if (start, end) not in found:
                fresh[start, end] = min(lag, fresh.get((start, end), lag))
        for start, end in fresh:
            np.minimum(settled[start:end], start, out=settled[start:end])
        found |= fresh
    return sorted((start, end - start, lag) for (start, end), lag in found.items())


def _stretches(codes: np.ndarray, grams: np.ndarray, length: int, band: tuple[int, int], settled: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, lag) of the long maximal stretches whose lag is in the band."""
    least, beyond = band
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    opens = np.r_[True, ordered[1:] != ordered[:-1]]
    first = np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))
    near = np.r_[False, (order[1:] - order[:-1] < beyond) & ~opens[1:]]
    # only places whose gram occurs before, near enough, and not only within a settled stretch
    last = np.minimum(order - least, np.where(settled[order + length - 1] < order, settled[order + length - 1] - 1, order))
    ranks = np.flatnonzero(near & (last > order - beyond) & (last >= order[first]))
    ranks = ranks[np.argsort(order[ranks], kind="stable")]
    places, firsts, lasts, earlier = order[ranks].tolist(), first[ranks].tolist(), last[ranks].tolist(), order.tolist()

    def ended(begun: dict[int, int], next_place: int) -> Iterator[tuple[int, int, int]]:
        for lag in sorted(begun):
            start, end = begun[lag] - lag, next_place + length - 1
            if end - start < max(LEAST_WORDS, LEAST_PERIODS * lag):
                continue
            # a diagonal may have been left out in part, within a settled stretch
            if start and codes[start - 1] == codes[start - 1 + lag] or end < len(codes) and codes[end] == codes[end - lag]:
                continue
            yield start, end, lag

    active: dict[int, int] = {}
    before = -2
    for place, low, limit, rank in zip(places, firsts, lasts, ranks.tolist(), strict=True):
        if place != before + 1 and active:
            yield from ended(active, before + 1)
            active = {}
        matched: dict[int, int] = {}
        at = rank - 1
        if earlier[at] > limit:
            at = bisect_right(earlier, limit, low, rank) - 1
        while at >= low and place - earlier[at] < beyond:
            lag = place - earlier[at]
            matched[lag] = active.pop(lag, place)
            at -= 1
        if active:
            yield from ended(active, place)
        active, before = matched, place
    yield from ended(active, before + 1)


def _coded(split: list[bytes]) -> np.ndarray:
    number = {word: i for i, word in enumerate(dict.fromkeys(split))}
    return np.fromiter(map(number.__getitem__, split), np.int64, len(split))


def find_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): every run of each document's words by start
    and period, and the words without the repetitions, joined by one blank: of each run
    only the first period is kept, unless another run drops it.

    A run has at least ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods.  Null and
    empty texts have no words, no runs and an empty collapsed text.  Rows stay apart,
    repeated ones and those without doc_id too; other columns are not read.  A text of
    any length is read whole, by one task."""
    bound_batches(documents)
    kind = documents.schema["doc_id"].dataType
    run_type = pa.list_(pa.struct(RUN_FIELDS))

    def task(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            counts, found, collapsed = [], [], []
            for text in batch.column("text"):
                split = words(text.as_py())
                listed = runs(_coded(split)) if len(split) >= LEAST_WORDS else []
                counts.append(len(split))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in listed])
                if listed:
                    dropped = np.zeros(len(split), bool)
                    for start, length, period in listed:
                        dropped[start + period : start + length] = True
                    split = [split[i] for i in np.flatnonzero(~dropped)]
                collapsed.append(b" ".join(split))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, run_type), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    schema = f"doc_id {kind.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return documents.select("doc_id", "text").mapInArrow(task, schema)


def longest_by_exponent(column: str = "runs"):
    """The run with the greatest length / period, compared exactly; the first of ties."""
    nothing = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(
        column,
        nothing,
        lambda best, run: F.when(best.isNull() | (run.length * best.period > best.length * run.period), run).otherwise(best),
    )
