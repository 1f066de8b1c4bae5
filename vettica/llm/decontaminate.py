"""Benchmark passages in documents, found by the q-gram lemma and banded alignment.

Documents and benchmark items are compared in lower case with white space as single
blanks.  An item of m characters occurs if some stretch of the document is within
k = ``ERROR`` * m edits of it (k is lowered for short items, so that the lemma's
bound stays positive; items shorter than one q-gram must occur exactly).

* Lemma: such a stretch shares at least m + 1 - q (k + 1) q-grams with the item, on
  diagonals that differ by at most k + 1.  Diagonals are dealt to overlapping bands
  of 2 (k + 1), so one band holds them all; bands are counted, and those that reach
  the bound are retained.
* Each retained region is verified by alignment inside its band, free at both ends
  of the document's side.

The benchmark is the query set.  It is read in blocks of at most ``BLOCK`` characters,
each broadcast and held against all rows in a map stage; documents are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettica.llm.common import batches, bound_batches, regrouped, texts, worker_memory

Q = 12
ERROR = 0.06
#: Characters of benchmark text in a broadcast block.
BLOCK = 4_000_000
#: Bytes of documents whose q-grams are looked up together.
STRETCH = 750_000
_FILTER_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Separates documents in a stretch; no character has this code.
_BETWEEN = 0x7FFFFFFF


def lowered(text: str) -> str:
    """Lower case, character by character where the whole would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normal(text: str) -> str:
    return " ".join(lowered(text).split())


def places(text: str) -> np.ndarray:
    """For each character of ``normal(text)`` its place in ``text``."""
    out: list[int] = []
    at = 0
    for word in text.split():
        start = text.index(word, at)
        if out:
            out.append(start - 1)
        out.extend(range(start, start + len(word)))
        at = start + len(word)
    return np.array(out, np.int64)


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def qgrams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on."""
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    one = (codes.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    two = one[:-1] * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
    four = two[:-2] * np.uint64(0x94D049BB133111EB) + two[2:]
    eight = four[:-4] * np.uint64(0xD6E8FEB86659FD93) + four[4:]
    whole = eight[:-4] * np.uint64(0xA0761D6478BD642F) + four[8:]
    return (whole ^ (whole >> np.uint64(32))) * _MULTIPLIER


class Index(NamedTuple):
    """A block of items: their q-grams sorted, with item and place of each."""

    ids: list
    texts: list[str]
    lengths: np.ndarray
    edits: np.ndarray
    bounds: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray


def index_of(items: list[tuple], error: float) -> Index:
    """The index of (id, normalised text) pairs."""
    grams, item, place = [], [], []
    for n, (_, text) in enumerate(items):
        found = qgrams(characters(text))
        grams.append(found)
        item.append(np.full(len(found), n))
        place.append(np.arange(len(found)))
    lengths = np.array([len(t) for _, t in items], np.int64)
    edits = np.minimum((error * lengths).astype(np.int64), np.maximum(0, lengths // Q - 1))
    bounds = np.maximum(1, lengths + 1 - Q * (edits + 1))
    gram = np.concatenate(grams or [np.empty(0, np.uint64)])
    order = np.argsort(gram, kind="stable")
    distinct, first = np.unique(gram[order], return_index=True)
    maybe = np.zeros(1 << _FILTER_BITS, bool)
    maybe[_slot(distinct)] = True
    return Index(
        [i for i, _ in items], [t for _, t in items], lengths, edits, bounds, distinct, np.r_[first, len(gram)],
        np.concatenate(item or [np.empty(0, np.int64)])[order], np.concatenate(place or [np.empty(0, np.int64)])[order], maybe,
    )


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def regions(codes: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(item, first diagonal) of the bands of ``codes`` that reach the lemma's bound."""
    grams = qgrams(codes)
    at = np.flatnonzero(index.maybe[_slot(grams)]) if len(grams) else np.empty(0, np.int64)
    none = np.empty(0, np.int64)
    if not len(at) or not len(index.grams):
        return none, none
    found = np.minimum(np.searchsorted(index.grams, grams[at]), len(index.grams) - 1)
    same = index.grams[found] == grams[at]
    at, found = at[same], found[same]
    if not len(at):
        return none, none
    # each hit with all places of its q-gram in items
    times = index.first[found + 1] - index.first[found]
    hit = np.repeat(at, times)
    entry = np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(index.first[found], times)
    item = index.item[entry]
    width = index.edits[item] + 1
    shift = len(codes)  # so that numbers of bands are not negative
    band = (hit - index.place[entry] + shift) // width
    span = np.int64(2 * len(codes) + int(index.lengths.max(initial=0)) + 2)
    keys, counts = np.unique(np.r_[item * span + band, item * span + band - 1], return_counts=True)
    item, band = keys // span, keys % span
    enough = counts >= index.bounds[item]
    item, band = item[enough], band[enough]
    return item, band * (index.edits[item] + 1) - shift


def aligned(item: np.ndarray, text: np.ndarray, first: int, width: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best alignment of the whole item with a stretch of
    ``text`` on the diagonals ``first`` to ``first + width``; leftmost of the best."""
    far = len(item) + 1
    diagonal = first + np.arange(width + 1)
    inside = (diagonal >= 0) & (diagonal <= len(text))
    cost = np.where(inside, 0, far)
    start = diagonal.copy()
    steps = np.arange(width + 1)
    padded = np.concatenate([text, np.array([_BETWEEN], text.dtype)])
    for row, symbol in enumerate(item):
        place = diagonal + row  # of the character matched on each diagonal
        usable = (place >= 0) & (place < len(text))
        new = np.where(usable, cost + (padded[np.where(usable, place, len(text))] != symbol), far)
        came = start.copy()
        # the item's symbol left out: from the diagonal to the right, one row above
        skipped = np.append(cost[1:] + 1, far)
        better = skipped < new
        new[better], came[better] = skipped[better], np.append(start[1:], 0)[better]
        new[(place + 1 < 0) | (place + 1 > len(text))] = far
        # symbols of the text put in: from the left in this row
        best = np.minimum.accumulate(new - steps)
        source = np.maximum.accumulate(np.where(new - steps == best, steps, 0))
        cost, start = np.minimum(best + steps, far), came[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), int(diagonal[end] + len(item))


def matches(text: str, index: Index, found: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(item number, start, end, edits) of verified regions of a normalised text;
    of overlapping ones of an item the best, then the leftmost, stays."""
    codes = characters(text)
    each: dict[int, list[tuple[int, int, int]]] = {}
    for item, first in found:
        wanted, k = index.texts[item], int(index.edits[item])
        low, high = max(0, first), first + 2 * (k + 1) + len(wanted) + k
        exact = text.find(wanted, low, max(low, high))
        if exact >= 0:
            each.setdefault(item, []).append((0, exact, exact + len(wanted)))
            continue
        edits, start, end = aligned(characters(wanted), codes, first, 2 * (k + 1))
        if edits <= k:
            each.setdefault(item, []).append((edits, start, end))
    out = []
    for item, spans in each.items():
        taken: list[tuple[int, int]] = []
        for edits, start, end in sorted(set(spans)):
            if all(end <= a or start >= b for a, b in taken):
                taken.append((start, end))
                out.append((item, start, end, edits))
    return sorted(out)


def search(rows: list[str], index: Index) -> list[list[tuple[int, int, int, int]]]:
    """Per text, its matches with places in the text itself."""
    plain = [normal(t) for t in rows]
    joint = np.array([_BETWEEN], np.uint32)
    parts, starts, at = [], [], 0
    for text in plain:
        codes = characters(text)
        starts.append(at)
        parts += [codes, joint]
        at += len(codes) + 1
    codes = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    item, first = regions(codes, index)
    begin = np.array(starts, np.int64)
    # a band belongs to the text that holds the middle of its stretch
    middle = np.clip(first + index.edits[item] + 1 + index.lengths[item] // 2, 0, max(len(codes) - 1, 0)) if len(item) else item
    owner = np.searchsorted(begin, middle, "right") - 1
    by_text: dict[int, list[tuple[int, int]]] = {}
    for doc, number, diagonal in zip(owner.tolist(), item.tolist(), first.tolist(), strict=True):
        by_text.setdefault(doc, []).append((number, diagonal - starts[doc]))
    short = [n for n, t in enumerate(index.texts) if len(t) < Q]
    out: list[list[tuple[int, int, int, int]]] = []
    for doc, text in enumerate(plain):
        found = matches(text, index, by_text[doc]) if doc in by_text else []
        for n in short:
            found += [(n, m.start(), m.end(), 0) for m in re.finditer(re.escape(index.texts[n]), text)]
        if found:
            origin = places(rows[doc])
            found = [(n, int(origin[a]), int(origin[b - 1]) + 1, e) for n, a, b, e in found]
        out.append(found)
    return out


def blocks_of(benchmark: DataFrame, error: float) -> Iterator[Index]:
    """Indexes of the benchmark in blocks of at most ``BLOCK`` characters."""
    held: list[tuple] = []
    size = 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = normal(row.text or "")
        if held and size + len(text) > BLOCK:
            yield index_of(held, error)
            held, size = [], 0
        if text:
            held.append((row.item_id, text))
            size += len(text)
    if held:
        yield index_of(held, error)


def find_leaks(documents: DataFrame, benchmark: DataFrame, error: float = ERROR) -> DataFrame:
    """(doc_id, item_id, start, end, edits): each stretch of a document, in code
    points of its text, that is a benchmark item within the edit budget.

    Null and empty texts and items never match.  Repeated rows and ids are searched
    each on their own.  Other columns are not read.  No item, no row."""
    spark = bound_batches(documents)
    doc_kind, item_kind = documents.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = pa.schema([("doc", pa.string()), ("item", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
    result = spark.createDataFrame([], "doc string, item string, start long, end long, edits int")
    for index in blocks_of(benchmark, error):
        shared = spark.sparkContext.broadcast(tuple(index))

        def run(source: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Index(*shared.value)

            def out() -> Iterator[tuple]:
                for batch in regrouped(source, STRETCH):
                    for doc, found in zip(batch.column("doc").to_pylist(), search(texts(batch), known), strict=True):
                        for n, start, end, edits in found:
                            item = known.ids[n]
                            yield doc, None if item is None else str(item), start, end, edits

            yield from batches(out(), schema)

        rows = documents.select(F.col("doc_id").cast("string").alias("doc"), "text")
        result = result.unionAll(rows.mapInArrow(run, "doc string, item string, start long, end long, edits int"))
    return result.select(F.col("doc").cast(doc_kind).alias("doc_id"), F.col("item").cast(item_kind).alias("item_id"), "start", "end", "edits")


def drop_leaks(documents: DataFrame, benchmark: DataFrame, error: float = ERROR) -> DataFrame:
    """The rows without any benchmark item, with all their columns: a map stage per
    block, no join, so repeated ids need no care."""
    spark = bound_batches(documents)
    for index in blocks_of(benchmark, error):
        shared = spark.sparkContext.broadcast(tuple(index))

        def run(source: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Index(*shared.value)
            worker_memory("benchmark", dict)  # lets go of the vocabularies of stages before
            for batch in regrouped(source, STRETCH):
                yield batch.filter(pa.array([not found for found in search(texts(batch), known)], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
