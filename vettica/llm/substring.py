"""Substring deduplication by seed and extend.

A text's grams of ``SEED`` words are winnowed: of every stretch of ``LEAST`` words the
gram with the smallest hash is an anchor, so two texts that share such a stretch share
an anchor at the same place in it.  Anchors of one document only are dropped.  Of each
other anchor the earliest document is the owner; every other occurrence is laid against
the owner's and extended word by word to both sides, as far as a stretch over the
threshold can reach from the anchor.  What agrees over at least ``LEAST`` words is a
repeat; overlapping ones are one maximal repeat.

An occurrence whose words leave the owner's before that is not compared with all
others, which would be a row per pair of occurrences.  Its open stretches are regrouped
by more of their words: a third of the places the anchor can have in a stretch, with the
words that all stretches of that third have in common, then one place.  Occurrences that
share a stretch stay in one group, with a new owner, until its earliest document owns it.
That takes a few rounds, whatever the data; rows are as many as occurrences (at most
``LEAST - SEED + 1`` for each, in the last round), never pairs.  A member carries only the
words that its open stretches do not have in common, and in the last round none.

Of exact copies of a text all but the earliest document are set aside first.  Hot anchors are
aggregated on the map side to find the owner; the join with it has one row per anchor on
one side, which Spark's adaptive skew join splits.  Every round is a stored table, and a
table is deleted as soon as what was made of it is stored, so that disk holds one round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettica.llm.common import bound_batches, give_up, stored, stored_for, words
from vettica.llm.wordhash import mixed, word_hashes

#: Words of a repeat at least, and of a seed.
LEAST, SEED = 13, 5
#: Bytes of texts whose arrays are built together.
TOGETHER = 1 << 20

MEMBER = "key long, doc_id long, copy binary, pos int, low int, high int, context binary"
EXTENDED = f"{MEMBER}, begin int, end int, first_id long, first_begin int"
EXTENDED_KINDS = {
    "key": pa.int64(),
    "doc_id": pa.int64(),
    "copy": pa.binary(),
    "pos": pa.int32(),
    "low": pa.int32(),
    "high": pa.int32(),
    "context": pa.binary(),
    "begin": pa.int32(),
    "end": pa.int32(),
    "first_id": pa.int64(),
    "first_begin": pa.int32(),
}


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    count = max(0, len(codes) - size + 1)
    total = np.zeros(count, np.uint64)
    for at in range(size):
        total = total * np.uint64(0x100000001B3) + codes[at : at + count]
    return mixed(total)


def anchors(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST, seed: int = SEED) -> np.ndarray:
    """Places of the anchors: of each window of ``least`` words within a text the seed
    with the smallest hash, the first of equal ones."""
    grams, width = _grams(codes, seed), least - seed + 1
    if len(grams) < width:
        return np.zeros(0, np.int64)
    count = len(grams) - width + 1
    smallest, size = grams, 1
    while 2 * size <= width:
        smallest, size = np.minimum(smallest[:-size], smallest[size:]), 2 * size
    smallest = np.minimum(smallest[:count], smallest[width - size :][:count])
    chosen = np.empty(count, np.int64)
    for step in reversed(range(width)):
        np.copyto(chosen, np.arange(step, step + count), where=grams[step : step + count] == smallest)
    ends = np.repeat(bounds[1:], np.diff(bounds))[: len(chosen)]
    return np.unique(chosen[np.arange(len(chosen)) + least <= ends])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, int(batch.num_rows * TOGETHER / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _occurrences(texts: DataFrame, later: DataFrame) -> DataFrame:
    """(key, doc_id, pos) of every anchor of texts that are no later copies; the key is
    the hash of its words.  A text meets the copies with its anchors, not its words."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in _slices(batch):
                codes, bounds = word_hashes(part.column("text"))
                places = anchors(codes, bounds)
                begin = np.searchsorted(places, bounds)  # of each text's anchors
                row = np.repeat(np.arange(part.num_rows), np.diff(begin))
                offsets = pa.array(begin.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("copy"),
                        part.column("doc_id"),
                        pa.ListArray.from_arrays(offsets, pa.array(_grams(codes, SEED)[places].view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array((places - bounds[row]).astype(np.int32))),
                    ],
                    names=["copy", "doc_id", "keys", "places"],
                )

    listed = texts.select("copy", "doc_id", "text").mapInArrow(run, "copy binary, doc_id long, keys array<long>, places array<int>")
    first = listed.join(later, ["copy", "doc_id"], "left_anti")
    return first.select("doc_id", F.inline(F.arrays_zip("keys", "places")).alias("key", "pos")).select("key", "doc_id", "pos")


def _contexts(located: DataFrame) -> DataFrame:
    """Members: the shared anchors with the words around them, nearest first, as hashes.

    ``low`` to ``high`` are the open stretches, by the words they have before the seed."""
    around = LEAST - SEED

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in _slices(batch):
                codes, bounds = word_hashes(part.column("text"))
                lists = part.column("places")
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                place = lists.flatten().to_numpy()
                owner, pos = (place & 1).astype(bool), place >> 1
                sizes = np.diff(bounds)[row]
                fits = pos + SEED <= sizes  # another text of the same doc_id may be shorter
                row, owner, pos, sizes = row[fits], owner[fits], pos[fits], sizes[fits]
                left, right = np.minimum(pos, around), np.minimum(sizes - pos - SEED, around)
                steps = np.r_[-np.arange(1, around + 1), np.arange(SEED, LEAST)]
                local = pos[:, None] + steps
                inside = (local >= 0) & (local < sizes[:, None])
                at = np.where(inside, local + bounds[row][:, None], 0)
                context = np.where(inside, codes[at], np.uint64(0)) if len(row) else np.zeros((0, 2 * around), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_grams(codes, SEED)[bounds[row] + pos].view(np.int64)),
                        part.column("doc_id").take(pa.array(row)),
                        part.column("copy").take(pa.array(row)),
                        pa.array(pos.astype(np.int32)),
                        pa.array((around - right).astype(np.int32)),
                        pa.array(left.astype(np.int32)),
                        _binary(context),
                        pa.array(owner),
                    ],
                    names=["key", "doc_id", "copy", "pos", "low", "high", "context", "owner"],
                )

    return located.select("doc_id", "copy", "text", "places").mapInArrow(run, f"{MEMBER}, owner boolean")


def _binary(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array) -> np.ndarray:
    width = 2 * (LEAST - SEED)
    return np.frombuffer(column.buffers()[2], np.uint64)[: (column.offset + len(column)) * width].reshape(-1, width)[column.offset :]


def _agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.cumprod(left == right, axis=1, dtype=np.int32).sum(axis=1)


def _extended(members: DataFrame, block: int) -> DataFrame:
    """Each member against the owner of its key: repeats found (``begin`` to ``end``) and,
    by blocks of so many places, what is left open (``key``)."""
    around = LEAST - SEED
    owners = (
        members.where("owner")
        .groupBy("key")
        .agg(F.min(F.struct("doc_id", "pos", "context")).alias("first"))
        .select("key", F.col("first.doc_id").alias("first_id"), F.col("first.pos").alias("first_pos"), F.col("first.context").alias("first_context"))
    )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            number = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "doc_id", "pos", "low", "high", "first_id", "first_pos")}
            low, high, pos = number["low"], number["high"], number["pos"]
            own, first = _matrix(batch.column("context")), _matrix(batch.column("first_context"))
            left = _agreeing(own[:, :around], first[:, :around])
            right = _agreeing(own[:, around:], first[:, around:])
            # a stretch with j words before the seed agrees where since <= j <= to
            to, since = np.minimum(high, left), np.maximum(low, around - right)
            agrees = since <= to
            repeat = np.flatnonzero(agrees & (number["doc_id"] > number["first_id"]))
            yield _rows(
                batch,
                repeat,
                begin=(pos - to)[repeat],
                end=(pos - since + LEAST)[repeat],
                first_id=number["first_id"][repeat],
                first_begin=(number["first_pos"] - to)[repeat],
            )
            for begin in range(0, around + 1, block):
                end = min(begin + block - 1, around)
                lows, highs = np.maximum(low, begin), np.minimum(high, end)
                still = np.flatnonzero((lows <= highs) & ~(agrees & (since <= lows) & (highs <= to)))
                key, common = number["key"].view(np.uint64)[still] + np.uint64(begin + 1), own[still]
                for at in (*range(begin), *range(around, 2 * around - end)):  # words of all stretches of the block
                    key = mixed(key * np.uint64(0x100000001B3) + common[:, at])
                yield _rows(batch, still, key=mixed(key).view(np.int64), low=lows[still], high=highs[still], context=_binary(_open_words(common, begin, end)))

    return members.drop("owner").join(owners, "key").mapInArrow(run, EXTENDED)


def _open_words(context: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The words that tell apart the stretches with ``begin`` to ``end`` words before the
    seed, others 0; for one place a second hash of its words, to be compared with the key."""
    around = LEAST - SEED
    if begin == end:
        check = np.zeros((len(context), 1), np.uint64)
        for at in (*range(begin), *range(around, 2 * around - end)):
            check[:, 0] = mixed(check[:, 0] * np.uint64(0x9E3779B97F4A7C15) + context[:, at])
        return check
    kept = np.zeros_like(context)
    for at in (slice(begin, end), slice(2 * around - end, 2 * around - begin)):
        kept[:, at] = context[:, at]
    return kept


def _settled(members: DataFrame) -> DataFrame:
    """Repeats among members with one open stretch each, which the key stands for."""
    first = members.groupBy("key", "context").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max("doc_id").alias("most")).where("first.doc_id < most")
    begin = F.col("pos") - F.col("low")
    return (
        members.join(first, ["key", "context"])
        .where("doc_id > first.doc_id")
        .select("doc_id", "copy", begin.alias("begin"), (begin + LEAST).alias("end"), F.col("first.doc_id").alias("first_id"), (F.col("first.pos") - F.col("low")).alias("first_begin"))
    )


def _rows(batch: pa.RecordBatch, at: np.ndarray, **given: np.ndarray | pa.Array) -> pa.RecordBatch:
    """The batch's rows ``at`` as repeats or, given a key, as members of the next round."""
    kept = ("doc_id", "copy", "pos") if "key" in given else ("doc_id", "copy")
    index = pa.array(at)
    columns = []
    for name, kind in EXTENDED_KINDS.items():
        if name in given:
            columns.append(given[name] if isinstance(given[name], pa.Array) else pa.array(given[name], kind))
        else:
            columns.append(batch.column(name).take(index).cast(kind) if name in kept else pa.nulls(len(at), kind))
    return pa.RecordBatch.from_arrays(columns, names=list(EXTENDED_KINDS))


def _owned(members: DataFrame) -> DataFrame:
    """Members of keys that several documents have, with a mark on those of the earliest."""
    shared = members.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    return members.join(shared, "key").withColumn("owner", F.col("doc_id") == F.col("least")).drop("least")


def _identified(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("copy"))


def _later_copies(texts: DataFrame) -> DataFrame:
    """(copy, doc_id) of documents whose text an earlier one has, as a stored table."""
    pairs = texts.where("doc_id is not null").select("copy", "doc_id").distinct()
    firsts = pairs.groupBy("copy").agg(F.min("doc_id").alias("first_id"))
    return stored(pairs.join(firsts, "copy").where("doc_id > first_id").select("copy", "doc_id"))


def find_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, copy, begin, end, first_id, first_begin): stretches of at least ``LEAST``
    words, ``begin`` to before ``end``, that also stand in the document ``first_id``, which
    is earlier, from its word ``first_begin``.

    ``copy`` is the MD5 of the text.  Of equal texts only the earliest document has rows.
    Together the rows of a document cover every stretch of ``LEAST`` words that begins in
    an earlier document too; overlapping rows make up a maximal repeat.  Rows without
    doc_id have no place in the order: they neither repeat nor are repeated."""
    bound_batches(documents)
    rows = _identified(documents)
    return _repeats(rows, _later_copies(rows))[0]


def _repeats(rows: DataFrame, later: DataFrame) -> tuple[DataFrame, list[str]]:
    """The repeats, and the folders of the tables they are read from."""
    # LEAST words and the blanks between them take so many characters
    texts = rows.where((F.length("text") >= 2 * LEAST - 1) & F.col("doc_id").isNotNull())
    spark = rows.sparkSession
    occurrences, seeds = stored_for(_occurrences(texts, later))
    place = (F.col("pos") * 2 + F.col("owner").cast("int")).alias("place")
    places, found = stored_for(_owned(occurrences).groupBy("doc_id").agg(F.collect_set(place).alias("places")))
    give_up(spark, seeds)
    members, held = stored_for(_contexts(texts.join(places, "doc_id")))  # later copies have no places
    give_up(spark, found)
    blocks = [-(-(LEAST - SEED + 1) // 3)]
    while blocks[-1] > 1:
        blocks.append(-(-blocks[-1] // 3))
    rounds, folders = [], []
    for block in blocks:
        extended, folder = stored_for(_extended(members, block))
        folders.append(folder)
        give_up(spark, held)
        rounds.append(extended.where("begin is not null").select("doc_id", "copy", "begin", "end", "first_id", "first_begin"))
        left = extended.where("key is not null").select("key", "doc_id", "copy", "pos", "low", "high", "context")
        if block > 1:
            members, held = stored_for(_owned(left))
    return reduce(DataFrame.unionAll, [*rounds, _settled(left)]), folders


def remove_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept): every document with its words that no
    earlier document has in a stretch of at least ``LEAST`` words, joined by one blank;
    ``removed`` lists the maximal stretches (``begin`` to before ``end``) taken out.

    A document that copies an earlier one loses everything, if it is long enough.  Null
    and empty texts have no words.  Repeated rows have equal results: a document does not
    repeat itself, nor another row of its doc_id.  Rows without doc_id keep all words.
    Ids are read as whole numbers; other columns are not read."""
    bound_batches(documents)
    rows = _identified(documents)
    later = _later_copies(rows)
    span = F.struct("begin", "end").alias("span")
    repeats, folders = _repeats(rows, later)
    found = stored(
        repeats.select("copy", "doc_id", span, F.lit(False).alias("whole"))
        .unionByName(later.withColumn("whole", F.lit(True)), allowMissingColumns=True)
        .groupBy("copy", "doc_id")
        .agg(F.collect_set("span").alias("spans"), F.max("whole").alias("whole"))
    )
    for folder in folders:
        give_up(rows.sparkSession, folder)
    joined = rows.join(found, ["copy", "doc_id"], "left")
    span_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            counts, removed, kept, dropped = [], [], [], []
            for doc, text, whole, spans in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "whole", "spans")), strict=True):
                split = words(text)
                taken = _merged([(0, len(split))] if whole and len(split) >= LEAST else [] if whole or doc is None else [(s["begin"], s["end"]) for s in spans or []])
                rest, at = [], 0
                for begin, end in taken:
                    rest += split[at:begin]
                    at = end
                rest += split[at:]
                counts.append(len(split))
                dropped.append(len(split) - len(rest))
                removed.append([{"begin": b, "end": e} for b, e in taken])
                kept.append(b" ".join(rest))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(removed, span_type), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "removed", "kept"],
            )

    whole = F.coalesce("whole", F.lit(False)).alias("whole")
    schema = "doc_id long, n_words long, n_removed long, removed array<struct<begin:int,end:int>>, kept string"
    return joined.select("doc_id", "text", whole, "spans").mapInArrow(run, schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if merged and begin <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((begin, end))
    return merged
