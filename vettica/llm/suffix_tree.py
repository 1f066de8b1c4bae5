"""Language-model scoring with a probabilistic suffix tree over the spelling of tokens.

A text is its words in lower case and one end token.  Its contexts are those of
``token_contexts``, whole tokens before a token, in whatever length the divergence test
retains.  Their root is the part here: a token's own probability, stored with the
vocabulary.  It spells the token, its bytes and a closing blank; the end token is a
closing blank alone.  The next byte is predicted from the longest retained context,
which may be any suffix of the token so far, its opening included.

* Counts come from all training texts: one shuffle of distinct words per task
  gives the vocabulary, and everything else is counted from that.
* A context is a candidate if it precedes at least ``LEAST_COUNT`` symbols, whatever
  the corpus, so the tree grows with it.  No tree is collected: contexts that end in
  the same byte hold all their own suffixes, so each such group grows its branch by
  itself, and the log-probabilities of all distinct grams are stored as a table.
  Vocabulary words meet it in chunks that ask for each of their grams once.
* A candidate is retained if its next symbols diverge from its parent's by more
  than the extra parameters cost (n * KL >= half a parameter's log), or if a longer
  retained context ends in it.
* Next-symbol distributions are smoothed by the parent's with ``PRIOR`` symbols.
* A known token's whole spelling is the longest state of all: its discounted count
  is its own share, and what the discount frees is dealt out by the tree.

Texts are packed into chunks that ask the vocabulary and the entries of the token
contexts once for each hash of theirs, by ranges of the hash; a bit table spares most of
what is not there.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettica.llm import token_contexts
from vettica.llm.bytegrams import looked_up, spelled, starts, summed
from vettica.llm.common import bound_batches, give_up, packed, packed_numbers, regrouped, remainder, shuffles_dropped, stored, stored_for, unpacked, unpacked_numbers
from vettica.llm.token_contexts import entries, word_keys

DEPTH = 5
LEAST_COUNT = 5
#: Words above this share of all tokens are known to the tasks that count grams.
HEAVY_SHARE = 1e-5
PRIOR = 4.0
#: Additive smoothing of the unigram base score.
ADDED = 0.1
#: The end token, as a word: no word is empty.
END = ""
#: Distinct words that a task holds before it sends their counts on.
HELD = 600_000
#: Bytes of words whose grams a task sums before it sends their counts on.
SPELLED = 1 << 20
#: About so many vocabulary words ask for their grams together.
CHUNK = 200_000
#: About so many bytes of text ask for their words and contexts together, packed in
#: parts of about so many bytes.
TOGETHER = 32 << 20
PART = 1 << 20
#: About so many bytes of text ask for as many keys as are answered together.
ANSWERED = 32 << 20
#: Bytes of table rows that are dealt out to those ranges together.
LAID = 8 << 20


class Tree(NamedTuple):
    """Byte probabilities at the root, and by context length the retained contexts,
    their totals, and the counts of context and symbol."""

    root: np.ndarray
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    grams: list[np.ndarray]
    counts: list[np.ndarray]

    def log10_of(self, words: list[bytes]) -> np.ndarray:
        codes, number = spelled(words, DEPTH + 1)
        return np.bincount(number, self.log10_of_codes(codes), len(words))

    def log10_of_codes(self, codes: np.ndarray) -> np.ndarray:
        """Of the last byte of each gram of DEPTH + 1 bytes, given those before it."""
        p = self.root[codes & 0xFF]
        live = np.arange(len(codes))
        for k in range(1, DEPTH + 1):
            gram = codes[live] & np.int64((1 << 8 * (k + 1)) - 1)
            total = looked_up(gram >> 8, self.contexts[k], self.totals[k], 0.0)
            live, gram, total = live[total > 0], gram[total > 0], total[total > 0]
            n = looked_up(gram, self.grams[k], self.counts[k], 0.0)
            p[live] = (n + PRIOR * p[live]) / (total + PRIOR)
        return np.log10(p)


def grow(rows: list[tuple[np.ndarray, np.ndarray]], total: float) -> Tree:
    """The tree from the counts of candidate contexts with their next symbols.

    ``rows[k]`` has (gram, count) with contexts of length k, sorted by gram."""
    first = np.zeros(256)
    first[rows[0][0]] = rows[0][1]
    root = (first + 0.5) / (first.sum() + 128)
    contexts, sums, tests, starts = [], [], [], []
    for k, (grams, counts) in enumerate(rows):
        found, at, kinds = np.unique(grams >> 8, return_inverse=True, return_counts=True)
        sums.append(np.bincount(at, counts, len(found)))
        contexts.append(found)
        starts.append(at)
        if k == 0:
            tests.append(np.ones(len(found), bool))
            continue
        mask = np.int64((1 << 8 * k) - 1)
        parent = looked_up(grams & mask, rows[k - 1][0], rows[k - 1][1], 1.0)
        whole = looked_up((grams >> 8) & np.int64((1 << 8 * (k - 1)) - 1), contexts[k - 1], sums[k - 1], 1.0)
        gain = np.bincount(at, counts * np.log(counts / sums[k][at] * whole / parent), len(found))
        tests.append(gain >= 0.5 * kinds * math.log(max(total, 2)))
    for k in range(len(rows) - 1, 1, -1):
        ends = np.unique(contexts[k][tests[k]] & np.int64((1 << 8 * (k - 1)) - 1))
        tests[k - 1] |= np.isin(contexts[k - 1], ends)
    kept = [t[at] for t, at in zip(tests, starts, strict=True)]
    return Tree(
        root,
        [c[t] for c, t in zip(contexts, tests, strict=True)],
        [s[t] for s, t in zip(sums, tests, strict=True)],
        [r[0][m] for r, m in zip(rows, kept, strict=True)],
        [r[1][m] for r, m in zip(rows, kept, strict=True)],
    )


def vocabulary(documents: DataFrame, held_out: int = 10) -> tuple[DataFrame, str]:
    """(word, c): every word of ``documents`` and the end token with its count in
    the training texts, those whose crc32 remainder is not 0; and its folder."""
    schema = pa.schema([("word", pa.string()), ("c", pa.int64())])

    def counts(column: pa.Array, train: bool) -> pa.Table:
        found = pc.value_counts(pc.list_flatten(pc.ascii_split_whitespace(pc.ascii_lower(column))))
        word, c = found.field("values").cast(pa.string()), found.field("counts")
        solid = pc.not_equal(word, END)
        word = pa.concat_arrays([word.filter(solid), pa.array([END][: len(column)], pa.string())])
        c = pa.concat_arrays([c.filter(solid), pa.array([len(column)][: len(column)], pa.int64())])
        return pa.table([word, c if train else pc.multiply(c, 0)], schema=schema)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = schema.empty_table()
        for batch in source:
            column, train = pc.fill_null(batch.column("text"), ""), batch.column("train")
            held = pa.concat_tables([held, counts(column.filter(train), True), counts(column.filter(pc.invert(train)), False)])
            if held.num_rows > HELD:
                held = held.group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])
                if held.num_rows > HELD // 2:
                    yield from held.to_batches()
                    held = schema.empty_table()
        yield from held.group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"]).to_batches()

    counted = documents.select("text", (remainder("doc_id", held_out) != 0).alias("train")).mapInArrow(run, "word string, c long")
    return stored_for(counted.groupBy("word").agg(F.sum("c").alias("c")))


def fit(words: DataFrame) -> DataFrame:
    """(gram, lp): the tree's log10 probability of the last byte of every gram of
    DEPTH + 1 bytes that a word of the vocabulary has, counted or not."""
    schema = pa.schema([("k", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regrouped(source, SPELLED):
            codes, number = spelled([w.encode() for w in batch.column("word").to_pylist()], DEPTH + 1)
            n = batch.column("c").to_numpy()[number]
            for k in range(DEPTH, -1, -1):
                codes, n = summed(codes & np.int64((1 << 8 * (k + 1)) - 1), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), k, np.int32)), pa.array(codes), pa.array(n)], schema=schema)

    grams, folder = stored_for(words.mapInArrow(run, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")))
    first = grams.where("k = 0 and n > 0").select("gram", "n").toArrow()  # one row per byte
    root = summed(first.column("gram").to_numpy(), first.column("n").to_numpy().astype(float))

    def branch(table: pa.Table) -> pa.Table:
        k, gram, n = (table.column(c).to_numpy() for c in ("k", "gram", "n"))
        rows = [root]
        for d in range(1, DEPTH + 1):
            mine = (k == d) & (n > 0)
            found, counts = summed(gram[mine], n[mine].astype(float))
            contexts, totals = summed(found >> 8, counts)
            often = looked_up(found >> 8, contexts, totals, 0.0) >= LEAST_COUNT
            rows.append((found[often], counts[often]))
        whole = gram[k == DEPTH]
        lp = grow(rows, float(root[1].sum())).log10_of_codes(whole)
        return pa.table({"gram": pa.array(whole, pa.int64()), "lp": pa.array(lp, pa.float64())})

    ending = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFF))
    known = stored(grams.where("k > 0").groupBy(ending.alias("ending")).applyInArrow(branch, "gram long, lp double"))
    give_up(words.sparkSession, folder)
    return known


def log10_of_words(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, c, lp, key): the log10 probability of each word, from those of its grams,
    and its hash."""
    chunks = max(1, -(-words.count() // CHUNK))
    dealt = words.withColumn("chunk", F.pmod(F.xxhash64("word"), F.lit(chunks)))

    def asked(table: pa.Table) -> pa.Table:
        each = [pd.unique(spelled([w.encode() for w in x.to_pylist()], DEPTH + 1)[0]) for x in table.column("word").chunks]
        codes = pd.unique(np.concatenate(each))
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"chunk": pa.array(np.full(len(codes), chunk, np.int64)), "gram": pa.array(codes)})

    def answered(table: pa.Table, grams: pa.Table) -> pa.Table:
        gram, lp = summed(grams.column("gram").to_numpy(), grams.column("lp").to_numpy())
        sums = [np.empty(0)]
        for x in table.column("word").chunks:
            codes, number = spelled([w.encode() for w in x.to_pylist()], DEPTH + 1)
            sums.append(np.bincount(number, lp[np.searchsorted(gram, codes)], len(x)))
        key = word_keys(table.column("word").combine_chunks())
        return pa.table({"word": table.column("word"), "c": table.column("c"), "lp": pa.array(np.concatenate(sums)), "key": pa.array(key)})

    met = dealt.groupBy("chunk").applyInArrow(asked, "chunk long, gram long").join(known, "gram")
    return dealt.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(answered, "word string, c long, lp double, key long")


def score(documents: DataFrame, held_out: int = 10, reach: int = token_contexts.REACH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Scores are log10 probabilities of whole texts.  ``reach`` is the most tokens of a
    context; with 0 no context leaves its token.  Null and empty texts are one end
    token; a null doc_id counts as '' in the division and stays null.  Repeated rows
    and ids are rows of their own.  With no training text, every count is 0.  Other
    columns are not read."""
    spark = bound_batches(documents)
    with shuffles_dropped(spark):
        table, total, kinds, tree = _model(documents, held_out, reach)
        marked = None if tree is None else spark.sparkContext.broadcast(token_contexts.marks(tree.select("key")))
        size = documents.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]
    if tree is not None:
        table = table.unionByName(tree, allowMissingColumns=True)
    summed_up = _sums(documents.select("doc_id", "text"), table, marked, size, reach)
    rest = math.log10(total + ADDED * (kinds + 1))
    return summed_up.select(
        "doc_id",
        (remainder("doc_id", held_out) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(rest)).alias("base_score"),
        "score",
    )


def _model(documents: DataFrame, held_out: int, reach: int) -> tuple[DataFrame, int, int, DataFrame | None]:
    """(key, c, lp) of all words, the training tokens, the distinct ones, and (key, lp) of
    the contexts across tokens."""
    spark = documents.sparkSession
    words, folder = vocabulary(documents, held_out)
    c = F.col("c")
    total, kinds, once, twice = words.agg(F.coalesce(F.sum(c), F.lit(0)), F.count_if(c > 0), F.count_if(c == 1), F.count_if(c == 2)).first()
    scored = log10_of_words(words, fit(words))
    if total:
        d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
        whole = F.greatest(c - d, F.lit(0.0)) / total + d * kinds / total * F.pow(F.lit(10.0), "lp")
        scored = scored.withColumn("lp", F.log10(whole))
    table = stored(scored.select("key", "c", "lp"))
    give_up(spark, folder)
    if not (total and reach):
        return table, total, kinds, None
    often = table.where(c >= max(1, HEAVY_SHARE * total)).toArrow()
    frequent = spark.sparkContext.broadcast(token_contexts.frequent_words(often))
    return table, total, kinds, token_contexts.grow(documents, table, frequent, total, held_out, reach)


def _sums(documents: DataFrame, table: DataFrame, marked: Broadcast | None, size: int, reach: int) -> DataFrame:
    """(doc_id, n_tokens, n_known, base, score) from (key, c, lp) of all words and entries;
    ``base`` is without its divisor.  ``size``: the bytes of all texts."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    chunks = 1 + size // TOGETHER
    bits = max(1, (size // ANSWERED).bit_length())

    def dealt(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = int(TaskContext.get().partitionId() * 0.618 * chunks)  # spreads the tasks over the chunks
        for at, batch in enumerate(regrouped(source, PART)):
            yield pa.RecordBatch.from_arrays([pa.array([(first + at) % chunks], pa.int64()), pa.array([packed(batch)], pa.binary())], ["chunk", "part"])

    def by_range(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = (keys >> np.uint64(64 - bits)).astype(np.int32)
        return high[starts(high)], starts(high)

    def sorted_once(each: list[np.ndarray]) -> np.ndarray:
        keys = np.concatenate(each)
        keys.sort()
        return keys[starts(keys)]

    def steps(keys: np.ndarray) -> np.ndarray:
        return np.diff(keys, prepend=np.uint64(0))

    def taken(values: pa.ChunkedArray, name: str, kind: type) -> list[np.ndarray]:
        return [unpacked_numbers(unpacked(x), name, kind) for x in values]

    def asked(texts: pa.Table) -> pa.Table:
        each = []
        for part in texts.column("part"):
            found = entries(unpacked(part).column("text"), marked and marked.value, reach)
            each.append(pd.unique(np.concatenate([key for key, _ in found])))
        keys = sorted_once(each)
        ranges, first = by_range(keys)
        parts = [packed_numbers(step=steps(x)) for x in np.split(keys, first[1:])]
        chunk = np.full(len(ranges), texts.column("chunk")[0].as_py(), np.int64)
        return pa.table({"chunk": chunk, "range": ranges, "keys": pa.array(parts, pa.binary())})

    def laid(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regrouped(source, LAID):
            key = batch.column("key").to_numpy().view(np.uint64)
            order = np.argsort(key)
            c, lp = batch.column("c").fill_null(0).to_numpy()[order], batch.column("lp").to_numpy()[order]
            ranges, first = by_range(key[order])
            cut = zip(*(np.split(x, first[1:]) for x in (key[order], c, lp)), strict=True)
            parts = [packed_numbers(step=steps(k), c=n, lp=x) for k, n, x in cut]
            yield pa.record_batch({"range": ranges, "rows": pa.array(parts, pa.binary())})

    def looked_at(asks: pa.Table, rows: pa.Table) -> pa.Table:
        none = pa.table({"chunk": pa.array([], pa.int64()), "range": pa.array([], pa.int32()), "answers": pa.array([], pa.binary())})
        if not asks.num_rows:
            return none
        key = np.concatenate([np.empty(0, np.uint64), *(np.cumsum(x, dtype=np.uint64) for x in taken(rows.column("rows"), "step", np.uint64))])
        order = np.argsort(key)
        first = order[starts(key[order])]
        key = key[first]
        c = np.append(np.concatenate([np.empty(0, np.int64), *taken(rows.column("rows"), "c", np.int64)])[first], 0)
        lp = np.append(np.concatenate([np.empty(0), *taken(rows.column("rows"), "lp", np.float64)])[first], 0.0)
        parts = []
        for ask in asks.column("keys"):
            wanted = np.cumsum(unpacked_numbers(unpacked(ask), "step", np.uint64), dtype=np.uint64)
            at = np.searchsorted(key, wanted)
            at[np.append(key, np.uint64(0))[at] != wanted] = len(key)  # what the bits let through
            parts.append(packed_numbers(c=c[at], lp=lp[at]))
        return pa.table({"chunk": asks.column("chunk"), "range": asks.column("range"), "answers": pa.array(parts, pa.binary())})

    def answered(texts: pa.Table, answers: pa.Table) -> pa.Table:
        held = []
        for part in texts.column("part"):
            batch = unpacked(part)
            found = entries(batch.column("text"), marked and marked.value, reach)
            at, keys = pd.factorize(np.concatenate([key for key, _ in found]))
            ends = np.cumsum([len(key) for key, _ in found])[:-1]
            each = [np.bincount(rows, minlength=batch.num_rows) for _, rows in found]
            held.append((batch.column("doc_id"), keys, np.split(at.astype(np.int32), ends), each))
        every = sorted_once([keys for _, keys, _, _ in held])  # in the order that they were asked in
        answers = answers.sort_by("range").column("answers")
        lp, counts = np.concatenate(taken(answers, "lp", np.float64)), np.concatenate(taken(answers, "c", np.int64))
        parts, doc_ids = [], [ids for ids, *_ in held]
        for _ in range(len(held)):
            ids, keys, at, each = held.pop(0)
            order = np.argsort(keys)
            mine = np.empty(len(keys), np.int64)
            mine[order] = np.searchsorted(every, keys[order])
            rows = [np.repeat(np.arange(len(ids)), n) for n in each]
            own, first = mine[at[0]], rows[0]
            sums = [np.bincount(first, x, len(ids)) for x in (np.ones(len(own)), counts[own] > 0, np.log10(counts[own] + ADDED))]
            parts.append(np.stack([*sums, sum(np.bincount(r, lp[mine[k]], len(ids)) for k, r in zip(at, rows, strict=True))]))
        n, known, base, logp = np.concatenate(parts, axis=1)
        columns = {"doc_id": pa.chunked_array(doc_ids), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(known.astype(np.int64))}
        return pa.table({**columns, "base": pa.array(base), "score": pa.array(logp)})

    texts = documents.mapInArrow(dealt, "chunk long, part binary")
    asks = texts.groupBy("chunk").applyInArrow(asked, "chunk long, range int, keys binary")
    ranged = table.select("key", "c", "lp").mapInArrow(laid, "range int, rows binary")
    answers = asks.groupBy("range").cogroup(ranged.groupBy("range")).applyInArrow(looked_at, "chunk long, range int, answers binary")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(answered, f"doc_id {kind}, n_tokens long, n_known long, base double, score double")
