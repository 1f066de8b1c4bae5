"""The part of a probabilistic suffix tree whose contexts are whole tokens.

A context is up to ``REACH`` tokens of the text before a token, whatever they are.  The
tree is grown a length at a time, and each length starts from the texts again:

* Counts of context and next token come from all training texts, shuffled by their
  hash.  Candidates are contexts seen ``LEAST_COUNT`` times, whatever the corpus; those
  of several tokens are met by a bit table of the grams that were found so often, which
  may let others through but loses none.
* A next token is named by a context if its count n, less one for itself, pays for its
  parameter against the tree grown so far: n * log(ratio) >= half a parameter's log.
  To be looked up at all it must do so against the root, were the context as rare as
  it can be.  Others are left to the parent, with the mass that they had.
* A context is retained if its next tokens diverge from the parent's by more than its
  parameters cost, in all: n * KL >= half a parameter's log for each named token.

The probability of a token is that of the longest retained suffix of the tokens before
it.  With what each retained suffix multiplies that of the next shorter one by, it is
the root's times one number per retained context and one per named token.  These are
the entries of the table: hashed key and log10.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettica.llm.bytegrams import looked_up, starts
from vettica.llm.common import give_up, packed, remainder, stored, stored_for, unpacked
from vettica.llm.wordhash import mixed, word_hashes

REACH = 2
LEAST_COUNT = 5
PRIOR = 4.0
#: The hash of the end token; no word has it.
END = np.uint64(0)
#: Grams that a task holds before it sends their counts on.
HELD = 2_000_000
#: About so many training tokens have their grams counted together.
COUNTED = 3_000_000
#: Root probability of words that are not among the frequent ones, as far as that decides
#: what is looked up: any n > 1 of them pays for itself.
RARE = 1e-12
#: Bits of the largest bit table: what is more only lets more keys through.
MOST_BITS = 1 << 27
#: Each key sets the bits at these parts of it.
SHIFTS = (0, 32)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Tells the key of a context from that of the same tokens as a gram.
_CONTEXT = 0x2545F4914F6CDD1D


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of a column of texts, ends included, and their rows."""
    hashes, first = word_hashes(pc.ascii_lower(pc.fill_null(column, "")))
    return np.insert(hashes, first[1:], END), np.repeat(np.arange(len(column)), np.diff(first) + 1)


def word_keys(column: pa.Array) -> np.ndarray:
    """The hash of each row's only word; an empty row is the end token."""
    hashes, first = word_hashes(column)
    keys = np.full(len(column), END)
    keys[np.diff(first) > 0] = hashes
    return keys.view(np.int64)


def joined(tokens: np.ndarray) -> np.ndarray:
    """One key for each row of hashes; that of a single one is the hash itself."""
    key = tokens[:, 0]
    for at in range(1, tokens.shape[1]):
        key = mixed(key * _STEP + tokens[:, at])
    return key


def grams(hashes: np.ndarray, rows: np.ndarray, reach: int, contexts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each token with ``reach`` tokens of its text before it: its row, and the hashes;
    of contexts that a table of bits may hold, if one is given."""
    at = np.flatnonzero(rows[reach:] == rows[: len(rows) - reach]) if len(rows) > reach else np.empty(0, np.int64)
    if contexts is not None:
        key = hashes[at]
        for k in range(1, reach):
            key = mixed(key * _STEP + hashes[at + k])
        at = at[may_hold(contexts, key)]
    return rows[at], np.stack([hashes[at + k] for k in range(reach + 1)], axis=1)


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the set that a table of bits was made of."""
    at = np.arange(len(keys))
    for shift in SHIFTS:
        place = keys[at] >> np.uint64(shift) & np.uint64(64 * len(bits) - 1)
        at = at[(bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)) > 0]
    there = np.zeros(len(keys), bool)
    there[at] = True
    return there


def marks(keys: DataFrame) -> np.ndarray:
    """The table of bits of a column ``key``, set by an aggregation."""
    size = min(MOST_BITS, 1 << max(10, (16 * keys.count()).bit_length()))
    places = F.array(*[F.shiftrightunsigned("key", k).bitwiseAND(F.lit(size - 1)) for k in SHIFTS])
    place = keys.select(F.explode(places).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    found = place.groupBy(F.shiftright("place", 6).alias("slot")).agg(F.bit_or(bit).alias("bit")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[found.column("slot").to_numpy()] = found.column("bit").to_numpy()
    return bits.view(np.uint64)


def frequent_words(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, counts and root probabilities of (key, c, lp)."""
    keys = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows.column("c").to_numpy()[order], 10.0 ** rows.column("lp").to_numpy()[order]


def _counts(documents: DataFrame, reach: int, candidates: Broadcast | None, frequent: Broadcast, total: int, held_out: int, last: bool) -> tuple[DataFrame, str]:
    """(gram, ctx, n, asks, pays) of the grams that may be named, or be contexts of the
    next length, and the folder they are stored in: ``asks`` are the keys whose sum is
    the parent's log10."""
    bits = max(1, (total // COUNTED).bit_length())
    names = [f"t{k}" for k in range(reach + 1)]
    price = 0.5 * math.log(max(total, 2))

    def summed(parts: list[np.ndarray], each: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, tokens and counts of distinct grams; the list of parts is emptied."""
        tokens = np.concatenate(parts)
        parts.clear()
        key = joined(tokens)
        order = np.argsort(key)
        key = key[order]
        start = starts(key)
        n = np.diff(np.r_[start, len(key)]) if each is None else np.add.reduceat(np.concatenate(each)[order], start)
        return key[start], tokens[order[start]], n

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, tokens, n = summed(held)
        bucket = (key >> np.uint64(64 - bits)).astype(np.int32)
        first = starts(bucket)
        for b, start, end in zip(bucket[first], first, np.r_[first, len(key)][1:], strict=True):
            order = start + np.argsort(tokens[start:end, 0])  # equal tokens side by side take little room
            columns = [pa.array(tokens[order, k]).dictionary_encode() for k in range(reach + 1)]
            part = packed(pa.RecordBatch.from_arrays([*columns, pa.array(n[order])], [*names, "n"]))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part], pa.binary())], ["bucket", "grams"])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in source:
            held.append(grams(*token_hashes(batch.column("text")), reach, candidates and candidates.value)[1])
            if sum(map(len, held)) > HELD:
                yield from send(held)
        if held:
            yield from send(held)

    def counted(table: pa.Table) -> pa.Table:
        parts, n = [], []
        for part in table.column("grams"):
            columns = unpacked(part)
            parts.append(np.stack([x.dictionary.to_numpy()[x.indices.to_numpy()] for x in map(columns.column, names)], axis=1))
            n.append(columns.column("n").to_numpy())
        key, tokens, n = summed(parts, n)
        often = n > 1
        key, tokens, n = key[often], np.ascontiguousarray(tokens[often]), n[often]
        words, times, shares = frequent.value
        least = np.maximum(n, LEAST_COUNT)
        if reach == 1:
            least = np.maximum(least, looked_up(tokens[:, 0], words, times, 0))
        root = looked_up(tokens[:, -1], words, shares, RARE)
        pays = n * np.log1p((n - 1) / (least + PRIOR) / root) >= price
        kept = pays if last else pays | (n >= LEAST_COUNT)
        key, tokens, n, pays = key[kept], tokens[kept], n[kept], pays[kept]
        asks = [tokens[:, -1]]
        for back in range(1, reach):
            asks += [joined(tokens[:, -1 - back : -1]) ^ np.uint64(_CONTEXT), joined(tokens[:, -1 - back :])]
        flat_asks = np.stack(asks, axis=1).reshape(-1).view(np.int64)
        ends = np.arange(len(key) + 1, dtype=np.int32) * len(asks)
        columns = (key.view(np.int64), joined(tokens[:, :-1]).view(np.int64), n, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat_asks)), pays)
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["gram", "ctx", "n", "asks", "pays"])

    told = documents.where(remainder("doc_id", held_out) != 0).select("text").mapInArrow(run, "bucket int, grams binary")
    return stored_for(told.groupBy("bucket").applyInArrow(counted, "gram long, ctx long, n long, asks array<long>, pays boolean"))


def grow(documents: DataFrame, root: DataFrame, frequent: Broadcast, total: int, held_out: int, reach: int = REACH) -> DataFrame:
    """(key, lp): the entries of all retained contexts of up to ``reach`` tokens.

    ``root`` has (key, c, lp) of every word, ``total`` training tokens."""
    spark = documents.sparkSession
    price = 0.5 * math.log(max(total, 2))
    tree = None
    known = root.select(F.col("key").alias("ctx"), F.col("c").alias("total"))
    candidates = before = None
    for length in range(1, reach + 1):
        found, folder = _counts(documents, length, candidates, frequent, total, held_out, length == reach)
        paying = found.where("pays").join(known, "ctx").where(F.col("total") >= LEAST_COUNT)
        paying = paying.withColumn("key", F.element_at("asks", 1)).join(root.select("key", "lp"), "key")
        if tree is not None:
            asked = found.where("pays").select("gram", F.explode(F.slice("asks", 2, 2 * length)).alias("key"))
            more = asked.join(tree, "key").groupBy("gram").agg(F.sum("lp").alias("more"))
            paying = paying.join(more, "gram", "left").withColumn("lp", F.col("lp") + F.coalesce("more", F.lit(0.0))).drop("more")
        paying = paying.withColumn("q", F.pow(F.lit(10.0), "lp")).drop("asks", "pays", "key", "lp")
        own = (F.col("n") - 1) / (F.col("total") + PRIOR)
        named = paying.withColumn("own", own).where(F.col("n") * F.log1p(F.col("own") / F.col("q")) >= price)
        named, named_folder = stored_for(named)
        if before:
            give_up(spark, before)  # its contexts are in what is named now
        back = (F.max("total") - F.sum(F.col("n") - 1) + PRIOR) / (F.max("total") + PRIOR)
        each = named.join(named.groupBy("ctx").agg(back.alias("back")), "ctx")
        rest = F.max("total") - F.sum("n")
        gain = F.sum(F.col("n") * F.log(F.col("own") / F.col("q") + F.col("back"))) + rest * F.log(F.max("back")) - price * F.count("*")
        kept = each.groupBy("ctx").agg(F.max("back").alias("back"), gain.alias("gain")).where("gain >= 0").select("ctx", "back")
        contexts = kept.select(F.col("ctx").bitwiseXOR(F.lit(_CONTEXT)).alias("key"), F.log10("back").alias("lp"))
        tokens = named.join(kept, "ctx").select(F.col("gram").alias("key"), F.log10(1 + F.col("own") / F.col("q") / F.col("back")).alias("lp"))
        grown = stored(contexts.unionByName(tokens))
        tree = grown if tree is None else tree.unionByName(grown)
        give_up(spark, named_folder)
        before = folder
        if length < reach:
            known = found.where(F.col("n") >= LEAST_COUNT).select(F.col("gram").alias("ctx"), F.col("n").alias("total"))
            candidates = spark.sparkContext.broadcast(marks(known.select(F.col("ctx").alias("key"))))
    give_up(spark, folder)
    return tree


def entries(column: pa.Array, tree: np.ndarray | None, reach: int = REACH) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, rows) of all tokens of a column of texts, then of the entries of contexts
    and of named tokens that they may meet, by length."""
    hashes, at = token_hashes(column)
    found = [(hashes, at)]
    start, key = np.arange(len(hashes)), hashes
    for length in range(1, reach + 1 if tree is not None else 0):
        inside = start[: np.searchsorted(start, len(hashes) - length)]
        inside = at[inside + length] == at[inside]
        start, key = start[: len(inside)][inside], key[: len(inside)][inside]
        context = key ^ np.uint64(_CONTEXT)
        there = np.flatnonzero(may_hold(tree, context))
        found.append((context[there], at[start[there]]))
        key = mixed(key * _STEP + hashes[start + length])
        there = there[may_hold(tree, key[there])]  # a token is named by a retained context only
        found.append((key[there], at[start[there]]))
    return found
