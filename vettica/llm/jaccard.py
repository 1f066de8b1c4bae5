"""N-gram Jaccard join by grouped prefix filtering, and its connected groups.

A document's set is its distinct 4-word shingles (64-bit hashes).  Two documents
link when 100 * |A and B| >= 85 * |A or B|.

1. Documents with the same set are one class.
2. Shingles are ordered by how often they occur, rare ones first.  Counts come from
   all documents, folded into a table of 2^``SKETCH_BITS`` sums, which is the same
   size for any corpus; any order gives right results, rare first gives few pairs.
3. A class's prefix is its first |A| - ceil(0.85 |A|) + 1 shingles.  Classes with
   the same size and prefix collapse into one group.  Only groups travel to the
   shingles of their prefix, and only shingles met by two groups go on.
4. Groups that meet are expanded to their classes.  Of all classes at a shingle a
   few stand as hubs; each other class is held against some of them, in two rounds.
   Verified pairs make a first set of components.
5. All remaining pairs that meet at a shingle *and are not yet connected* are
   verified.  Pairs inside a component would change nothing, so every link between
   different texts is either verified or already spanned, while a group of
   thousands of near copies costs a number of pairs in proportion to its size.

Before verification, pairs pass the size filter and a parity bitmap (the set's hashes toggle 1024 bits; unequal bits are at most the symmetric
difference), neither of which loses a link.  Verification intersects whole sets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettica.llm.common import bound_batches, lower_words, stored, texts, worker_memory
from vettica.llm.components import components

SHINGLE = 4
#: Links need PART / WHOLE of the union.
PART, WHOLE = 85, 100
SKETCH_BITS = 20
#: Sums of the sketch that travel as one row.
SKETCH_ROW = 1 << 14
BITMAP_WORDS = 16
HUBS = 3
#: Slots of the filter that finds the texts whose sets are wanted.
FILTER_BITS = 22
#: Words whose hash a worker remembers.
REMEMBERED = 300_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _word_hashes(found: list[bytes]) -> np.ndarray:
    import xxhash

    known: dict[bytes, bytes] = worker_memory("word hashes", dict)
    try:
        return np.frombuffer(b"".join([known[w] for w in found]), np.uint64)
    except KeyError:
        if len(known) > REMEMBERED:
            known.clear()
        known.update((w, xxhash.xxh3_64_digest(w)) for w in found if w not in known)
        return np.frombuffer(b"".join([known[w] for w in found]), np.uint64)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the 4-word shingles of a whole text; of fewer words
    the whole sequence is one; no words, none."""
    found = lower_words(text)
    if not found:
        return np.empty(0, np.int64)
    if len(found) < SHINGLE:
        whole = hashlib.blake2b(b" ".join(found), digest_size=8).digest()
        return np.frombuffer(whole, np.int64)
    a = _word_hashes(found)
    h = a[:-3] * _ODD[0]
    for k in (1, 2, 3):
        h = (h ^ (h >> np.uint64(29 + k))) + a[k : len(a) - 3 + k]
        h = h * _ODD[k]
    return np.unique((h ^ (h >> np.uint64(32))).view(np.int64))


def signature(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def needed(a: Column, b: Column) -> Column:
    """The least intersection of linked sets of these sizes."""
    return F.ceil(PART * (a + b) / (PART + WHOLE))


# --- passes over the texts -------------------------------------------------

_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("block", pa.int32()), ("sums", pa.binary())])


def _profile(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and at the end the task's sketch as rows of sums."""
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    mask = np.int64((1 << SKETCH_BITS) - 1)
    for batch in source:
        sets = [shingles(t) for t in texts(batch)]
        if sets:
            sketch += np.bincount(np.concatenate(sets) & mask, minlength=len(sketch)).astype(np.uint32)
        rows = len(sets)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                pa.nulls(rows, pa.int32()),
                pa.nulls(rows, pa.binary()),
            ],
            schema=_PROFILE,
        )
    if sketch.any():
        small = np.uint16 if sketch.max() < 1 << 16 else np.uint32
        parts = sketch.astype(small).reshape(-1, SKETCH_ROW)
        n = len(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())],
            schema=_PROFILE,
        )


def _add_sketches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in source:
        for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            small = np.uint16 if len(sums) == 2 * SKETCH_ROW else np.uint32
            held.setdefault(block, np.zeros(SKETCH_ROW, np.uint64))[:] += np.frombuffer(sums, small)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int32()), pa.array([np.minimum(v, 0xFFFFFFFF).astype(np.uint32).tobytes() for v in held.values()], pa.binary())], ["block", "sums"]
    )


def sketch_of(profile: DataFrame) -> np.ndarray:
    """The summed sketch, of fixed size, on the driver."""
    rows = profile.where("block is not null").select("block", "sums").repartition("block").mapInArrow(_add_sketches, "block int, sums binary")
    sketch = np.zeros((1 << SKETCH_BITS) // SKETCH_ROW * SKETCH_ROW, np.uint32).reshape(-1, SKETCH_ROW)
    for row in rows.collect():
        sketch[row.block] = np.frombuffer(row.sums, np.uint32)
    return sketch.reshape(-1)


def with_prefixes(documents: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(doc_id, n, sig, group_sig, prefix, bits) of documents that have a set."""
    # sums on a logarithmic scale of 16 bits: any one scale gives one order for all
    shared = documents.sparkSession.sparkContext.broadcast((np.log2(sketch + 1.0) * 2000).astype(np.uint16))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, mask = shared.value, np.int64((1 << SKETCH_BITS) - 1)
        for batch in source:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                s = shingles(text)
                n = len(s)
                if doc is None or not n:
                    continue
                length = n - -(-PART * n // WHOLE) + 1
                prefix = s[np.argsort(often[s & mask], kind="stable")[:length]]
                bits = np.packbits((np.bincount(s & np.int64(64 * BITMAP_WORDS - 1), minlength=64 * BITMAP_WORDS) & 1).astype(np.uint8)).view(np.int64)
                out.append((doc, n, signature(s), signature(np.r_[n, prefix]), prefix, bits))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n", "sig", "group_sig", "prefix", "bits"])

    return documents.mapInArrow(run, "doc_id long, n int, sig binary, group_sig binary, prefix array<long>, bits array<long>")


def _met_twice(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, those whose token has more than one row."""
    held: pa.RecordBatch | None = None  # the last row, not yet told apart
    alone = True
    for batch in source:
        if not batch.num_rows:
            continue
        joined = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if held is not None else batch
        token = joined.column("token").to_numpy()
        same = token[1:] == token[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        keep[0] |= not alone
        last = len(token) - 1
        alone = not keep[last]
        # the last row waits: the next batch may begin with its token
        yield joined.slice(0, last).filter(pa.array(keep[:last]))
        held = joined.slice(last)
    if held is not None and not alone:
        yield held


def texts_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, packed): the compressed texts of at least the documents with these ids.
    A filter of fixed size, built from the ids, keeps most other texts from moving;
    the join with the pairs drops the rest."""
    slots = 1 << FILTER_BITS
    slot = F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int").alias("slot")
    wanted = np.zeros(slots, bool)
    found = ids.select(slot).distinct().toArrow().column("slot").to_numpy()
    wanted[found] = True
    shared = documents.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in source:
            batch = batch.filter(pa.array(bits[batch.column("slot").to_numpy()]))
            packed = [zlib.compress(t.encode("utf-8", "replace"), 1) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], ["id", "packed"])

    rows = documents.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    return rows.select("id", "text", slot).mapInArrow(run, "id long, packed binary")


def _whole_sets_link(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts, those whose whole shingle sets link."""
    held: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.int64))
    for batch in source:
        keep = []
        for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True):
            if y != held[0]:
                held = y, shingles(zlib.decompress(y).decode())
            one, other = shingles(zlib.decompress(x).decode()), held[1]
            both = len(np.intersect1d(one, other, assume_unique=True))
            keep.append(WHOLE * both >= PART * (len(one) + len(other) - both))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


# --- pairs -----------------------------------------------------------------


def _sizes_fit() -> Column:
    return WHOLE * F.least("a.n", "b.n") >= PART * F.greatest("a.n", "b.n")


def _bits_fit() -> Column:
    """Whether the unequal bits of sides a and b allow the intersection needed."""
    unequal = F.aggregate(F.zip_with("a.bits", "b.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return unequal <= F.col("a.n") + F.col("b.n") - 2 * needed(F.col("a.n"), F.col("b.n"))


def verified(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of class representatives whose whole sets link."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    packed = stored(texts_of(documents, ids))
    left = packed.select(F.col("id").alias("a"), F.col("packed").alias("pa"))
    right = packed.select(F.col("id").alias("b"), F.col("packed").alias("pb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(_whole_sets_link, "a long, b long")


def met_classes(classes: DataFrame) -> DataFrame:
    """(token, id): classes at the prefix shingles where another group or class is
    too.  ``classes`` has (id, n, group_sig, prefix, ...)."""
    groups = classes.groupBy("group_sig").agg(F.min("id").alias("group"), F.count("*").alias("members"))
    several = stored(classes.select("id", "group_sig").join(groups.where("members > 1"), "group_sig").select("id", "group"))
    # a group travels as its first class; the others are few and join it again after
    first = classes.join(several.where("id != group").select("id"), "id", "left_anti")
    at = first.select(F.col("id").alias("group"), F.explode("prefix").alias("token"))
    met = at.repartition("token").sortWithinPartitions("token").mapInArrow(_met_twice, "group long, token long")
    # classes of one group have all of their prefix in common; its first shingle tells
    inside = first.join(several.where("id = group").select("id"), "id", "left_semi").select(F.col("id").alias("group"), F.get("prefix", F.lit(0)).alias("token"))
    rows = stored(met.unionAll(inside).distinct())
    others = rows.join(several.where("id != group"), "group").select("token", "id")
    return rows.select("token", F.col("group").alias("id")).unionAll(others)


def _with_hubs(met: DataFrame, hubs: DataFrame) -> DataFrame:
    """(a, b): each class of ``met`` against a hub of each of its shingles, at most
    one for each column of ``hubs`` in the end."""
    each = met.join(hubs, "token")
    one = [F.min(F.struct(F.xxhash64(f"hub{k}"), f"hub{k}")).alias(f"h{k}") for k in range(HUBS)]
    drawn = each.groupBy("id").agg(*one).select("id", F.explode(F.array(*(F.col(f"h{k}.hub{k}") for k in range(HUBS)))).alias("hub"))
    return drawn.where("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that pass the size and bitmap filters."""
    sides = classes.select("id", "n", "bits")
    a = pairs.join(sides.select(F.col("id").alias("a"), F.struct("n", "bits").alias("x")), "a")
    both = a.join(sides.select(F.col("id").alias("b"), F.struct("n", "bits").alias("y")), "b")
    named = both.select("a", "b", F.col("x").alias("a_"), F.col("y").alias("b_"))
    unequal = F.aggregate(F.zip_with("a_.bits", "b_.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    size, other = F.col("a_.n"), F.col("b_.n")
    fits = (WHOLE * F.least(size, other) >= PART * F.greatest(size, other)) & (unequal <= size + other - 2 * needed(size, other))
    return named.where(fits).select("a", "b")


def _hubs(met: DataFrame, salt: int) -> DataFrame:
    """(token, hub0, hub1, ...): the class of each shingle with the fewest prefix
    shingles of its own, which is the nearest to the text that the others vary, and
    others drawn by hash."""
    own = F.struct("lone", F.xxhash64("id", F.lit(salt)), "id")
    drawn = [F.min(F.struct(F.xxhash64("id", F.lit(salt + k)), "id")).alias(f"h{k}") for k in range(1, HUBS)]
    found = met.groupBy("token").agg(F.min(own).alias("h0"), *drawn)
    return found.select("token", *(F.col(f"h{k}.id").alias(f"hub{k}") for k in range(HUBS)))


def links(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between class representatives: verified links that connect every
    class with all it is linked to, directly or over others."""
    met = met_classes(classes)
    shares = met.groupBy("id").agg(F.count("*").alias("k"))
    lone = classes.select("id", F.size("prefix").alias("all")).join(shares, "id").select("id", (F.col("all") - F.col("k")).alias("lone"))
    met = stored(met.join(lone, "id"))
    edges: DataFrame | None = None
    left, placed = met, None
    for salt in (0, HUBS):
        pairs = stored(_plausible(_with_hubs(left, _hubs(left, salt)), classes))
        new = verified(documents, pairs)
        edges = stored(new if edges is None else edges.unionAll(new))
        known = components(edges).select(F.col("node").alias("id"), "component")
        placed = stored(met.join(known, "id", "left").withColumn("component", F.coalesce("component", "id")))
        # shingles whose classes are all connected have nothing left to tell
        unequal = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token")
        left = stored(placed.join(unequal, "token", "left_semi"))
    left = left.join(classes.select("id", "n", "bits"), "id")
    rest = (
        left.alias("a")
        .join(left.alias("b"), "token")
        .where((F.col("a.component") < F.col("b.component")) & _sizes_fit() & _bits_fit())
        .select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
        .distinct()
    )
    return edges.unionAll(verified(documents, stored(rest)))


def linked_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    ``component_id`` is the smallest doc_id reachable over links, its own included.
    Null and empty texts have no shingles and stand alone.  Rows without doc_id get
    their set size and a null component and link nothing.  Repeated rows repeat;
    rows that share an id are one document, linked by any of their texts.  Other
    columns are not read."""
    bound_batches(documents)
    kind = documents.schema["doc_id"].dataType
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = stored(rows.mapInArrow(_profile, "doc_id long, n int, sig binary, block int, sums binary"))
    each = profile.where("block is null").select("doc_id", "n", "sig")
    features = with_prefixes(rows, sketch_of(profile))
    classes = stored(
        features.groupBy("sig").agg(
            F.min("doc_id").alias("id"), F.min("n").alias("n"), F.first("group_sig").alias("group_sig"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")
        )
    )
    found = links(rows, classes)
    # rows with one id are one node, whatever their texts
    ids = each.where("doc_id is not null and n > 0")
    several = ids.select("doc_id", "sig").distinct().groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    same = ids.join(several, "doc_id").join(classes.select("sig", "id"), "sig").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    known = components(found.unionAll(same))
    roots = classes.select("sig", "id").join(known.withColumnRenamed("node", "id"), "id", "left").select("sig", F.coalesce("component", "id").alias("component_id"))
    placed = ids.join(roots, "sig").select("doc_id", "n", "component_id")
    alone = each.where("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return placed.unionAll(alone).select(
        F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id")
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of ``documents``, one of each linked group: that with the smallest
    id.  Rows without an id and documents without words stay."""
    found = linked_groups(documents)
    gone = found.where("component_id is not null and doc_id != component_id").select("doc_id").distinct()
    kept = documents.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(documents.columns)
    often = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    # repeated rows of an id are rare; only they are reduced
    single = kept.join(often, "doc_id", "left_anti").select(documents.columns)
    repeated = kept.join(often, "doc_id", "left_semi").select(documents.columns).dropDuplicates(["doc_id"])
    return single.unionAll(repeated).unionAll(documents.where("doc_id is null"))
