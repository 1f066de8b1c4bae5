"""Packing by power-of-two decomposition.

A document of n tokens (its ids and one end id) is cut into whole pieces of the
longest length and then the binary digits of the rest, longest first.  Each piece
is a sequence of its own whose length is a power of two: no sequence crosses
documents and none is padded.  Pieces of one length form a bucket, from which
batches of equal shape are drawn.

One map stage: nothing is shuffled, and a document of any length is a run of rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettica.llm.common import bound_batches, texts, words, worker_memory

LONGEST = 4096
END_ID = 2
#: Words, pieces of words among them, in each of the two halves of a worker's memory.
REMEMBERED = 400_000
#: Bytes of words and ids in a half; longer words fill it sooner.
REMEMBERED_BYTES = 32 << 20


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two, none longer than ``longest``, that add up to ``n``."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]


class WordIds:
    """Ids of texts under a lower-casing BPE tokenizer that drops white space.

    The ids of a text are those of its blank-separated words, looked up once and
    remembered.  A full young half of the memory becomes the old one, whose words come
    back when they are asked for, so frequent words are never looked up again.  A word
    of Latin letters, digits and signs goes straight to the tokenizer's BPE model, cut
    by the same pattern as its own pre-tokenizer; any other word, or one that may hold a
    special token, goes through the whole tokenizer.  The pieces of a cut word have the
    ids that they would have as words, so one memory holds both.  The tests hold all
    against the tokenizer on whole texts."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # below U+0250 lower case and NFC are what the tokenizer makes of them
        self.plain = regex.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+")
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.letters = byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.held = 0

    def piece(self, text: bytes) -> bytes:
        found = self.words.get(text)
        if found is None:
            found = self.old_words.get(text)
            if found is None:
                spelled = text.decode() if text.isascii() else "".join([self.letters[b] for b in text])
                ids = [t.id for t in self.model.tokenize(spelled)]
                found = struct.pack(f"<{len(ids)}I", *ids)
            self.words[text] = found
            self.held += len(text) + len(found)
        return found

    def word(self, word: bytes) -> bytes:
        if word.isalpha():  # of bytes: ASCII letters only
            return self.piece(word.lower())
        text = word.decode()
        if "<|" not in text and (text.isascii() and text.isprintable() or self.plain.fullmatch(text)):
            return b"".join([self.piece(part.encode()) for part in self.cut.findall(text.lower())])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> np.ndarray:
        if len(self.words) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.words, self.old_words, self.held = {}, self.words, 0
        split, known = words(text), self.words
        found = list(map(known.get, split))
        if None in found:
            old = self.old_words
            for at, ids in enumerate(found):
                if ids is None:
                    word = split[at]
                    ids = known.get(word)  # it may stand earlier in this text
                    if ids is None:
                        ids = old.get(word)
                        if ids is None:
                            ids = self.word(word)
                        known[word] = ids
                        self.held += len(word) + len(ids)
                    found[at] = ids
        return np.frombuffer(b"".join(found), "<u4")


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 stands
    for itself, the other bytes for U+0100 and on, in order."""
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in itself]
    return [chr(b) if b in itself else chr(256 + others.index(b)) for b in range(256)]


def pack(documents: DataFrame, tokenizer: str, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, bucket, ids, doc_tokens, sequence_id, offset).

    ``longest`` is a power of two.  Null texts count as empty: one piece, the end
    id.  Repeated rows are packed each on their own, rows without doc_id too.
    ``sequence_id`` is unique, ``bucket`` is log2 of the length.  Other columns are
    not read."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    bound_batches(documents)
    kind = documents.schema["doc_id"].dataType
    schema = pa.schema(
        [("doc_id", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = worker_memory(f"ids {tokenizer}", lambda: WordIds(tokenizer)).of

        for batch in source:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                docs, starts, lengths, sums, totals, flat = [], [], [], [], [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), texts(part), strict=True):
                    ids = np.append(ids_of(text), np.array(end_id, "<u4"))
                    raw, start = memoryview(ids).cast("B"), 0
                    for length in piece_lengths(len(ids), longest):
                        docs.append(doc)
                        starts.append(start)
                        lengths.append(length)
                        sums.append(zlib.crc32(raw[4 * start : 4 * (start + length)]))
                        totals.append(len(ids))
                        start += length
                    flat.append(ids)
                if docs:
                    ends = np.cumsum(lengths)
                    pieces = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.concatenate(flat).view("<i4")))
                    buckets = [n.bit_length() - 1 for n in lengths]
                    columns = (docs, starts, lengths, buckets, pieces, sums, totals)
                    yield pa.RecordBatch.from_arrays([c if c is pieces else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return (
        documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
        .mapInArrow(run, "doc_id string, start long, length long, bucket int, ids array<int>, ids_crc32 long, doc_tokens long")
        .select(
            F.col("doc_id").cast(kind).alias("doc_id"),
            "start",
            "length",
            "bucket",
            "ids",
            "ids_crc32",
            "doc_tokens",
            F.monotonically_increasing_id().alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces in one folder per length, ready to be read batch by batch."""
    pieces.write.partitionBy("bucket").parquet(path)
