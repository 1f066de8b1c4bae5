"""Quality by tokeniser fertility: what public vocabularies make of a text.

Per text, from the pieces of a public byte-fallback vocabulary: characters per
token, the share of byte-fallback pieces, and the entropy of the token
distribution.  Bands by language, else by script, say what is accepted; they are
a parameter.  Beside them the plain counts of words, symbols and repetitions.

One map stage.  Words are looked up in the vocabulary once per worker and
remembered: with this vocabulary no piece crosses a blank.
"""

from __future__ import annotations

import math
import struct
from collections import Counter
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vettica.llm.common import BLANKS, bound_batches, texts, worker_memory

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 10
#: A text fails if more than this share, in hundredths, of its words is repeated.
MOST_REPEATED = 20
WINDOW = 5
#: Words whose pieces a worker remembers.
REMEMBERED = 250_000


class Band(NamedTuple):
    """Accepted ranges; entropy is in bits and asked of texts of ``sized`` tokens on.

    Least values are numbers, or one number for each of ``SIZES`` with straight lines
    over the logarithm of the tokens between them: short texts vary more and have
    less entropy."""

    least_chars: float | tuple[float, ...]
    most_chars: float
    most_bytes: float
    least_entropy: float | tuple[float, ...]
    sized: int = 32


#: Tokens of a text at which the least values of a band are given.
SIZES = (32, 64, 128, 256, 512, 1024, 2048, 4096)
#: By language, then by script.  The least values are percentiles of the good texts
#: labelled in sf0.1 that pass the base rules, taken within a factor of two of each
#: size: 0.5 for entropy (after taking out its trend, rounded down to 0.05), 0.2 for
#: characters (rounded down by 0.02 to 0.04, never falling with size); the first two
#: sizes have too few texts and share values.  Symbols stuck on words and menus of
#: ``word | word`` use few tokens often, so they lie below.  The most values are wide:
#: prose that a vocabulary was made for takes more characters than these tables.
#: Latin script of other languages has the least of the four; for ``other`` there are
#: no labelled texts.
BANDS: Mapping[str, Band] = {
    "en": Band((1.42, 1.42, 1.42, 1.88, 1.96, 2.06, 2.10, 2.14), 8.0, 0.10, (4.2, 4.75, 5.6, 6.0, 6.3, 6.55, 6.7, 6.85)),
    "de": Band((1.26, 1.26, 1.26, 2.02, 2.04, 2.12, 2.16, 2.16), 8.0, 0.10, (4.1, 4.75, 5.4, 5.9, 6.2, 6.4, 6.5, 6.65)),
    "fr": Band((1.62, 1.62, 1.62, 1.62, 1.68, 1.82, 1.86, 1.92), 8.0, 0.10, (4.2, 4.75, 5.4, 5.75, 6.15, 6.3, 6.45, 6.55)),
    "es": Band((1.32, 1.32, 1.74, 1.76, 1.78, 1.80, 1.86, 1.86), 8.0, 0.10, (4.2, 4.75, 5.45, 5.85, 6.15, 6.3, 6.55, 6.7)),
    "latin": Band((1.26, 1.26, 1.26, 1.62, 1.68, 1.80, 1.86, 1.86), 8.0, 0.10, (4.1, 4.75, 5.4, 5.75, 6.15, 6.3, 6.45, 6.55)),
    "other": Band(0.2, 8.0, 0.70, 2.5, 50),
}
_LOG_SIZES = np.log2(SIZES)


def script(text: str) -> str:
    """``latin`` if at least half of the letters are, else ``other``."""
    letters = latin = 0
    for char, n in Counter(text).items():
        if char.isalpha():
            letters += n
            latin += n * (char < "ɐ")
    return "latin" if 2 * latin >= letters else "other"


class Measures(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_tokens: int
    chars_per_token: float
    byte_share: float
    entropy: float


class Meter:
    """Measures texts; remembers the pieces of words."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.known: dict[str, bytes] = {}

    def tokens(self, counts: Counter) -> np.ndarray:
        """Token counts of words, given how often each occurs."""
        known = self.known
        if len(known) > REMEMBERED:
            known = self.known = {}
        new = [w for w in counts if w not in known]
        if new:
            known.update(zip(new, (struct.pack(f"<{len(x)}I", *x) for x in self.pieces.encode(new, num_threads=1)), strict=True))
        found = [known[w] for w in counts]
        times = np.fromiter(counts.values(), np.int64, len(counts))
        return np.bincount(np.frombuffer(b"".join(found), "<u4"), np.repeat(times, [len(x) // 4 for x in found]))

    def of(self, text: str) -> Measures:
        words = [w.decode() for w in text.encode("utf-8", "replace").split()]
        if not words:
            return Measures(0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0, 0.0, 0.0, 0.0)
        word_chars = len(text) - sum(map(text.count, BLANKS))
        counts = self.tokens(Counter(words))
        total = int(counts.sum())
        part = counts[counts > 0] / max(total, 1)
        return Measures(
            len(words),
            word_chars,
            sum(map(text.count, SYMBOLS)),
            duplicate_lines(text),
            repeated_words(words),
            total,
            word_chars / max(total, 1),
            float(counts[self.is_byte[: len(counts)]].sum() / max(total, 1)),
            float(-(part * np.log2(part)).sum()),
        )


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def repeated_words(words: list[str]) -> int:
    """Words inside 5-word windows that the text has twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if window in often:
            covered += at + WINDOW - max(at, end)
            end = at + WINDOW
    return covered


def failed(m: Measures) -> bool:
    return m.n_words < LEAST_WORDS or 100 * m.n_repeat_words > MOST_REPEATED * m.n_words


def least(value: float | tuple[float, ...], n_tokens: int) -> float:
    if isinstance(value, tuple):
        return float(np.interp(math.log2(max(n_tokens, 1)), _LOG_SIZES, value))
    return value


def accepted(m: Measures, band: Band) -> bool:
    return (
        least(band.least_chars, m.n_tokens) <= m.chars_per_token <= band.most_chars
        and m.byte_share <= band.most_bytes
        and (m.n_tokens < band.sized or m.entropy >= least(band.least_entropy, m.n_tokens))
    )


class Judge:
    """Verdicts on texts: (measures, base_failed, band name, kept)."""

    def __init__(self, vocabulary: str, bands: Mapping[str, Band]):
        self.meter = worker_memory(f"pieces {vocabulary}", lambda: Meter(vocabulary))
        self.bands = bands

    def of(self, text: str, lang: str | None) -> tuple[Measures, bool, str, bool]:
        m = self.meter.of(text)
        name = lang if lang in self.bands else script(text)
        base = failed(m)
        return m, base, name, not base and accepted(m, self.bands[name])


COLUMNS = (
    ("n_words", "long", pa.int64()),
    ("word_chars", "long", pa.int64()),
    ("n_symbols", "long", pa.int64()),
    ("n_dup_lines", "long", pa.int64()),
    ("n_repeat_words", "long", pa.int64()),
    ("n_tokens", "long", pa.int64()),
    ("chars_per_token", "double", pa.float64()),
    ("byte_share", "double", pa.float64()),
    ("token_entropy", "double", pa.float64()),
    ("base_failed", "boolean", pa.bool_()),
    ("band", "string", pa.string()),
    ("kept", "boolean", pa.bool_()),
)


def judge_quality(documents: DataFrame, vocabulary: str, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """doc_id, the measures, ``base_failed``, ``band`` and ``kept`` of every row.

    Null and empty texts have no words and fail.  A null or unlisted language is
    judged by script.  Repeated rows and rows without doc_id are judged each on
    their own.  Other columns are not read."""
    bands = dict(bands)
    bound_batches(documents)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(vocabulary, bands)
        for batch in source:
            found = [judge.of(t, lang) for t, lang in zip(texts(batch), batch.column("lang").to_pylist(), strict=True)]
            rows = [(*m, base, name, kept) for m, base, name, kept in found]
            columns = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, (_, _, k) in zip(columns, COLUMNS, strict=True))],
                ["doc_id", *(n for n, _, _ in COLUMNS)],
            )

    schema = ", ".join([f"doc_id {kind}", *(f"{n} {k}" for n, k, _ in COLUMNS)])
    return documents.select("doc_id", "text", "lang").mapInArrow(run, schema)


def keep_quality(documents: DataFrame, vocabulary: str, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """The rows that ``judge_quality`` keeps, with all their columns, in one pass."""
    bands = dict(bands)
    bound_batches(documents)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(vocabulary, bands)
        for batch in source:
            kept = [judge.of(t, lang)[3] for t, lang in zip(texts(batch), batch.column("lang").to_pylist(), strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
