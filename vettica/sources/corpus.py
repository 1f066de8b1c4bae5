"""Choosing what to scan: pruning, size, binary content and change sets.

A corpus row is one file: ``path``, ``content`` (bytes) or ``text``, and
``length`` in bytes.  Paths are unique within a corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vettica.functions.text import decode_utf8

# Directories never entered; the defaults of the largest file and of
# the bytes looked at.
SKIPPED_DIRECTORIES = ("node_modules", "__pycache__", "venv", ".venv")
MAX_FILE_BYTES = 5 * 1024 * 1024
SNIFFED_BYTES = 8192


def in_skipped_directory(path: Column) -> Column:
    """Whether some directory of the path is hidden or on the list; the file
    name itself does not count."""
    directories = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.exists(
        directories,
        lambda name: (name.startswith(".") & ~name.isin(".", ".."))
        | name.isin(*SKIPPED_DIRECTORIES),
    )


def is_too_large(length: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    return length > max_bytes


def is_binary(content: Column, sniffed_bytes: int = SNIFFED_BYTES) -> Column:
    """Whether a NUL is among the first bytes."""
    start = F.decode(F.substring(content.cast("binary"), 1, sniffed_bytes), "ISO-8859-1")
    return F.instr(start, "\0") > 0


def below(root: str, path: Column) -> Column:
    """The part of a path below ``root``; the path itself where it lies elsewhere."""
    base = root.rstrip("/") + "/" if root else ""
    return F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def prune_dirs(corpus: DataFrame, root: str = "") -> DataFrame:
    """Without files in hidden or listed directories below ``root``; the root's own
    directories do not count."""
    return corpus.filter(~in_skipped_directory(below(root, F.col("path"))))


def filter_size(corpus: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    return corpus.filter(~is_too_large(F.col("length"), max_bytes))


def filter_binary(corpus: DataFrame, sniffed_bytes: int = SNIFFED_BYTES) -> DataFrame:
    return corpus.filter(~is_binary(F.col("content"), sniffed_bytes))


def decode_text(corpus: DataFrame) -> DataFrame:
    """(path, text): the content as UTF-8, malformed bytes dropped."""
    return corpus.select("path", decode_utf8(F.col("content")).alias("text"))


def select_scannable(
    corpus: DataFrame,
    root: str = "",
    max_bytes: int = MAX_FILE_BYTES,
    sniffed_bytes: int = SNIFFED_BYTES,
) -> DataFrame:
    """The rows a directory scan of ``root`` would read, cheap tests first."""
    return filter_binary(filter_size(prune_dirs(corpus, root), max_bytes), sniffed_bytes)


def skip_report(
    corpus: DataFrame,
    root: str = "",
    max_bytes: int = MAX_FILE_BYTES,
    sniffed_bytes: int = SNIFFED_BYTES,
) -> DataFrame:
    """How many files, and bytes, each reason left out, outside pruned directories."""
    reason = (
        F.when(is_too_large(F.col("length"), max_bytes), "too large")
        .when(F.col("length").isNull() | F.col("content").isNull(), "unreadable")
        .when(is_binary(F.col("content"), sniffed_bytes), "suspected binary")
    )
    return (
        prune_dirs(corpus, root)
        .select(reason.alias("reason"), "length")
        .filter(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    )


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths of ``new`` that ``old`` lacks or holds with another hash."""
    before = old.select("path", F.col("hash").alias("old_hash"))
    return (
        new.select("path", "hash")
        .join(before, "path", "left")
        .select(
            "path",
            F.when(F.col("old_hash").isNull(), "added")
            .when(F.col("hash") != F.col("old_hash"), "modified")
            .alias("change"),
        )
        .filter(F.col("change").isNotNull())
    )


def restrict_to(corpus: DataFrame, changed: DataFrame) -> DataFrame:
    """The corpus rows whose path is in the change set."""
    return corpus.join(changed.select("path"), "path", "left_semi")


def select_changed(
    corpus: DataFrame,
    changed: DataFrame,
    max_bytes: int = MAX_FILE_BYTES,
    sniffed_bytes: int = SNIFFED_BYTES,
) -> DataFrame:
    """The changed files that a rescan reads: of any directory, as directories are
    pruned in walks only, but neither too large nor binary.

    Size is tested before the join and content after it, on the files met."""
    small = filter_size(corpus.select("path", "content", "length"), max_bytes)
    return filter_binary(restrict_to(small, changed), sniffed_bytes)


def load_corpus(spark: SparkSession, location: str) -> DataFrame:
    """A corpus kept as a Parquet table with ``path`` and ``content``."""
    table = spark.read.parquet(location)
    if "length" not in table.columns:
        table = table.withColumn("length", F.octet_length("content").cast("bigint"))
    return table.select("path", "content", "length")
