"""Reading a raw directory tree as a corpus.

Spark's file sources leave out names that start with ``_`` or ``.``, so
``__init__.py`` and ``.env`` would be missed.  Here the tree is listed by tasks:
a few levels are spread one after the other, the rest below is walked where it
lies, and the files are spread again before they are read.  The tree must be
visible under the same path on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vettica.sources.corpus import SKIPPED_DIRECTORIES

ENTRY_SCHEMA = "path string, directory boolean"
CORPUS_SCHEMA = "path string, content binary, length bigint"
BATCH_BYTES = 16 * 1024 * 1024
SPREAD_LEVELS = 3


def _entered(name: str) -> bool:
    return not name.startswith(".") and name not in SKIPPED_DIRECTORIES


def _list_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace each directory by its entries; links are not followed."""
    import os

    for batch in batches:
        for path, directory in zip(batch["path"], batch["directory"]):
            found = [(path, False)]
            if directory:
                try:
                    with os.scandir(path) as entries:
                        found = [
                            (entry.path, entry.is_dir(follow_symlinks=False))
                            for entry in entries
                            if not entry.is_symlink()
                            and (entry.is_file() or (entry.is_dir() and _entered(entry.name)))
                        ]
                except OSError:
                    pass  # the folder stays as a row that cannot be read
            yield pd.DataFrame(found, columns=["path", "directory"])


def _list_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import os

    for batch in batches:
        for path, directory in zip(batch["path"], batch["directory"]):
            if not directory:
                yield pd.DataFrame([(path, False)], columns=["path", "directory"])
                continue
            closed: list[tuple[str, bool]] = []
            for folder, folders, names in os.walk(
                path, followlinks=False, onerror=lambda e, closed=closed: closed.append((e.filename, False))
            ):
                folders[:] = [name for name in folders if _entered(name)]
                files = [os.path.join(folder, name) for name in names]
                kept = [(f, False) for f in files if os.path.isfile(f) and not os.path.islink(f)]
                yield pd.DataFrame(kept, columns=["path", "directory"])
            yield pd.DataFrame(closed, columns=["path", "directory"])


def _read(batches: Iterator[pd.DataFrame], max_bytes: int | None) -> Iterator[pd.DataFrame]:
    """File contents in batches of bounded size.  A file over the limit keeps its
    row and length, without content; what cannot be read has neither."""
    import os

    columns = ["path", "content", "length"]
    for batch in batches:
        rows, held = [], 0
        for path in batch["path"]:
            content, size = None, None
            try:
                size = os.path.getsize(path)
                if max_bytes is None or size <= max_bytes:
                    with open(path, "rb") as file:
                        content = file.read()
            except OSError:
                content = size = None
            rows.append((path, content, size))
            held += len(content or b"")
            if held >= BATCH_BYTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def load_tree(
    spark: SparkSession, root: str, partitions: int = 64, max_bytes: int | None = None
) -> DataFrame:
    """(path, content, length) of the files under a directory, or of one file.

    Files and folders that cannot be read are rows without content and length.  A
    caller that will drop large files anyway passes ``max_bytes``, and their content
    is not read.
    """
    import os

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _read(batches, max_bytes)

    entries = spark.createDataFrame([(root, os.path.isdir(root))], ENTRY_SCHEMA)
    for _ in range(SPREAD_LEVELS):
        entries = entries.mapInPandas(_list_level, ENTRY_SCHEMA).repartition(
            partitions, F.col("path")
        )
    files = entries.mapInPandas(_list_rest, ENTRY_SCHEMA).repartition(partitions, F.col("path"))
    return files.mapInPandas(read, CORPUS_SCHEMA)
