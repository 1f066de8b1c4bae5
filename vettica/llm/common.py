"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call white space: blank and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"

#: Bytes of an Arrow batch.
BATCH = 4 << 20


def remainder(key: str, divisor: int) -> Column:
    """crc32 of a key written as text, modulo ``divisor``; a null key counts as ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % divisor


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8; bytes split there only."""
    return text.encode("utf-8", "replace").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """The same with A-Z in lower case and nothing else changed."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column of a batch with '' for null."""
    return [t or "" for t in batch.column(column).to_pylist()]


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="vettica-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/vettica-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again: a lost executor
    costs a read, not the work before it."""
    return stored_for(frame)[0]


def stored_for(frame: DataFrame) -> tuple[DataFrame, str]:
    """As :func:`stored`, with the folder, for tables that the caller gives up early."""
    spark = frame.sparkSession
    path = shared_folder(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def give_up(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more: what was made of it must be
    stored itself, so that no lost executor asks for it again."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of each query inside when the query ends, not when
    the driver happens to collect its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def bound_batches(frame: DataFrame) -> SparkSession:
    """The frame's session, with Arrow batches of at most ``BATCH`` bytes: rows of
    very long texts then come to Python a few at a time."""
    spark = frame.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return spark


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def regrouped(source: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes: small ones joined, large ones cut."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in source:
        step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            total += part.nbytes
            if total >= size:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, total = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def packed(batch: pa.RecordBatch) -> bytes:
    """A batch as one compressed value of a row."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write(batch)
    return out.getvalue().to_pybytes()


def unpacked(value: pa.Scalar) -> pa.RecordBatch:
    """The batch that :func:`packed` made the value of."""
    return pa.ipc.open_stream(value.as_buffer()).read_next_batch()


def packed_numbers(**columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers as one compressed value; two bytes of each stand together,
    as their high bytes are much alike."""
    parts = {f"{name}{k}": np.ascontiguousarray(x) for name, c in columns.items() for k, x in enumerate(c.view(np.uint16).reshape(-1, 4).T)}
    return packed(pa.record_batch(parts))


def unpacked_numbers(batch: pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    """A column of the numbers that :func:`packed_numbers` made the batch of."""
    parts = [batch.column(f"{name}{k}").to_numpy() for k in range(4)]
    return np.stack(parts, axis=1).reshape(-1).view(kind)


def worker_memory(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once per Python worker process and kept for its
    later tasks: a vocabulary and what was looked up in it.  A worker keeps the last
    one only, so that stages which follow each other do not add up."""
    held = sys.modules.setdefault("_vettica_llm_memory", types.ModuleType("_vettica_llm_memory")).__dict__
    kept = held.get("kept")
    if kept is None or kept[0] != key:
        held["kept"] = kept = None  # the old one goes before the new one is made
        held["kept"] = kept = (key, make())
    return kept[1]
