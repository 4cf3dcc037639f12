"""What the operators of this package share: sizing, checkpoints and batches.

A *batch* is a set of rows whose keys hash alike.  Batches hold about the same number of
bytes at any input size; each is one group of ``applyInArrow``, so a task never sees more
than its batch at a time.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..plans.session import shared_folder
from .words import slices

#: Bytes of text in a batch: it follows the square root of the corpus between these bounds,
#: which keeps both the batches and the messages between any two of them of a useful size.
BATCH_BYTES = (1 << 19, 1 << 25)

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder and read from there.

    See :func:`tesserix.plans.session.shared_folder`.  What the rows were shuffled through is
    deleted once they are written, since nothing reads it again.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(_CLEANUP, before)


def release() -> None:
    """Give memory that is free back to the machine: workers are kept for later stages, and what
    they keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def tidy(function):
    """A function that tasks run on a group, or a generator that they run on batches, which gives
    its memory back at the end."""
    if inspect.isgeneratorfunction(function):

        @functools.wraps(function)
        def run(*args):
            try:
                yield from function(*args)
            finally:
                release()

        return run

    @functools.wraps(function)
    def once(*args):
        try:
            return function(*args)
        finally:
            release()

    return once


def quoted(name: str) -> str:
    """A column's name as SQL takes it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def whole_rows(docs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those named) as one column ``row``, so that no name of theirs
    can clash with another or be misread."""
    names = docs.columns if names is None else names
    return docs.select(F.struct(*(F.col(quoted(c)) for c in names)).alias("row"))


def row_slices(batch: pa.RecordBatch, text_at: int):
    """Rows in runs of a bounded number of bytes of text, and their texts, field ``text_at``."""
    rows = batch.column(0)
    for part in slices(pa.RecordBatch.from_arrays([rows, pc.struct_field(rows, [text_at])], ["row", "text"])):
        yield part.column(0), part.column(1)


def filter_rows(docs: DataFrame, kept) -> DataFrame:
    """The rows of ``docs``, all columns as they are, for whose texts ``kept`` (a function of an
    array of texts) says so."""
    text_at = docs.columns.index("text")

    @tidy
    def run(batches):
        for batch in batches:
            for rows, texts in row_slices(batch, text_at):
                yield pa.RecordBatch.from_arrays([rows.filter(pa.array(kept(texts)))], ["row"])

    return whole_rows(docs).mapInArrow(run, StructType([StructField("row", docs.schema)])).select("row.*")


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread, how: str = "inner", salts: int = 8) -> DataFrame:
    """``many`` joined with ``few``, where one key may have a large share of ``many``: its rows are
    dealt over ``salts`` tasks by ``spread`` (a column or its name), and ``few`` goes to each."""
    dealt = many.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copied = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [*keys, "salt"], how).drop("salt")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all the texts: one narrow aggregation."""
    return docs.agg(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0


def batch_count(total_bytes: int) -> int:
    low, high = BATCH_BYTES
    return max(32, math.ceil(total_bytes / min(high, max(low, 70 * math.sqrt(total_bytes)))))


def binary_column(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow binary array over ``data``'s bytes; element i is data[bounds[i]:bounds[i + 1]]."""
    data = np.ascontiguousarray(data)
    offsets = (np.asarray(bounds, np.int64) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )


def flat_binary(column: pa.ChunkedArray | pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column end to end as ``dtype``, and the bounds of each."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts, sizes = [], []
    for chunk in chunks:
        if not len(chunk):
            continue
        wide = chunk.type in (pa.large_binary(), pa.large_string())
        offsets = np.frombuffer(chunk.buffers()[1], np.int64 if wide else np.int32)
        offsets = offsets[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        raw = chunk.buffers()[2]
        if raw is not None:
            parts.append(np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]])
        sizes.append(np.diff(offsets))
    raw = np.concatenate(parts) if parts else np.empty(0, np.uint8)
    sizes = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    dtype = np.dtype(dtype)
    return raw.view(dtype), np.concatenate([[0], np.cumsum(sizes)]) // dtype.itemsize
