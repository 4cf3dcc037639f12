"""Readers and writers of the flat formats of association studies.

Binary matrices and vectors are Python data sources, planned as ranges of markers (or values) so
that each task reads its own stretch of the file; text formats go through Spark's text reader.
Filters on the number of a marker (or value) are pushed down and decide which ranges are planned, and of
matrices a range of samples can be asked for: only bytes that hold wanted rows and samples are read.

==========  ================================================================  =====================
format      layout                                                            rows
==========  ================================================================  =====================
bed         3 header bytes, then ceil(N/4) bytes a marker of two-bit calls    marker_idx, payload
dense       N doubles a marker, no header                                     marker_idx, payload
vector      doubles, no header                                                idx, value
==========  ================================================================  =====================
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from ..functions.scalars import chromosome_number

#: What a file of two-bit calls begins with (fixed value of the format): its mark, and markers by samples.
BED_HEADER = b"\x6c\x1b\x01"
#: Bytes of a file that one task reads.
RANGE_BYTES = 32 << 20
_BATCH_BYTES = 8 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    local = re.match(r"file:/*(/.*)|(/.*)", path)
    return (pafs.LocalFileSystem(), local[1] or local[2]) if local else pafs.FileSystem.from_uri(path)


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__(None)
        self.start, self.end = start, end


#: A stretch of each record is read by itself if what lies between two of them is as long as this.
_GAP_BYTES = 64 << 10


class _Records(DataSourceReader):
    """Records of one size after a header; ``part``: the bytes of each that are wanted."""

    def __init__(self, path: str, header: int, size: int, binary: bool, part: tuple[int, int] | None = None):
        self.path, self.header, self.size, self.binary = path, header, size, binary
        self.part = part or (0, size)
        self.low, self.high, self.listed = 0, None, None

    def pushFilters(self, filters):
        """Takes over comparisons of the record's number with integers."""
        column = "marker_idx" if self.binary else "idx"
        for f in filters:
            mine = getattr(f, "attribute", None) == (column,)
            if mine and isinstance(f, In) and all(isinstance(v, int) for v in f.value):
                self.listed = set(f.value) if self.listed is None else self.listed & set(f.value)
            elif mine and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, int):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            else:
                yield f

    def _ranges(self, count: int) -> list[tuple[int, int]]:
        """Runs of wanted records among ``count``."""
        low, high = max(0, self.low), count if self.high is None else min(count, self.high)
        if self.listed is None:
            return [(low, high)] if low < high else []
        own = np.array(sorted(k for k in self.listed if low <= k < high), np.int64)
        cuts = np.flatnonzero(np.diff(own) != 1) + 1
        return [(int(run[0]), int(run[-1]) + 1) for run in np.split(own, cuts) if len(run)]

    def partitions(self):
        files, name = opened(self.path)
        whole = files.get_file_info(name).size - self.header
        if whole < 0 or whole % self.size:
            raise ValueError(f"{self.path}: {whole} bytes after the header are no whole number of records of {self.size}")
        step = max(1, RANGE_BYTES // self.size)
        return [_Range(k, min(b, k + step)) for a, b in self._ranges(whole // self.size) for k in range(a, b, step)] or [_Range(0, 0)]

    def _read(self, f, a: int, b: int) -> list[bytes]:
        """The wanted part of each of the records from ``a`` on."""
        first, last = self.part
        at = lambda k: self.header + k * self.size
        if self.size - (last - first) >= _GAP_BYTES:
            return [f.read_at(last - first, at(k) + first) for k in range(a, b)]
        data = f.read_at((b - 1 - a) * self.size + last - first, at(a) + first)
        return [data[k * self.size : k * self.size + last - first] for k in range(b - a)]

    def read(self, partition):
        files, name = opened(self.path)
        step = max(1, _BATCH_BYTES // self.size)
        with files.open_input_file(name) as f:
            for a in range(partition.start, partition.end, step):
                b = min(partition.end, a + step)
                index = pa.array(np.arange(a, b))
                if self.binary:
                    yield pa.RecordBatch.from_arrays([index, pa.array(self._read(f, a, b), pa.binary())], ["marker_idx", "payload"])
                else:
                    data = f.read_at((b - a) * self.size, self.header + a * self.size)
                    yield pa.RecordBatch.from_arrays([index, pa.array(np.frombuffer(data, "<f8"))], ["idx", "value"])


class BedSource(DataSource):
    """Options: ``path`` and ``samples``; ``first`` and ``last``, multiples of four but at the end, for a
    range of samples."""

    @classmethod
    def name(cls) -> str:
        return "bed"

    def schema(self) -> str:
        return "marker_idx long, payload binary"

    def reader(self, schema) -> _Records:
        size = -(-int(self.options["samples"]) // 4)
        first, last = int(self.options.get("first", 0)), int(self.options.get("last", self.options["samples"]))
        return _Records(self.options["path"], len(BED_HEADER), size, True, (first // 4, -(-last // 4)))

    def writer(self, schema, overwrite: bool) -> "_Writer":
        return _Writer(self.options["path"], BED_HEADER)


class DenseSource(DataSource):
    """Options: ``path`` and ``samples``; ``first`` and ``last`` for a range of samples."""

    @classmethod
    def name(cls) -> str:
        return "dense"

    def schema(self) -> str:
        return "marker_idx long, payload binary"

    def reader(self, schema) -> _Records:
        first, last = int(self.options.get("first", 0)), int(self.options.get("last", self.options["samples"]))
        return _Records(self.options["path"], 0, 8 * int(self.options["samples"]), True, (8 * first, 8 * last))

    def writer(self, schema, overwrite: bool) -> "_Writer":
        return _Writer(self.options["path"])


class _Written(WriterCommitMessage):
    def __init__(self, first: int, name: str):
        self.first, self.name = first, name


class _Writer(DataSourceArrowWriter):
    """Tasks write stretches of rows that are sorted by their number, payloads or doubles; committing
    joins them after the header."""

    def __init__(self, path: str, header: bytes = b""):
        self.path, self.header = path, header

    def write(self, iterator):
        files, name = opened(self.path)
        part = f"{name}.{TaskContext.get().partitionId()}-{uuid.uuid4().hex}.part"
        first = None
        with files.open_output_stream(part, compression=None) as out:
            for batch in iterator:
                if batch.num_rows:
                    first = batch.column(0)[0].as_py() if first is None else first
                    values = batch.column(1)
                    packed = pa.types.is_binary(values.type)
                    out.write(b"".join(values.to_pylist()) if packed else values.to_numpy(zero_copy_only=False).astype("<f8").tobytes())
        return _Written(-1 if first is None else first, part)

    def commit(self, messages):
        files, name = opened(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.first)
        with files.open_output_stream(name, compression=None) as out:
            out.write(self.header)
            for m in parts:
                with files.open_input_stream(m.name, compression=None) as f:
                    while data := f.read(1 << 22):
                        out.write(data)
                files.delete_file(m.name)

    def abort(self, messages):
        files, _ = opened(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(m.name)


class VectorSource(DataSource):
    """Option: ``path``."""

    @classmethod
    def name(cls) -> str:
        return "vector"

    def schema(self) -> str:
        return "idx long, value double"

    def reader(self, schema) -> _Records:
        return _Records(self.options["path"], 0, 8, False)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (BedSource, DenseSource, VectorSource):
        spark.dataSource.register(source)


def _matrix(spark: SparkSession, kind: str, path: str, n_samples: int, samples: tuple[int, int] | None) -> DataFrame:
    register(spark)
    reader = spark.read.format(kind).option("path", path).option("samples", n_samples)
    if samples is not None:
        first, last = samples
        if not 0 <= first < last <= n_samples or (kind == "bed" and (first % 4 or (last % 4 and last != n_samples))):
            raise ValueError(f"no range of samples {first} to {last} of {n_samples}")
        reader = reader.option("first", first).option("last", last)
    return reader.load()


def read_bed(spark: SparkSession, path: str, n_samples: int, samples: tuple[int, int] | None = None) -> DataFrame:
    """``marker_idx, payload`` of two-bit calls, of all samples or of those from one (a multiple of four) to
    before another (the same, or the end)."""
    return _matrix(spark, "bed", path, n_samples, samples)


def read_dense(spark: SparkSession, path: str, n_samples: int, samples: tuple[int, int] | None = None) -> DataFrame:
    """``marker_idx, payload`` of doubles, of all samples or of those from one to before another."""
    return _matrix(spark, "dense", path, n_samples, samples)


def write_matrix(packed: DataFrame, kind: str, path: str) -> None:
    """``marker_idx, payload`` rows, numbered from 0 without gaps, as one ``bed`` or ``dense`` file, written
    in parallel by ranges of markers."""
    register(packed.sparkSession)
    packed.select("marker_idx", "payload").orderBy("marker_idx").write.format(kind).mode("append").option("path", path).save()


def read_vector(spark: SparkSession, path: str, start: int = 0, count: int | None = None) -> DataFrame:
    """``idx, value`` of a binary vector, or of a stretch of it with its own count from 0, which alone
    is read."""
    register(spark)
    whole = spark.read.format("vector").option("path", path).load()
    if start == 0 and count is None:
        return whole
    part = whole.where(F.col("idx") >= start)
    part = part if count is None else part.where(F.col("idx") < start + count)
    return part.select((F.col("idx") - start).alias("idx"), "value")


def write_vector(values: DataFrame, path: str) -> None:
    """``idx, value`` rows as one binary file, written in parallel by ranges of ``idx``."""
    register(values.sparkSession)
    ordered = values.select("idx", F.col("value").cast("double").alias("value")).orderBy("idx")
    ordered.write.format("vector").mode("append").option("path", path).save()


def _numbered(spark: SparkSession, path: str, items) -> DataFrame:
    """``idx, item``: what ``items`` makes of each line of a text file, or of a folder's files in the
    order of their names, numbered from 0.  Spark deals files to tasks by their size, so numbers
    follow from where a block of a file stands and from the counts of the blocks before it, which
    come to the driver: two numbers a block."""
    block = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    rows = spark.read.text(path).select(*block, F.explode(items(F.col("value"))).alias("item"))
    counts = sorted((r["file"], r["at"], r["count"]) for r in rows.groupBy("file", "at").count().collect())
    ends = np.cumsum([0, *(n for *_, n in counts)]).tolist()
    shared = spark.sparkContext.broadcast({(f, a): k for (f, a, _), k in zip(counts, ends)})

    def number(batches):
        # a block is read by one task, in order
        following = dict(shared.value)
        for batch in batches:
            places = list(zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), strict=True))
            index = np.empty(len(places), np.int64)
            heads = [k for k in range(len(places)) if k == 0 or places[k] != places[k - 1]]
            for a, b in zip(heads, [*heads[1:], len(places)], strict=True):
                index[a:b] = following[places[a]] + np.arange(b - a)
                following[places[a]] += b - a
            yield pa.RecordBatch.from_arrays([pa.array(index), batch.column("item")], ["idx", "item"])

    return rows.mapInArrow(number, "idx long, item string")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``idx, tokens`` of a text file's lines in their order, blank ones left out."""
    table = _numbered(spark, path, lambda line: F.filter(F.array(line), lambda x: x.rlike(r"\S")))
    return table.select("idx", F.split(F.trim(F.translate("item", "\t\r", "  ")), r"\s+").alias("tokens"))


def read_phenotypes(spark: SparkSession, path: str) -> DataFrame:
    """``sample_idx, fid, iid, y`` of a phenotype file; NA is missing."""
    t = F.col("tokens")
    return lines(spark, path).select(
        F.col("idx").alias("sample_idx"), t[0].alias("fid"), t[1].alias("iid"), F.nullif(t[2], F.lit("NA")).cast("double").alias("y")
    )


def read_covariates(spark: SparkSession, path: str, n_covariates: int) -> DataFrame:
    """``sample_idx, z``; a line with another number of covariates is an error."""
    z = F.transform("tokens", lambda x: x.cast("double"))
    wrong = F.raise_error(F.lit(f"a line has not {n_covariates} covariates")).cast("array<double>")
    return lines(spark, path).select(F.col("idx").alias("sample_idx"), F.when(F.size("tokens") == n_covariates, z).otherwise(wrong).alias("z"))


def read_chromosomes(spark: SparkSession, path: str) -> DataFrame:
    """``marker_idx, chrom`` of an annotation file's first tokens."""
    return lines(spark, path).select(F.col("idx").alias("marker_idx"), chromosome_number(F.col("tokens")[0]).alias("chrom"))


def read_marker_ids(spark: SparkSession, path: str) -> DataFrame:
    """``marker_idx, marker_id`` of an annotation file's second tokens."""
    return lines(spark, path).select(F.col("idx").alias("marker_idx"), F.col("tokens")[1].alias("marker_id"))


def read_text_vector(spark: SparkSession, path: str, start: int = 0, count: int | None = None) -> DataFrame:
    """``idx, value`` of white-space separated numbers, or of a stretch of them."""
    # several numbers may share a line
    tokens = _numbered(spark, path, lambda line: F.filter(F.split(line, r"\s+"), lambda x: x != ""))
    whole = tokens.select("idx", F.col("item").cast("double").alias("value"))
    end = start + count if count is not None else None
    part = whole.where(F.col("idx") >= start) if end is None else whole.where((F.col("idx") >= start) & (F.col("idx") < end))
    return part.select((F.col("idx") - start).alias("idx"), "value")


def write_text_vector(values: DataFrame, path: str) -> None:
    """A value a line in order of ``idx``, in full precision."""
    values.orderBy("idx").select(F.col("value").cast("string")).write.mode("overwrite").text(path)


def write_estimates(estimates: DataFrame, path: str) -> None:
    """``it, marker_idx, beta`` as one dataset partitioned by iteration."""
    estimates.write.mode("append").partitionBy("it").parquet(path)


def read_estimates(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Estimates of the iterations from ``first`` to ``last``; other partitions aren't read."""
    whole = spark.read.parquet(path)
    whole = whole if first is None else whole.where(F.col("it") >= first)
    return whole if last is None else whole.where(F.col("it") <= last)


def write_bed(dosages: dict[int, np.ndarray] | list[np.ndarray], path: str) -> None:
    """A small packed file from markers' dosages (NaN: missing), as for tests and examples."""
    from ..operators.matrix import pack_dosages

    files, name = opened(path)
    with files.open_output_stream(name, compression=None) as out:
        out.write(BED_HEADER)
        for marker in dosages if isinstance(dosages, list) else dosages.values():
            out.write(pack_dosages(np.asarray(marker, float)))
