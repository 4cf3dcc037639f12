"""A sample-by-marker matrix kept packed on the cluster, and its products.

A row holds one marker's samples of one segment: their payload (two-bit calls or doubles) with the
marker's mean and inverse standard deviation.  Matrices of cells have segments of a bounded number of
samples, so no row and no group grows with the samples; those of files have one segment.  Payloads
stay packed in memory and are decoded in NumPy a bounded number of bytes at a time, where a slice of
markers times a vector (or several at once) is one BLAS call.  Vectors of samples or markers live on
the driver, as the solvers need them there: they grow with one side of the matrix only.  Rows of several
segments are joined with their own part of a long vector of samples, so that no Python worker has all of it.

``transpose_times`` is a narrow map.  ``times`` adds up what each task makes of its markers; those
partial vectors are summed segment by segment in two rounds, so that no group holds those of all
tasks.  Cells of few markers are dealt by segment, a whole one a task, and then it is narrow too.
"""

from __future__ import annotations

import copy
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples whose partial sums travel together.
SEGMENT = 1 << 16
#: Bytes of decoded cells that a task holds at a time, with a few copies.
DECODED_BYTES = 32 << 20
#: Markers up to which a task gets whole segments, and cells of such a segment (2,048 samples at least).
SEGMENT_MARKERS, SEGMENT_CELLS = 2048, 1 << 20
#: Bytes of partial sums that a task holds before it passes them on.
PARTIAL_BYTES = 64 << 20
#: Bytes up to which vectors of samples are broadcast whole, as their rows needn't get longer then.
WHOLE_BYTES = 16 << 20

#: Dosage of each two-bit code (fixed values of the format): 2, missing, 1, 0.
_DOSAGE = np.array([2.0, np.nan, 1.0, 0.0])
_LUT = _DOSAGE[(np.arange(256)[:, None] >> (2 * np.arange(4))) & 3]


def unpack(payloads: pa.Array, kind: str, n_samples: int, first: int = 0) -> np.ndarray:
    """Markers by ``n_samples`` samples from ``first`` on; missing is NaN.  Only the bytes that hold
    these samples are decoded."""
    a, b = (first // 4, -(-(first + n_samples) // 4)) if kind == "bed" else (8 * first, 8 * (first + n_samples))
    if len(payloads) and (a or len(payloads[0].as_py()) != b):
        payloads = pc.binary_slice(payloads, a, b)
    raw = _bytes_of(payloads)
    if kind == "bed":
        packed, skipped = np.frombuffer(raw, np.uint8).reshape(len(payloads), b - a), first - 4 * a
        return _LUT[packed].reshape(len(payloads), 4 * (b - a))[:, skipped : skipped + n_samples]
    return np.frombuffer(raw, "<f8").reshape(len(payloads), n_samples)


def _bytes_of(payloads: pa.Array):
    """The bytes of payloads in a row, which Arrow has so, uncopied."""
    if not len(payloads) or payloads.null_count or not pa.types.is_binary(payloads.type):
        return b"".join(payloads.to_pylist())
    _, offsets, data = payloads.buffers()
    at = np.frombuffer(offsets, np.int32)[payloads.offset : payloads.offset + len(payloads) + 1]
    return memoryview(data)[at[0] : at[-1]] if data is not None else b""


def pack_dosages(dosages: np.ndarray) -> bytes:
    """Two-bit calls of one marker; NaN is missing."""
    code = np.where(np.isnan(dosages), 1, np.where(dosages == 2, 0, np.where(dosages == 1, 2, 3))).astype(np.uint8)
    code = np.append(code, np.zeros(-len(code) % 4, np.uint8)).reshape(-1, 4)
    return (code << (2 * np.arange(4, dtype=np.uint8))).sum(axis=1, dtype=np.uint8).tobytes()


def decoded_slices(batch: pa.RecordBatch, n_samples: int):
    """The batch in runs of markers whose decoded cells are of a bounded size."""
    step = max(1, DECODED_BYTES // (8 * max(1, n_samples)))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def unpacked(packed: DataFrame, kind: str, n_samples: int) -> DataFrame:
    """``marker_idx, sample_idx, value`` of packed markers; missing is null."""

    def run(batches):
        for batch in batches:
            for part in decoded_slices(batch, n_samples):
                values = unpack(part.column("payload"), kind, n_samples).ravel()
                index = np.repeat(part.column("marker_idx").to_numpy(), n_samples)
                samples = np.tile(np.arange(n_samples), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(samples), pa.array(values, from_pandas=True)], ["marker_idx", "sample_idx", "value"])

    return packed.select("marker_idx", "payload").mapInArrow(run, "marker_idx long, sample_idx long, value double")


class MarkerMatrix:
    """See the module.  ``present``: which samples have a phenotype; the others' cells are zero."""

    def __init__(self, packed: DataFrame, kind: str, present: np.ndarray, alpha: float = 1.0):
        """``packed`` has ``marker_idx, payload``; markers are numbered from 0 without gaps."""
        self._begin(packed.sparkSession, kind, present, len(present))
        shared, n = self.spark.sparkContext.broadcast(self.present), self.n_samples

        def with_stats(batches):
            here = shared.value
            for batch in (part for whole in batches for part in decoded_slices(whole, n)):
                v = unpack(batch.column("payload"), kind, n)[:, here]
                count = (~np.isnan(v)).sum(axis=1)
                mu = np.nansum(v, axis=1) / np.maximum(count, 1)
                squares = np.nansum((v - mu[:, None]) ** 2, axis=1)
                with np.errstate(divide="ignore"):
                    isd = np.where(squares > 0, (squares / max(1, here.sum() - 1)) ** (-alpha / 2), 1.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("marker_idx"), pa.array(np.zeros(len(mu), np.int32)), batch.column("payload"), pa.array(mu), pa.array(isd), pa.array(count.astype(np.int64))],
                    ["marker_idx", "segment", "payload", "mu", "isd", "n"],
                )

        schema = "marker_idx long, segment int, payload binary, mu double, isd double, n long"
        self.rows = packed.select("marker_idx", "payload").mapInArrow(with_stats, schema).persist(StorageLevel.MEMORY_AND_DISK)
        self.n_markers, self.n_partitions = self.rows.count(), self.rows._jdf.rdd().getNumPartitions()

    def _begin(self, spark: SparkSession, kind: str, present: np.ndarray, segment: int) -> None:
        """``segment``: how many samples one has.  ``by_segment``: whether tasks have whole ones."""
        self.spark, self.kind, self.present, self.first = spark, kind, np.asarray(present, bool), 0
        self.n_samples = self.n_all = len(self.present)
        self.segment, self.by_segment = max(1, segment), False
        #: Whether rows tell by themselves, as bits in ``here``, which samples of their segment are present.
        self.masked = False
        self._diagonal: np.ndarray | None = None

    @property
    def n_segments(self) -> int:
        return max(1, -(-self.n_all // self.segment))

    @property
    def sample_ids(self) -> list[int]:
        """Ids of the samples of a matrix of cells, in order."""
        return list(self.ids) if isinstance(self.ids, range) else self.ids.tolist()

    @classmethod
    def from_cells(cls, cells: DataFrame, pheno: DataFrame, alpha: float = 1.0) -> "MarkerMatrix":
        """Of a cell table whose samples are those of ``pheno``, in the order of their ids.

        Cells meet by marker and segment of samples.  Moments of these pieces are put together by marker.
        """
        table = pheno.select(F.col("sample_idx").cast("long"), F.col("y").isNotNull().alias("present")).orderBy("sample_idx").toArrow()
        ids, present = (table[c].to_numpy(zero_copy_only=False) for c in ("sample_idx", "present"))
        n, most = len(ids), cells.agg(F.max("marker_idx")).first()[0]
        few = most is not None and most < SEGMENT_MARKERS
        length = min(SEGMENT, max(2048, SEGMENT_CELLS // (most + 1))) if few else SEGMENT
        self = cls.__new__(cls)
        self._begin(cells.sparkSession, "dense", present, length)
        # ids in a row need no table of them
        known = self.ids = range(int(ids[0]), int(ids[-1]) + 1) if n and ids[-1] - ids[0] == n - 1 and (np.diff(ids) == 1).all() else ids
        shared = self.spark.sparkContext.broadcast((known, None if present.all() else self.present))

        def packed(key, table: pa.Table) -> pa.Table:
            (known, here), first = shared.value, key[0].as_py() * length
            own, values = known[first : first + length], np.full(len(known[first : first + length]), np.nan)
            samples = table["sample_idx"].to_numpy(zero_copy_only=False)
            at = samples - own[0] if isinstance(own, range) else np.searchsorted(own, samples) if len(own) else np.zeros(len(samples), int)
            inside = (at >= 0) & (at < len(own))
            if not inside.all() or not (isinstance(own, range) or (own[at] == samples).all()):
                raise ValueError("a cell's sample has no phenotype row")
            values[at] = table["value"].to_numpy(zero_copy_only=False)
            own_here = None if here is None else here[first : first + length]
            v = values if here is None else values[own_here]
            v = v[~np.isnan(v)]
            mean = v.mean() if len(v) else 0.0
            columns = {"marker_idx": [key[1].as_py()], "segment": [key[0].as_py()], "payload": [values.astype("<f8", copy=False).tobytes()]}
            columns["here"] = [None if here is None else np.packbits(own_here).tobytes()]
            return pa.table(columns | {"c": [len(v)], "m": [mean], "q": [((v - mean) ** 2).sum()]}).cast(pieces_schema)

        pieces_schema = pa.schema([("marker_idx", pa.int64()), ("segment", pa.int32()), ("payload", pa.binary()), ("here", pa.binary()), ("c", pa.int64()), ("m", pa.float64()), ("q", pa.float64())])
        dealt = cells.select("marker_idx", F.col("sample_idx").cast("long").alias("sample_idx"), "value", _segment_of(known, length).alias("segment"))
        dealt = dealt.repartition("segment") if few else dealt
        pieces = dealt.groupBy("segment", "marker_idx").applyInArrow(lambda key, t: packed(key, t), "marker_idx long, segment int, payload binary, here binary, c long, m double, q double")
        pieces = pieces.persist(StorageLevel.MEMORY_AND_DISK)
        moments = pieces.groupBy("marker_idx").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("m")).alias("cm"), F.sort_array(F.collect_list(F.struct("segment", "c", "m", "q"))).alias("parts"))
        moments = moments.withColumn("mu", F.coalesce(F.try_divide("cm", "n"), F.lit(0.0)))
        squares = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["q"] + p["c"] * (p["m"] - F.col("mu")) ** 2)
        scale = F.lit(float(max(1, present.sum() - 1)))
        stats = moments.select("marker_idx", "mu", squares.alias("squares"), "n").select(
            "marker_idx", "mu", F.when(F.col("squares") > 0, F.pow(F.col("squares") / scale, F.lit(-alpha / 2))).otherwise(1.0).alias("isd"), "n"
        ).persist()
        self.n_markers, self.by_segment, self.masked = stats.count(), few, True
        # few markers' statistics are known to be small
        joined = pieces.join(F.broadcast(stats) if few else stats, "marker_idx")
        self.rows = joined.select("marker_idx", "segment", "payload", "here", "mu", "isd", "n").persist(StorageLevel.MEMORY_AND_DISK)
        self.rows.count()
        self.n_partitions = self.rows._jdf.rdd().getNumPartitions()
        pieces.unpersist()
        stats.unpersist()
        return self

    def whole(self) -> "MarkerMatrix":
        """The same with one segment: a row has all samples of its marker, as tests of markers and files
        of a row a marker need it."""
        if self.n_segments == 1:
            return self
        if self.first or self.n_samples != self.n_all:
            raise ValueError("the whole matrix is asked for its segments in one")
        out, n, length = copy.copy(self), self.n_all, self.segment
        empty = lambda k: F.unhex(F.repeat(F.lit("000000000000F87F"), F.least(F.lit(length), F.lit(n) - k * length)))
        own = F.map_from_entries(F.collect_list(F.struct("segment", "payload")))
        rows = self.rows.groupBy("marker_idx").agg(own.alias("own"), F.first("mu").alias("mu"), F.first("isd").alias("isd"), F.first("n").alias("n"))
        payload = F.aggregate(F.sequence(F.lit(0), F.lit(self.n_segments - 1)), F.lit(b""), lambda a, k: F.concat(a, F.coalesce(F.try_element_at("own", k), empty(k))))
        out.rows = rows.select("marker_idx", F.lit(0).alias("segment"), payload.alias("payload"), "mu", "isd", "n")
        out.segment, out.by_segment, out.masked, out._diagonal = n, False, False, None
        return out

    def sample_range(self, start: int, end: int) -> "MarkerMatrix":
        """The same markers with the samples from ``start`` to before ``end`` alone.

        Rows and statistics are those of the whole matrix, and each payload is cut by bytes before
        it is decoded.  Products are scaled by the range's own number of samples.
        """
        if not 0 <= start < end <= self.n_samples:
            raise ValueError(f"no samples {start} to {end} of {self.n_samples}")
        part = copy.copy(self)
        part._diagonal = None
        part.first, part.n_samples, part.present = self.first + start, end - start, self.present[start:end]
        return part

    def _shared(self, x: np.ndarray):
        """A broadcast of ``x`` and of which samples are present, if rows don't tell."""
        return self.spark.sparkContext.broadcast((np.ascontiguousarray(x), None if self.masked else self.present))

    def beside(self, u: np.ndarray):
        """The rows of the range, a broadcast as :meth:`_shared` has it, and a function that finds the part
        of ``u``, samples by columns, that a slice needs: from the slice, where its samples begin and
        how many they are.

        Where ``u`` is long, rows of several segments have it in a column ``own``, so what a task holds doesn't grow with the samples.
        """
        if self.n_segments == 1 or u.nbytes <= WHOLE_BYTES:
            shared = self._shared(u)
            return self.in_range(), shared, lambda part, at, size: shared.value[0][at : at + size]
        first, length, n, width = self.first, self.segment, self.n_samples, u.shape[1]
        segments = range(first // length, (first + n - 1) // length + 1)
        cuts = [u[max(0, s * length - first) : (s + 1) * length - first].tobytes() for s in segments]
        parts = self.spark.createDataFrame(pa.table({"segment": pa.array(segments, pa.int32()), "own": pa.array(cuts, pa.binary())}))
        # the payloads stay where they are
        rows = self.in_range().join(F.broadcast(parts), "segment")
        return rows, self._shared(np.zeros(0)), lambda part, at, size: np.frombuffer(part.column("own")[0].as_buffer()).reshape(size, width)

    def partition_by_marker(self) -> None:
        """Markers hashed over partitions and sorted in them, once, so that tables of markers are
        brought to them without the payloads moving."""
        if not getattr(self, "by_marker", False):
            before, self.by_segment = self.rows, False
            # segments may be in fewer partitions than markers are worth
            dealt = max(self.n_partitions, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            ordered = before.repartition(dealt, "marker_idx").sortWithinPartitions("marker_idx")
            self.rows, self.by_marker = ordered.persist(StorageLevel.MEMORY_AND_DISK), True
            self.rows.count()
            self.n_partitions = self.rows._jdf.rdd().getNumPartitions()
            before.unpersist()

    def mapped(self, function, shared, schema: str, rows: DataFrame | None = None) -> DataFrame:
        """What ``function`` makes of each slice of markers: it gets the slice, its standardised
        cells (zero where missing), which of them are valid, and the broadcast ``shared``, whose
        last part tells which samples are present; it yields record batches.  ``rows``: some of the matrix's."""
        if self.n_segments > 1:
            raise ValueError("slices of markers have all samples; see whole")
        cut = self._cut()

        def run(batches):
            for part, _, z, valid in standardised_slices(batches, cut, shared.value[-1]):
                yield from function(part, z, valid, shared.value)

        return (self.rows if rows is None else rows).mapInArrow(run, schema)

    def _cut(self) -> tuple[str, int, int, int]:
        """The kind of payloads, the samples of a segment, and the first one and number of the range."""
        return self.kind, self.segment, self.first, self.n_samples

    def in_range(self, rows: DataFrame | None = None) -> DataFrame:
        """The rows (or those given) of segments with samples of the range."""
        rows = self.rows if rows is None else rows
        if self.n_samples == self.n_all or self.n_segments == 1:
            return rows
        return rows.where(F.col("segment").between(self.first // self.segment, (self.first + self.n_samples - 1) // self.segment))

    def transpose_times(self, u: np.ndarray) -> np.ndarray:
        """A'u / sqrt(N), one value a marker; ``u`` may have several columns."""
        wide, n, cut = u.reshape(self.n_samples, -1).astype(float, copy=False), self.n_samples, self._cut()
        (rows, shared, own), sums, width = self.beside(wide), self.n_markers if self.by_segment else 0, wide.shape[1]

        def run(batches):
            total = np.zeros((sums, width))
            for part, at, z, _ in standardised_slices(batches, cut, shared.value[1]):
                index, values = part.column("marker_idx").to_numpy(), z @ own(part, at, z.shape[1]) / np.sqrt(n)
                if sums:
                    total[index] += values
                else:
                    yield pa.RecordBatch.from_pydict({"markers": [index.tobytes()], "value": [values.tobytes()]})
            if sums:
                yield pa.RecordBatch.from_pydict({"markers": [np.arange(sums).tobytes()], "value": [total.tobytes()]})

        out = np.zeros((self.n_markers, width))
        # a row for each slice, or task with whole segments; slices come to the doubles of the result in each segment
        for row in rows.mapInArrow(run, "markers binary, value binary").collect():
            out[np.frombuffer(row[0], np.int64)] += np.frombuffer(row[1]).reshape(-1, width)
        shared.destroy()
        return out.reshape(self.n_markers, *u.shape[1:])

    def times(self, x: np.ndarray) -> np.ndarray:
        """A x / sqrt(N), one value a sample; ``x`` may have several columns."""
        wide = x.reshape(self.n_markers, -1)
        shared = self._shared(wide)
        product = lambda part, z, own: [(0, z.T @ own[0][part.column("marker_idx").to_numpy()])]
        out = self.summed(product, shared, wide.shape[1]).get(0, np.zeros((self.n_samples, wide.shape[1])))
        return out.reshape(self.n_samples, *x.shape[1:]) / np.sqrt(self.n_samples)

    def times_columns(self, table: DataFrame, names) -> np.ndarray:
        """A x / sqrt(N) of the columns ``names`` of a table by ``marker_idx``, samples by columns."""
        self.partition_by_marker()
        names, rows = list(names), self.rows.join(table.select("marker_idx", *names), "marker_idx")

        def product(part, z, _):
            return [(0, z.T @ np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1))]

        found = self.summed(product, self._shared(np.zeros(1)), len(names), rows)
        return found.get(0, np.zeros((self.n_samples, len(names)))) / np.sqrt(self.n_samples)

    def gram_times(self, u: np.ndarray) -> np.ndarray:
        """A A'u, in one pass if there is one segment: what lies between, a value a marker, stays in its task."""
        if self.n_segments > 1:
            return self.times(self.transpose_times(u))
        shared = self._shared(u.reshape(self.n_samples, -1))
        product = lambda part, z, own: [(0, z.T @ (z @ own[0]))]
        out = self.summed(product, shared, u.reshape(self.n_samples, -1).shape[1])
        return out.get(0, np.zeros((self.n_samples, 1))).reshape(u.shape) / self.n_samples

    def samples_step(self, p: np.ndarray, diagonal: np.ndarray, w: np.ndarray, tau: float, gamma: float) -> tuple[np.ndarray, np.ndarray]:
        """(q, A' (q / diagonal)) where q = tau A w + gamma p, in one pass: tasks need whole segments."""
        n, m, cut = self.n_samples, self.n_markers, self._cut()
        rows, shared, own = self.beside(np.stack([p, diagonal], axis=1))

        def run(batches):
            back = np.zeros(m)
            for index, at, z, part in whole_segments(batches, cut, shared.value[1]):
                own_p, own_d = own(part, at, z.shape[1]).T
                q = tau * (w[index] @ z) / np.sqrt(n) + gamma * own_p
                back[index] += z @ (q / own_d)
                yield pa.RecordBatch.from_pydict({"start": [at], "value": [q.tobytes()]})
            yield pa.RecordBatch.from_pydict({"start": [-1], "value": [back.tobytes()]})

        q, back, seen = gamma * p, np.zeros(m), set()
        for start, value in rows.mapInArrow(run, "start long, value binary").collect():
            part = np.frombuffer(value)
            if start < 0:
                back += part
            elif start in seen:
                raise RuntimeError("a segment's markers are in several tasks")
            else:
                seen.add(start)
                q[start : start + len(part)] = part
        shared.destroy()
        return q, back / np.sqrt(n)

    def gram(self) -> DataFrame:
        """``i, j, value``: A'A of few markers, the upper triangle, j >= i.

        Tasks with whole segments add up products of theirs.  Otherwise payloads are cut into segments, still
        packed, and a segment's markers meet in one task, which decodes some samples at a time; its products
        are summed over the segments.
        """
        kind, n, first, m, here = self.kind, self.n_samples, self.first, self.n_markers, self.present
        if self.by_segment:
            return self._gram_of_segments()
        # in fours, as packed payloads have them; M x M partial sums for each segment
        whole, length = self.segment, min(self.segment, 4 * max(1, SEGMENT // 4))
        shared = self.spark.sparkContext.broadcast(here)
        if kind == "bed" and first % 4:
            raise ValueError("a range of packed samples begins with a multiple of four here")

        def cut(batches):
            at = (lambda s: -(-s // 4)) if kind == "bed" else (lambda s: 8 * s)
            for batch in batches:
                segments = batch.column("segment").to_numpy()
                for s in np.unique(segments).tolist():
                    own, start = batch.filter(pa.array(segments == s)), max(first, s * whole)
                    for a in range(start, min(first + n, (s + 1) * whole), length):
                        b = min(first + n, (s + 1) * whole, a + length)
                        part = pc.binary_slice(own.column("payload"), at(a - s * whole), at(b - s * whole))
                        columns = [pa.array(np.full(own.num_rows, v)) for v in (a - first, b - first)]
                        yield pa.RecordBatch.from_arrays([*columns, own.column("marker_idx"), part, own.column("mu"), own.column("isd")], ["start", "end", "marker_idx", "payload", "mu", "isd"])

        def product(key, table: pa.Table) -> pa.Table:
            table = table.sort_by("marker_idx").combine_chunks()
            a, size, total = key[0].as_py(), key[1].as_py() - key[0].as_py(), np.zeros((table.num_rows, table.num_rows))
            step = 4 * max(1, DECODED_BYTES // (32 * max(1, m)))
            payload, mu, isd = table["payload"].combine_chunks(), table["mu"].to_numpy()[:, None], table["isd"].to_numpy()[:, None]
            for s in range(0, size, step):
                z = (unpack(payload, kind, min(step, size - s), s) - mu) * isd
                z[np.isnan(z) | ~shared.value[a + s : a + s + z.shape[1]]] = 0.0
                total += z @ z.T
            (i, j), index = np.triu_indices(table.num_rows), table["marker_idx"].to_numpy()
            return pa.table({"i": index[i], "j": index[j], "value": total[i, j] / n})

        pieces = self.in_range().mapInArrow(cut, "start long, end long, marker_idx long, payload binary, mu double, isd double")
        sums = pieces.groupBy("start", "end").applyInArrow(lambda key, t: product(key, t), "i long, j long, value double")
        return sums.groupBy("i", "j").agg(F.sum("value").alias("value"))

    def _gram_of_segments(self) -> DataFrame:
        n, m, cut, shared = self.n_samples, self.n_markers, self._cut(), self._shared(np.zeros(0))

        def run(batches):
            total = np.zeros((m, m))
            for index, _, z, _ in whole_segments(batches, cut, shared.value[1]):
                total[np.ix_(index, index)] += z @ z.T
            i, j = np.triu_indices(m)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j] / n)], ["i", "j", "value"])

        sums = self.in_range().mapInArrow(run, "i long, j long, value double")
        return sums.groupBy("i", "j").agg(F.sum("value").alias("value"))

    def sample_diagonal(self) -> np.ndarray:
        """Diagonal of A A': the squared norm of each sample's standardised cells over N."""
        if self._diagonal is None:
            squares = lambda part, z, own: [(0, (z**2).sum(axis=0)[:, None])]
            found = self.summed(squares, self._shared(np.zeros(1)), 1)
            self._diagonal = found.get(0, np.zeros((self.n_samples, 1)))[:, 0] / self.n_samples
        return self._diagonal

    def summed(self, function, shared, width: int, rows: DataFrame | None = None) -> dict[int, np.ndarray]:
        """Sums of sample vectors by a key: ``function`` makes (key, samples by ``width``) pairs of
        a slice, its standardised cells and ``shared``.  Few keys.  ``rows``: the matrix's, joined
        with other columns."""
        out: dict[int, np.ndarray] = {}
        for row in self._segments(function, shared, rows).collect():
            part = np.frombuffer(row["value"]).reshape(-1, width)
            own = out.setdefault(row["key"], np.zeros((self.n_samples, width)))
            own[row["start"] : row["start"] + len(part)] += part
        shared.destroy()
        return out

    def _segments(self, function, shared, rows: DataFrame | None) -> DataFrame:
        """The sums of :meth:`summed`, a row for each key and run of samples, which ``start`` numbers from
        the range's first one."""
        cut = self._cut()

        def passed_on(totals: dict, task: int):
            for (key, at), total in totals.items():
                for a in range(0, len(total), SEGMENT):
                    columns = {"key": [key], "start": [at + a], "task": [task], "value": [total[a : a + SEGMENT].tobytes()]}
                    yield pa.RecordBatch.from_pydict(columns)

        def run(batches):
            totals: dict[tuple[int, int], np.ndarray] = {}
            task = TaskContext.get().partitionId()
            for part, at, z, _ in standardised_slices(batches, cut, shared.value[-1]):
                for key, value in function(part, z, shared.value):
                    known = totals.get((key, at))
                    totals[key, at] = value if known is None else known + value
                # one segment's sums stay, however long it is
                if len(totals) > 1 and sum(t.nbytes for t in totals.values()) > PARTIAL_BYTES and cut[1] < cut[3]:
                    yield from passed_on(totals, task)
                    totals = {}
            yield from passed_on(totals, task)

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v) for v in table["value"].to_pylist())
            return pa.table({**{c: table[c][:1] for c in ("key", "start", "task")}, "value": [total.tobytes()]})

        schema = "key long, start long, task long, value binary"
        partial = self.in_range(rows).mapInArrow(run, schema)
        if self.by_segment and rows is None:
            return partial
        # a first round over as many tasks as the second has partial sums to add
        fan = math.isqrt(max(1, self.n_partitions - 1)) + 1
        if fan > 4:
            partial = partial.groupBy("key", "start", F.pmod("task", F.lit(fan)).alias("lot")).applyInArrow(lambda t: add(t), schema)
        return partial.groupBy("key", "start").applyInArrow(lambda t: add(t), schema)

    def scores(self, table: DataFrame, names) -> DataFrame:
        """``sample_idx, z``: A x / sqrt(N) of the columns ``names`` of a table by ``marker_idx``, as an
        array a sample; markers that the table lacks count as 0.  Nothing reaches the driver."""
        self.partition_by_marker()
        names, n = list(names), self.n_samples
        width, rows = len(names), self.rows.join(table.select("marker_idx", *names), "marker_idx", "left")

        def product(part, z, _):
            x = np.stack([part.column(c).fill_null(0.0).to_numpy(zero_copy_only=False) for c in names], axis=1)
            return [(0, z.T @ x / np.sqrt(n))]

        def spread(batches):
            for batch in batches:
                for start, value in zip(batch.column("start").to_pylist(), batch.column("value").to_pylist(), strict=True):
                    z = np.frombuffer(value)
                    index = np.arange(len(z) // width) + start
                    yield pa.RecordBatch.from_arrays([pa.array(index), pa.FixedSizeListArray.from_arrays(z, width).cast(pa.list_(pa.float64()))], ["sample_idx", "z"])

        return self._segments(product, self._shared(np.zeros(1)), rows).mapInArrow(spread, "sample_idx long, z array<double>")

    def unpersist(self) -> None:
        self.rows.unpersist()


def standardised_slices(batches, cut: tuple[str, int, int, int], here: np.ndarray | None):
    """Slices of markers in one segment, where its samples begin in the range that ``cut`` tells (see
    :meth:`MarkerMatrix._cut`), their standardised cells, zero where missing or not present, and which
    cells are valid.  ``here``: which samples of the range are present, if rows don't tell."""
    kind, length, first, n = cut
    for batch in batches:
        segments = batch.column("segment").to_numpy()
        for s in np.unique(segments).tolist():
            a, b = max(first, s * length), min(first + n, (s + 1) * length)
            if a >= b:
                continue
            inside = np.flatnonzero(segments == s)
            # a segment's rows in a row needn't be copied
            in_row = inside[-1] - inside[0] == len(inside) - 1
            for part in decoded_slices(batch.slice(inside[0], len(inside)) if in_row else batch.take(pa.array(inside)), b - a):
                z = unpack(part.column("payload"), kind, b - a, a - s * length) - part.column("mu").to_numpy()[:, None]
                z *= part.column("isd").to_numpy()[:, None]
                valid = ~np.isnan(z)
                if here is not None:
                    valid &= here[a - first : b - first]
                elif part.column("here")[0].is_valid:
                    valid &= np.unpackbits(np.frombuffer(part.column("here")[0].as_buffer(), np.uint8)).astype(bool)[a - s * length : b - s * length]
                z[~valid] = 0.0
                yield part, a - first, z, valid


def whole_segments(batches, cut: tuple[str, int, int, int], here: np.ndarray | None):
    """The markers of each segment, where its samples begin in the range, their standardised cells and a row
    of it, of rows that are in the order of their segments."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    before = row = None
    for part, at, z, _ in standardised_slices(batches, cut, here):
        if held and at != before:
            yield np.concatenate([i for i, _ in held]), before, np.concatenate([z for _, z in held]), row
            held = []
        held.append((part.column("marker_idx").to_numpy(), z))
        before, row = at, part.slice(0, 1)
    if held:
        yield np.concatenate([i for i, _ in held]), before, np.concatenate([z for _, z in held]), row


def _segment_of(ids, length: int) -> Column:
    """The segment of a cell's sample; of one that isn't known, the nearest."""
    sample, n = F.col("sample_idx"), -(-len(ids) // length)
    if n <= 1:
        return F.lit(0)
    if isinstance(ids, range):
        return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((sample - F.lit(ids[0])) / length))).cast("int")
    starts = ids[::length].tolist()

    def among(a: int, b: int) -> Column:
        middle = (a + b) // 2
        return F.lit(a) if b - a == 1 else F.when(sample < starts[middle], among(a, middle)).otherwise(among(middle, b))

    return among(0, n)
