"""Standardised cells kept bucketed, so that repeated products move vectors and not cells.

The cells are written twice, in buckets of markers and in buckets of samples, each sorted in them.  A
vector that Spark would broadcast (see ``spark.sql.autoBroadcastJoinThreshold``) meets the layout whose
buckets the result is grouped by, and nothing is exchanged.  A longer one is brought to the other
layout's buckets, and what is exchanged besides it are partial sums, one a task and row of the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import marker_stats, standardised

#: Bytes of a row of a vector, as Spark counts them.
_ROW_BYTES = 16


class CellTables:
    """Tables of ``marker_idx, sample_idx, z`` in the session's warehouse; :meth:`drop` deletes them."""

    def __init__(self, cells: DataFrame, pheno: DataFrame, buckets: int = 0):
        self.spark: SparkSession = cells.sparkSession
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        z = standardised(cells, marker_stats(cells, pheno), pheno).select("marker_idx", "sample_idx", "z")
        mark = uuid.uuid4().hex
        self.names = {side: f"cells_by_{side}_{mark}" for side in ("marker", "sample")}
        for side, other in (("marker", "sample"), ("sample", "marker")):
            # a file a bucket
            dealt = z.repartition(buckets, f"{side}_idx")
            dealt.write.bucketBy(buckets, f"{side}_idx").sortBy(f"{side}_idx", f"{other}_idx").format("parquet").saveAsTable(self.names[side])
        self.n = {side: pheno.count() if side == "sample" else self.table("marker").agg(F.count_distinct("marker_idx")).first()[0] for side in self.names}

    def table(self, side: str) -> DataFrame:
        return self.spark.table(self.names[side])

    def _product(self, vector: DataFrame, over: str, result: str) -> DataFrame:
        """``<result>_idx, value``: cells times a vector ``<over>_idx, x``, over the square root of the samples."""
        limit = self.spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        limit = int(limit.rstrip("b")) if limit.lstrip("-").rstrip("b").isdigit() else 10 << 20
        short = _ROW_BYTES * self.n[over] <= limit
        cells = self.table(result if short else over)
        # its size is known and checked
        vector = F.broadcast(vector) if short else vector
        value = F.sum(F.col("z") * F.col("x")) / F.sqrt(F.lit(float(self.n["sample"])))
        return cells.join(vector, f"{over}_idx").groupBy(f"{result}_idx").agg(value.alias("value"))

    def at_x(self, u: DataFrame) -> DataFrame:
        """A'u of ``sample_idx, u``."""
        return self._product(u.select("sample_idx", F.col("u").alias("x")), "sample", "marker")

    def a_x(self, x: DataFrame) -> DataFrame:
        """A x of ``marker_idx, x``."""
        return self._product(x.select("marker_idx", "x"), "marker", "sample")

    def drop(self) -> None:
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
