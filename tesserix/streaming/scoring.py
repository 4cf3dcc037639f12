"""Scoring of samples that arrive as a stream of cells, with effects that were fitted before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score(cells: DataFrame, stats: DataFrame, effects: DataFrame, n_samples: int, gap: str = "10 minutes") -> DataFrame:
    """``sample_idx, value`` of a stream of ``ts, sample_idx, marker_idx, value`` cells.

    ``stats`` and ``effects`` are static tables by marker.  A sample's cells are one session as
    long as each comes within ``gap`` of event time after another, wherever the clock stands; once
    the watermark passes that, its score is final and its state is dropped.
    """
    static = stats.join(effects, "marker_idx").select("marker_idx", "mu", (F.col("isd") * F.col("x")).alias("weight"))
    term = F.coalesce((F.col("value") - F.col("mu")) * F.col("weight"), F.lit(0.0))
    return (
        cells.withWatermark("ts", gap)
        .join(static, "marker_idx")
        .groupBy(F.session_window("ts", gap), "sample_idx")
        .agg((F.sum(term) / F.sqrt(F.lit(float(n_samples)))).alias("value"))
        .select("sample_idx", "value")
    )
