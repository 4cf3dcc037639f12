"""Statistics, standardisation and products of a matrix held as cells.

``cells`` have ``sample_idx, marker_idx, value`` (null: missing), ``pheno`` has ``sample_idx, y``
(null: missing).  A standardised cell is (value - mu) * isd, zero where the value is missing;
samples without a phenotype take no part.  Products are scaled by 1/sqrt(N).

Joins are left to Spark: sample- and marker-sized sides are broadcast while they are small and
sort-merged beyond that, and every aggregate is a partial one before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decode(packed: DataFrame, n_samples: int) -> DataFrame:
    """``marker_idx, payload`` of two-bit calls to ``marker_idx, sample_idx, dosage``.

    Codes, from the low bits of each byte: 0 is dosage 2, 1 missing, 2 dosage 1, 3 dosage 0.
    """
    byte = F.conv(F.hex(F.substring("payload", F.col("at") + 1, 1)), 16, 10).cast("int")
    code = F.expr("shiftright(byte, cast(2 * call AS int)) & 3")
    return (
        packed.select("marker_idx", "payload", F.explode(F.sequence(F.lit(0), F.octet_length("payload") - 1)).alias("at"))
        .select("marker_idx", "at", byte.alias("byte"))
        .select("marker_idx", "at", "byte", F.explode(F.array(*map(F.lit, range(4)))).alias("call"))
        .select("marker_idx", (4 * F.col("at") + F.col("call")).cast("long").alias("sample_idx"), code.alias("code"))
        .where(F.col("sample_idx") < n_samples)
        .select("marker_idx", "sample_idx", F.when(F.col("code") == 0, 2).when(F.col("code") == 2, 1).when(F.col("code") == 3, 0).alias("dosage"))
    )


def scaled_phenotype(pheno: DataFrame, center: bool = False) -> DataFrame:
    """y over its sample standard deviation; centred only if asked for."""
    known = pheno.agg(F.stddev_samp("y").alias("sd"), F.avg("y").alias("mean"))
    sd, mean = known.select("sd").scalar(), known.select("mean").scalar()
    y = (F.col("y") - mean) / sd if center else F.col("y") / sd
    return pheno.select("sample_idx", y.alias("y"))


def filled_phenotype(pheno: DataFrame) -> DataFrame:
    return pheno.select("sample_idx", F.coalesce("y", F.lit(0.0)).alias("y"))


def of_present(cells: DataFrame, pheno: DataFrame) -> DataFrame:
    """Cells of the samples with a phenotype, with it."""
    return cells.join(pheno.where("y IS NOT NULL"), "sample_idx")


def marker_stats(cells: DataFrame, pheno: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``marker_idx, mu, isd, n``: mean over the valid cells of present samples, inverse of the
    standard deviation to the power ``alpha`` and number of valid cells.

    The deviation's denominator is the number of present phenotypes less one for every marker,
    whatever its own missing cells; a marker without variance has isd 1.
    """
    present = pheno.agg(F.count("y").alias("n")).scalar()
    squares = F.var_pop("value") * F.count("value")
    return (
        of_present(cells, pheno)
        .groupBy("marker_idx")
        .agg(F.avg("value").alias("mu"), squares.alias("squares"), F.count("value").alias("n"))
        .select(
            "marker_idx", "mu",
            F.when(F.col("squares") > 0, F.pow(F.sqrt(F.col("squares") / (present - 1)), F.lit(-alpha))).otherwise(1.0).alias("isd"),
            "n",
        )
    )


def standardised(cells: DataFrame, stats: DataFrame, pheno: DataFrame | None = None) -> DataFrame:
    """Cells with ``z``, zero where the value is missing (and where the phenotype is, if given)."""
    z = F.coalesce((F.col("value") - F.col("mu")) * F.col("isd"), F.lit(0.0))
    joined = cells.join(stats.select("marker_idx", "mu", "isd"), "marker_idx")
    if pheno is not None:
        joined = joined.join(pheno.select("sample_idx", F.col("y").isNotNull().alias("present")), "sample_idx")
        z = F.when(F.col("present"), z).otherwise(0.0)
    return joined.select("sample_idx", "marker_idx", "value", z.alias("z"))


def sample_stats(cells: DataFrame, stats: DataFrame, pheno: DataFrame) -> DataFrame:
    """``sample_idx, n, mean_z, isd_z`` over the valid cells of each present sample."""
    return (
        standardised(of_present(cells, pheno).drop("y"), stats)
        .groupBy("sample_idx")
        .agg(
            F.count("value").alias("n"),
            F.avg(F.when(F.col("value").isNotNull(), F.col("z"))).alias("mean_z"),
            (1 / F.stddev_samp(F.when(F.col("value").isNotNull(), F.col("z")))).alias("isd_z"),
        )
    )


def at_x(cells: DataFrame, stats: DataFrame, u: DataFrame, n_samples: Column | int) -> DataFrame:
    """``marker_idx, value``: the transposed matrix times ``u`` (``sample_idx, u``), from two
    sums a marker: isd * (sum of value * u less mu * sum of u over valid cells)."""
    valid = F.col("value").isNotNull()
    return (
        cells.join(u, "sample_idx")
        .groupBy("marker_idx")
        .agg(F.sum(F.col("value") * F.col("u")).alias("vu"), F.sum(F.when(valid, F.col("u"))).alias("su"))
        .join(stats, "marker_idx")
        .select(
            "marker_idx",
            (F.coalesce(F.col("isd") * (F.col("vu") - F.col("mu") * F.col("su")), F.lit(0.0)) / F.sqrt(_number(n_samples))).alias("value"),
        )
    )


def a_x(cells: DataFrame, stats: DataFrame, x: DataFrame, n_samples: Column | int, pheno: DataFrame | None = None) -> DataFrame:
    """``sample_idx, value``: the matrix times ``x`` (``marker_idx, x``)."""
    return (
        standardised(cells, stats, pheno)
        .join(x, "marker_idx")
        .groupBy("sample_idx")
        .agg((F.sum(F.col("z") * F.col("x")) / F.sqrt(_number(n_samples))).alias("value"))
    )


def _number(n) -> Column:
    return n if isinstance(n, Column) else F.lit(float(n))


def covariate_effect(covariates: DataFrame, eta: list[float]) -> DataFrame:
    """``sample_idx, value``: each row of covariates times ``eta``."""
    products = F.zip_with("z", F.array(*map(F.lit, eta)), lambda a, b: a * b)
    return covariates.select("sample_idx", F.aggregate(products, F.lit(0.0), lambda a, b: a + b).alias("value"))


def regression_sums(cells: DataFrame, pheno: DataFrame) -> DataFrame:
    """``marker_idx, n, sx, sxx, sxy, sy, syy`` over valid cells of present samples."""
    v, y = F.col("value"), F.col("y")
    return (
        of_present(cells, pheno)
        .where("value IS NOT NULL")
        .groupBy("marker_idx")
        .agg(
            F.count("*").alias("n"), F.sum(v).alias("sx"), F.sum(v * v).alias("sxx"),
            F.sum(v * y).alias("sxy"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"),
        )
    )


def t_statistic() -> Column:
    """Student's t of a simple regression's slope, from its sums; null without variance."""
    n, sx, sxx, sxy, sy, syy = map(F.col, ("n", "sx", "sxx", "sxy", "sy", "syy"))
    r = F.try_divide(n * sxy - sx * sy, F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))
    return r * F.sqrt(F.try_divide(n - 2, 1 - r * r))
