"""Sample-by-feature workloads derived from the driver's tables.

A cell table has ``sample_idx, marker_idx, value`` (null: missing); a phenotype table has
``sample_idx, y`` (null: missing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Markers of a chromosome in the derived workloads.
CHROMOSOME = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding components as cells."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(
        F.col("vec_id").alias("sample_idx"), F.posexplode("embedding").alias("marker_idx", "element")
    ).select("sample_idx", F.col("marker_idx").cast("long").alias("marker_idx"), F.col("element").cast("double").alias("value"))


def dense_phenotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_idx"), F.col("label").cast("double").alias("y"))


def dosage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding components cut into dosages 0, 1, 2; every fiftieth cell is missing."""
    cells = dense(spark, sf_dir)
    cut = F.when(F.col("value") < -0.06, 0.0).when(F.col("value") <= 0.06, 1.0).otherwise(2.0)
    missing = (7 * F.col("sample_idx") + F.col("marker_idx")) % 50 == 0
    return cells.select("sample_idx", "marker_idx", F.when(~missing, cut).alias("value"))


def dosage_phenotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label, missing for every 37th sample."""
    y = dense_phenotype(spark, sf_dir)
    return y.select("sample_idx", F.when(F.col("sample_idx") % 37 != 0, F.col("y")).alias("y"))


def chromosomes(cells: DataFrame) -> DataFrame:
    """``marker_idx, chrom`` of the markers of a cell table."""
    return cells.select("marker_idx").distinct().select(
        "marker_idx", (F.floor(F.col("marker_idx") / CHROMOSOME) + 1).cast("int").alias("chrom")
    )


def relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by brands; the dosage is the number of line items, 2 at most, 0 without any."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("marker"))
    bought = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
        .join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(part, "l_partkey")
        .groupBy(F.col("o_custkey").alias("sample_idx"), "marker")
        .agg(F.least(F.count("*"), F.lit(2)).cast("double").alias("value"))
    )
    # a customer's row for each brand, from the fixed set of brands
    brands = part.agg(F.sort_array(F.collect_set("marker")).alias("brands"))
    grid = (
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_idx"))
        .withColumn("brands", brands.scalar())
        .select("sample_idx", F.posexplode("brands").alias("marker_idx", "marker"))
    )
    return grid.join(bought, ["sample_idx", "marker"], "left").select(
        "sample_idx", F.col("marker_idx").cast("long").alias("marker_idx"), "marker", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def relational_phenotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_idx"), F.col("c_acctbal").alias("y"))


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_idx, z, y``: an intercept, the logarithm of the length and whether it is
    English, with the documents' quality."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    z = F.array(F.lit(1.0), F.log(F.col("n_chars") + 1.0), (F.col("lang") == "en").cast("double"))
    return docs.select(F.col("doc_id").alias("sample_idx"), z.alias("z"), F.col("quality").cast("double").alias("y"))
