"""Queries of packed matrices, generators, sinks and the sources that need a written file."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import association, cells as op, evaluate, simulate
from ..operators.cell_tables import CellTables
from ..operators.matrix import MarkerMatrix, unpacked
from ..operators.prior import Prior
from ..sources import genomics
from . import association_queries as base, workloads as w
from .association_queries import _r, rounded
from .model_queries import PARTS, _by_marker, _matrix, annotation, covariate_file, mixture_sql, new_file, normal_sql, parts, written_lines
from .session import shared_folder


def _by_sample(spark: SparkSession, ids: list[int], values: np.ndarray) -> DataFrame:
    return rounded(spark.createDataFrame([(s, float(v)) for s, v in zip(ids, values, strict=True)], "sample_idx long, value double"))


def packed_at_x(spark, d):
    matrix, y = _matrix(spark, d)
    return _by_marker(spark, matrix.transpose_times(y), "value")


def packed_a_x(spark, d):
    matrix, _ = _matrix(spark, d)
    return _by_sample(spark, matrix.sample_ids, matrix.times(1 / (1.0 + np.arange(matrix.n_markers))))


def _of_tables(spark, d, product) -> DataFrame:
    """A product over bucketed cells, whose tables are dropped once it is written."""
    cells, pheno = w.dense(spark, d), w.dense_phenotype(spark, d)
    shared_folder(spark)
    tables = CellTables(cells, pheno, 8)
    try:
        return rounded(product(tables, op.scaled_phenotype(pheno)).checkpoint())
    finally:
        tables.drop()


def bucketed_at_x(spark, d):
    return _of_tables(spark, d, lambda tables, y: tables.at_x(y.select("sample_idx", F.col("y").alias("u"))))


def bucketed_a_x(spark, d):
    x = w.dense(spark, d).select("marker_idx").distinct().select("marker_idx", (1 / (F.col("marker_idx") + 1.0)).alias("x"))
    return _of_tables(spark, d, lambda tables, y: tables.a_x(x))


def gram(spark, d):
    """A'A of all pairs of markers, the upper triangle."""
    return rounded(_matrix(spark, d)[0].gram())


def packed_subrange_product(spark, d):
    """Samples 100 to 299 only, scaled by their number, cut out of the payloads."""
    matrix, y = _matrix(spark, d)
    return _by_marker(spark, matrix.sample_range(100, 300).transpose_times(y[100:300]), "value")


def _calls(spark, d) -> tuple[MarkerMatrix, np.ndarray, np.ndarray]:
    """The dosages in two-bit calls, the residual that a tenth of A'y leaves, and those effects."""
    cells, pheno = w.dosage(spark, d), w.dosage_phenotype(spark, d)
    y = np.array([r[0] for r in op.scaled_phenotype(pheno).orderBy("sample_idx").select("y").toLocalIterator()], float)
    matrix = MarkerMatrix(base.packed_dosages(cells), "bed", ~np.isnan(y))
    y = np.nan_to_num(y)
    x = matrix.transpose_times(y) / 10
    return matrix, (y - matrix.times(x))[:, None], x[:, None]


def packed_loo_ttest(spark, d):
    return rounded(association.packed_leave_one_out(*_calls(spark, d)).drop("it"), 5)


def packed_loco_ttest(spark, d):
    matrix, residual, x = _calls(spark, d)
    chrom = np.arange(matrix.n_markers) // w.CHROMOSOME + 1
    return rounded(association.packed_leave_one_chromosome_out(matrix, residual, x, chrom).drop("it"), 5)


def unpack_calls(spark, d):
    cells = w.dosage(spark, d)
    n = cells.agg(F.max("sample_idx") + 1).first()[0]
    return unpacked(base.packed_dosages(cells), "bed", n)


def simulate_sparse(spark, d):
    """A tenth of the markers has effects."""
    m = parts(spark, d)
    return rounded(simulate.sparse_effects(spark, m, m // 10, 0.5))


def simulate_heavy_tails(spark, d):
    m = parts(spark, d)
    return rounded(simulate.heavy_tailed_effects(spark, m, m // 10, 0.5))


def simulate_rescaled(spark, d):
    return rounded(simulate.rescaled_effects(spark, parts(spark, d), Prior((0.8, 0.2), (0.0, 3.0)), 0.5))


def simulate_dense_cells(spark, d):
    """Cells of 20 markers, a sample for each part."""
    return rounded(simulate.dense_cells(spark, parts(spark, d), 20))


def simulate_phenotype(spark, d):
    """A phenotype of heritability 0.5 whose signal is the first component of each vector."""
    signal = w.dense(spark, d).where("marker_idx = 0").select("sample_idx", "value")
    return rounded(simulate.linear_phenotype(signal, 0.5))


def signal_variances(spark, d):
    signal = w.dense(spark, d).where("marker_idx = 0").select("sample_idx", "value")
    return rounded(simulate.variances(signal, w.dense_phenotype(spark, d)))


def scan_dense(spark, d):
    """Cells written as a dense file, of which samples 40 to 119 of the first 32 markers are read."""
    matrix, _ = _matrix(spark, d)
    path, ids = new_file(spark), matrix.sample_ids
    genomics.write_matrix(matrix.whole().rows, "dense", path)
    return unpacked(genomics.read_dense(spark, path, len(ids), (40, 120)).where("marker_idx < 32"), "dense", 80)


def scan_text_vector(spark, d):
    """Values 1 to 200 of a vector written as text, three in a line."""
    lines = _component(spark, d).groupBy(F.floor(F.col("idx") / 3).alias("at")).agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("v"))
    path = written_lines(spark, lines, "at", F.array_join(F.transform("v", lambda x: x["value"].cast("string")), " "))
    return genomics.read_text_vector(spark, path, 1, 200)


def scan_covariate_cells(spark, d):
    table = genomics.read_covariates(spark, covariate_file(spark, d), 3)
    return table.select("sample_idx", F.posexplode("z").alias("c", "value"))


def scan_marker_ids(spark, d):
    return genomics.read_marker_ids(spark, annotation(spark, d))


def _component(spark, d) -> DataFrame:
    return w.dense(spark, d).where("marker_idx = 0").select(F.col("sample_idx").alias("idx"), "value")


def sink_vector(spark, d):
    """A vector written as a binary file and read back."""
    path = new_file(spark)
    genomics.write_vector(_component(spark, d), path)
    return genomics.read_vector(spark, path)


def sink_text_vector(spark, d):
    """A vector written as text and read back."""
    path = new_file(spark)
    genomics.write_text_vector(_component(spark, d), path)
    return genomics.read_text_vector(spark, path)


def estimates_of_iterations(spark, d):
    """Estimates written by iteration, of which the last two are read."""
    path = new_file(spark)
    beta = _component(spark, d).select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("it"), F.col("idx").alias("marker_idx"), "value")
    genomics.write_estimates(beta.select("it", "marker_idx", (F.col("value") * F.col("it")).alias("beta")), path)
    return rounded(genomics.read_estimates(spark, path, first=2).select(F.col("it").cast("int").alias("it"), "marker_idx", "beta"))


def estimates_by_id(spark, d):
    """Prices of parts as estimates, brought to markers with the ids of customers; what has no match is left out."""
    part, customer = w.table(spark, d, "part"), w.table(spark, d, "customer")
    fitted = part.select(F.col("p_partkey").alias("marker_idx"), F.concat(F.lit("rs"), "p_partkey").alias("marker_id"))
    tested = customer.select((F.col("c_custkey") * 2).alias("marker_idx"), F.concat(F.lit("rs"), F.col("c_custkey") * 3).alias("marker_id"))
    estimates = part.select(F.col("p_partkey").alias("marker_idx"), F.col("p_retailprice").alias("beta"))
    return evaluate.matched(estimates, fitted, tested)[0].select("marker_idx", "beta")


def unmatched_ids(spark, d):
    part, customer = w.table(spark, d, "part"), w.table(spark, d, "customer")
    fitted = part.select(F.col("p_partkey").alias("marker_idx"), F.concat(F.lit("rs"), "p_partkey").alias("marker_id"))
    tested = customer.select((F.col("c_custkey") * 2).alias("marker_idx"), F.concat(F.lit("rs"), F.col("c_custkey") * 3).alias("marker_id"))
    return evaluate.matched(fitted.select("marker_idx"), fitted, tested)[1]


_CAUSAL = "CAST(mt // 10 AS DOUBLE)"
_FIRST = "vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS value FROM embeddings"

SQL = {
    "packed_at_x": base.SQL["at_x"],
    "packed_a_x": base.SQL["a_x"],
    "bucketed_at_x": base.SQL["at_x"],
    "bucketed_a_x": base.SQL["a_x"],
    "gram": base.DENSE + f" SELECT x.m AS i, y.m AS j, {_r('sum(x.a * y.a)')} AS value FROM a x JOIN a y ON x.s = y.s AND x.m <= y.m GROUP BY 1, 2",
    "packed_subrange_product": base.SQL["sample_subrange_product"],
    "packed_loo_ttest": base.SQL["loo_ttest"],
    "packed_loco_ttest": base.SQL["loco_ttest"],
    "unpack_calls": "WITH " + base._DOSAGE + " SELECT m AS marker_idx, s AS sample_idx, v AS value FROM w2",
    "simulate_sparse": mixture_sql([f"1 - {_CAUSAL} / mt", f"{_CAUSAL} / mt"], ["0.0", f"0.5 / {_CAUSAL}"]),
    "simulate_heavy_tails": mixture_sql(
        [f"1 - {_CAUSAL} / mt", *(f"{_CAUSAL} / mt / {k}" for k in (2, 3, 6))], ["0.0", *(f"{k} * 6 * 0.5 / (123 * {_CAUSAL})" for k in (1, 10, 100))]
    ),
    "simulate_rescaled": mixture_sql(["0.8", "0.2"], ["0.0", "3.0 * 0.5 / (mt * 0.2 * 3.0)"]),
    "simulate_dense_cells": f"""SELECT CAST(k % mt AS BIGINT) AS sample_idx, CAST(k // mt AS BIGINT) AS marker_idx, {_r(normal_sql('k', 3))} AS value
        FROM (SELECT i + mt * j AS k, mt FROM {PARTS}, (SELECT unnest(range(20)) AS j))""",
    "simulate_phenotype": f"SELECT idx AS sample_idx, {_r(f'value + sqrt(0.5) * {normal_sql("idx", 7)}')} AS y FROM (SELECT {_FIRST})",
    "signal_variances": f"""SELECT {_r("var_samp(v)")} AS var_signal, {_r("var_samp(y)")} AS var_y, {_r("1 - sum(power(y - v, 2)) / (var_samp(y) * count(*))")} AS r2
        FROM (SELECT CAST(embedding[1] AS DOUBLE) AS v, CAST(label AS DOUBLE) AS y FROM embeddings)""",
    "scan_dense": "WITH " + base._CELLS + """, i AS (SELECT vec_id AS s, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings)
        SELECT m AS marker_idx, pos - 40 AS sample_idx, v AS value FROM w1 JOIN i USING (s) WHERE m < 32 AND pos BETWEEN 40 AND 119""",
    "scan_text_vector": f"SELECT idx - 1 AS idx, value FROM (SELECT {_FIRST}) WHERE idx BETWEEN 1 AND 200",
    "scan_covariate_cells": """SELECT s AS sample_idx, CAST(c AS INTEGER) AS c, CAST([1, n_chars, CASE WHEN lang = 'en' THEN 1 ELSE 0 END][c + 1] AS DOUBLE) AS value
        FROM (SELECT row_number() OVER (ORDER BY d.doc_id) - 1 AS s, n_chars, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id), (SELECT unnest(range(3)) AS c)""",
    "scan_marker_ids": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS marker_idx, 'rs' || p_partkey AS marker_id FROM part",
    "estimates_by_id": "SELECT c_custkey * 2 AS marker_idx, p_retailprice AS beta FROM customer JOIN part ON p_partkey = c_custkey * 3",
    "unmatched_ids": """SELECT 'rs' || (c_custkey * 3) AS marker_id, 'test' AS only_in FROM customer WHERE c_custkey * 3 NOT IN (SELECT p_partkey FROM part)
        UNION ALL SELECT 'rs' || p_partkey, 'fit' FROM part WHERE p_partkey NOT IN (SELECT c_custkey * 3 FROM customer)""",
    "sink_vector": f"SELECT {_FIRST}",
    "sink_text_vector": f"SELECT {_FIRST}",
    "estimates_of_iterations": f"""SELECT CAST(it AS INTEGER) AS it, idx AS marker_idx, {_r("value * it")} AS beta
        FROM (SELECT {_FIRST}), (SELECT unnest([2, 3]) AS it)""",
}

QUERIES = {
    f.__name__: f
    for f in (
        packed_at_x, packed_a_x, bucketed_at_x, bucketed_a_x, gram, packed_subrange_product, packed_loo_ttest, packed_loco_ttest, unpack_calls, simulate_sparse, simulate_heavy_tails,
        simulate_rescaled, simulate_dense_cells, simulate_phenotype, signal_variances, scan_dense, scan_text_vector,
        scan_covariate_cells, scan_marker_ids, estimates_by_id, unmatched_ids, sink_vector, sink_text_vector, estimates_of_iterations,
    )
}
