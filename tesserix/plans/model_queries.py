"""Queries of the solvers, models, generators and sources."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells as op, models, simulate, solvers
from ..operators.markers import ClusterMarkers
from ..operators.matrix import MarkerMatrix
from ..operators.prior import Prior
from ..sources import genomics
from . import workloads as w
from .association_queries import DENSE, _ATY, _DOSAGE, _r, packed_dosages, rounded
from .session import shared_folder

TAU, GAMMA = 1.5, 0.8


def _matrix(spark, d) -> tuple[MarkerMatrix, np.ndarray]:
    """The dense workload and its scaled phenotype."""
    cells, pheno = w.dense(spark, d), w.dense_phenotype(spark, d)
    matrix = MarkerMatrix.from_cells(cells, pheno)
    return matrix, _in_order(op.scaled_phenotype(pheno))


def _in_order(pheno: DataFrame) -> np.ndarray:
    """``y`` of a phenotype table by sample, NaN where missing."""
    return pheno.orderBy("sample_idx").select(F.col("y").cast("double")).toArrow()["y"].to_numpy(zero_copy_only=False).copy()


def _by_marker(spark: SparkSession, values: np.ndarray, name: str) -> DataFrame:
    return rounded(spark.createDataFrame([(j, float(v)) for j, v in enumerate(values)], f"marker_idx long, {name} double"))


def _one(spark: SparkSession, name: str, value: float) -> DataFrame:
    return rounded(spark.createDataFrame([(float(value),)], f"{name} double"))


def _probe(m: int) -> np.ndarray:
    """Signs from the parity of triangular numbers, which any engine can tell."""
    j = np.arange(m)
    return (1.0 - 2.0 * ((j * (j + 1) // 2) % 2)) / np.sqrt(m)


def lmmse_apply(spark, d):
    matrix, _ = _matrix(spark, d)
    return _by_marker(spark, solvers.normal_operator(matrix, TAU, GAMMA)(1 / (1.0 + np.arange(matrix.n_markers))), "value")


def cg_step_k(spark, d):
    """Two rounds of conjugate gradients for A'y."""
    matrix, y = _matrix(spark, d)
    b = matrix.transpose_times(y)
    mu, _ = solvers.conjugate_gradient(
        solvers.normal_operator(matrix, TAU, GAMMA), b, solvers.marker_diagonal(matrix, TAU, GAMMA), rounds=2, tolerance=0.0
    )
    return _by_marker(spark, mu, "mu")


def lmmse_sample_space(spark, d):
    """x2 by way of samples after one round, with r2 a tenth of A'y."""
    matrix, y = _matrix(spark, d)
    x2, _ = solvers.lmmse_by_samples(matrix, TAU, GAMMA, y, matrix.transpose_times(y) / 10, rounds=1)
    return _by_marker(spark, x2, "x2")


def rademacher_trace(spark, d):
    """gamma <b, Q^-1 b> after two rounds for a vector of signs."""
    matrix, _ = _matrix(spark, d)
    b = _probe(matrix.n_markers)
    x, _ = solvers.conjugate_gradient(
        solvers.normal_operator(matrix, TAU, GAMMA), b, solvers.marker_diagonal(matrix, TAU, GAMMA), rounds=2, tolerance=0.0
    )
    return _one(spark, "alpha2", GAMMA * b @ x)


def noise_precision_update(spark, d):
    """gamma_w after x = A'y / 10, with b over the operator's diagonal for the solved probe."""
    matrix, y = _matrix(spark, d)
    b = _probe(matrix.n_markers)
    both = matrix.times(np.stack([matrix.transpose_times(y) / 10, b, b / solvers.marker_diagonal(matrix, TAU, GAMMA)], axis=1))
    error = float(((both[:, 0] - y) ** 2).sum())
    return _one(spark, "gamw", matrix.n_samples / (error + matrix.n_markers * float(both[:, 1] @ both[:, 2])))


_START = Prior((0.6, 0.3, 0.1), (0.0, 1e-3, 1e-2))


def _estimates(spark, fit: models.Fit) -> DataFrame:
    return fit.table(spark).select("it", "marker_idx", "beta")


def linear_fit_k(spark, d):
    matrix, y = _matrix(spark, d)
    return _estimates(spark, models.fit(matrix, y, _START, models.Options(iterations=3)))


def cg_step_on_cluster(spark, d):
    """The two rounds of :func:`cg_step_k` with its vectors as columns of a table."""
    matrix, y = _matrix(spark, d)
    vectors = ClusterMarkers(matrix)
    vectors.transpose_times("b", y)
    vectors.conjugate_gradient(TAU, GAMMA, [("mu", "b", None)], rounds=2, tolerance=0.0)
    return rounded(vectors.table.select("marker_idx", "mu"))


def cluster_fit_k(spark, d):
    """A fit whose vectors of markers never are on the driver."""
    matrix, y = _matrix(spark, d)
    return _estimates(spark, models.fit(matrix, y, _START, models.Options(iterations=2, cg_rounds=8), on_cluster=True))


def linear_fit_by_samples(spark, d):
    matrix, y = _matrix(spark, d)
    return _estimates(spark, models.fit(matrix, y, _START, models.Options(iterations=3, by_samples=True)))


def probit_fit_k(spark, d):
    matrix, _ = _matrix(spark, d)
    y = _in_order(w.dense_phenotype(spark, d))
    y = np.where(np.isnan(y), np.nan, y >= 5)
    return _estimates(spark, models.fit(matrix, y, _START, models.Options(model="bin_class", iterations=3)))


def robust_fit_k(spark, d):
    matrix, y = _matrix(spark, d)
    return _estimates(spark, models.fit(matrix, y, _START, models.Options(model="robust", iterations=3, delta=1.0)))


def probit_covariate_fit(spark, d):
    eta = models.probit_covariates_of(w.covariates(spark, d), 3)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(eta)], "c int, eta double")


def parts(spark, d) -> int:
    """The markers of simulations: as many as there are parts."""
    return w.table(spark, d, "part").count()


def simulate_mixture(spark, d):
    return rounded(simulate.mixture(spark, parts(spark, d), Prior((0.7, 0.2, 0.1), (0.0, 0.5, 4.0))))


def simulate_linear(spark, d):
    """A phenotype of heritability 0.5 over the dense workload."""
    cells, pheno = w.dense(spark, d), w.dense_phenotype(spark, d)
    n = pheno.agg(F.count("*").alias("n")).scalar().cast("double")
    effects = simulate.sparse_effects(spark, 64, 8, 0.5).select(F.col("idx").alias("marker_idx"), (F.col("value") * F.sqrt(n)).alias("x"))
    return simulate.linear_phenotype(op.a_x(cells, op.marker_stats(cells, pheno), effects, n), 0.5)


def new_file(spark: SparkSession) -> str:
    """The path of a new file or folder in the folder that all machines share."""
    path = f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"
    files, name = genomics.opened(path)
    files.create_dir(name.rpartition("/")[0], recursive=True)
    return path


def written_lines(spark: SparkSession, table: DataFrame, order: str, line) -> str:
    """A folder of text files with a line a row of ``table`` in order."""
    path = new_file(spark)
    table.orderBy(order).select(line.alias("value")).write.text(path)
    return path


def scan_bed(spark, d):
    """Calls of the dosages written as a packed file, of which markers 8 to 23 are read."""
    cells, path = w.dosage(spark, d), new_file(spark)
    n = cells.agg(F.max("sample_idx") + 1).first()[0]
    genomics.write_matrix(packed_dosages(cells), "bed", path)
    return op.decode(genomics.read_bed(spark, path, n).where(F.col("marker_idx").between(8, 23)), n)


def scan_phen(spark, d):
    table = w.dosage_phenotype(spark, d)
    line = F.concat_ws(" ", F.concat(F.lit("f"), "sample_idx"), F.concat(F.lit("i"), "sample_idx"), F.coalesce(F.col("y").cast("string"), F.lit("NA")))
    return genomics.read_phenotypes(spark, written_lines(spark, table, "sample_idx", line))


def annotation(spark, d) -> str:
    """An annotation file with a marker for each part, on chromosomes 1 to 22, X and MT."""
    key = F.col("p_partkey")
    chrom = F.when(key % 29 == 0, "MT").when(key % 23 == 0, "X").otherwise((1 + key % 22).cast("string"))
    line = F.concat_ws(" ", chrom, F.concat(F.lit("rs"), key), F.lit("0"), key.cast("string"), F.lit("A G"))
    return written_lines(spark, w.table(spark, d, "part"), "p_partkey", line)


def scan_bim(spark, d):
    return genomics.read_chromosomes(spark, annotation(spark, d))


def covariate_file(spark, d) -> str:
    """A line of an intercept, the length and whether it is English for each labelled document."""
    docs = w.table(spark, d, "documents").join(w.table(spark, d, "labels"), "doc_id")
    line = F.concat_ws("\t", F.lit("1"), F.col("n_chars").cast("string"), (F.col("lang") == "en").cast("int").cast("string"))
    return written_lines(spark, docs, "doc_id", line)


def scan_cov(spark, d):
    return genomics.read_covariates(spark, covariate_file(spark, d), 3)


def scan_f64(spark, d):
    """Values 100 to 299 of a binary vector."""
    path = new_file(spark)
    genomics.write_vector(w.dense(spark, d).where("marker_idx = 0").select(F.col("sample_idx").alias("idx"), "value"), path)
    return genomics.read_vector(spark, path, 100, 200)


# -- oracles: the operator as a dense matrix q of markers by markers, and two rounds spelt out
_Q = """, k AS (SELECT x.m AS i, y.m AS j, sum(x.a * y.a) AS g FROM a x JOIN a y USING (s) GROUP BY 1, 2)
, nn AS (SELECT count(*) AS n FROM p), mm AS (SELECT count(*) AS mt FROM st)
, q AS (SELECT i, j, 1.5 * g + CASE WHEN i = j THEN 0.8 ELSE 0 END AS q FROM k)
, dg AS (SELECT 1.5 * (n - 1) / n + 0.8 AS dg FROM nn)"""


def _cg_sql(b: str) -> str:
    return DENSE + _ATY + _Q + f""", b AS ({b})
, p0 AS (SELECT m, b / dg AS p, b AS r FROM b, dg), ap0 AS (SELECT i AS m, sum(q * p) AS ap FROM q JOIN p0 ON j = p0.m GROUP BY i)
, s0 AS (SELECT sum(r * r) / max(dg) AS rz, sum(r * r) / max(dg) / sum(p * ap) AS step FROM p0 JOIN ap0 USING (m), dg)
, x1 AS (SELECT m, step * p AS x, r - step * ap AS r, p, rz FROM p0 JOIN ap0 USING (m), s0)
, b1 AS (SELECT sum(r * r) / max(dg) AS rz1, sum(r * r) / max(dg) / max(rz) AS beta FROM x1, dg)
, p1 AS (SELECT m, x, r, r / dg + beta * p AS p FROM x1, b1, dg), ap1 AS (SELECT i AS m, sum(q * p) AS ap FROM q JOIN p1 ON j = p1.m GROUP BY i)
, s1 AS (SELECT max(rz1) / sum(p * ap) AS step FROM p1 JOIN ap1 USING (m), b1)
, sol AS (SELECT m, x + step * p AS mu FROM p1, s1)"""


def _uniform(index: str, stream: int) -> str:
    return f"((CAST('0x' || substr(md5({index} || ':1:{stream}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)"


def normal_sql(index: str, stream: int = 0) -> str:
    return f"(sqrt(-2 * ln({_uniform(index, 2 * stream + 1)})) * cos(2 * pi() * {_uniform(index, 2 * stream + 2)}))"


#: A number for each part, from 0 on, and how many there are.
PARTS = "(SELECT row_number() OVER () - 1 AS i, count(*) OVER () AS mt FROM part)"


def mixture_sql(shares: list[str], variances: list[str]) -> str:
    """Draws of a mixture; shares and variances may use ``mt``."""
    upto = [" + ".join(shares[: k + 1]) for k in range(len(shares))]
    cases = " ".join(f"WHEN u <= {p} THEN sqrt({v})" for p, v in zip(upto, variances, strict=True))
    return f"SELECT i AS idx, {_r(f'CASE {cases} ELSE 0 END * e')} AS value FROM (SELECT i, mt, {_uniform('i', 0)} AS u, {normal_sql('i')} AS e FROM {PARTS})"


_PROBE = "SELECT m, (1 - 2 * ((m * (m + 1) // 2) % 2)) / sqrt(mt) AS b FROM st, mm"

SQL = {
    "lmmse_apply": DENSE + _Q + f" SELECT i AS marker_idx, {_r('sum(q / (1.0 + j))')} AS value FROM q GROUP BY i",
    "cg_step_k": _cg_sql("SELECT m, r AS b FROM r") + f" SELECT m AS marker_idx, {_r('mu')} AS mu FROM sol",
    "cg_step_on_cluster": _cg_sql("SELECT m, r AS b FROM r") + f" SELECT m AS marker_idx, {_r('mu')} AS mu FROM sol",
    "rademacher_trace": _cg_sql(_PROBE) + f" SELECT {_r('0.8 * sum(mu * b)')} AS alpha2 FROM sol JOIN b USING (m)",
    "noise_precision_update": DENSE + _ATY + _Q + f""", b AS ({_PROBE}), f AS (
        SELECT s, sum(a * r / 10) AS z, sum(a * b) AS u, sum(a * b / dg) AS v FROM a JOIN r USING (m) JOIN b USING (m), dg GROUP BY s)
        SELECT {_r("max(n) / (sum(power(z - y, 2)) + max(mt) * sum(u * v))")} AS gamw FROM f JOIN ys USING (s), nn, mm""",
    "lmmse_sample_space": DENSE + _ATY + """, f AS (SELECT s, sum(a * r / 10) AS z FROM a JOIN r USING (m) GROUP BY s)
, t AS (SELECT s, y - z AS b FROM f JOIN ys USING (s)), dd AS (SELECT s, 1.5 * sum(a * a) + 0.8 AS dg FROM a GROUP BY s)
, p0 AS (SELECT s, b, b / dg AS p FROM t JOIN dd USING (s)), vv AS (SELECT m, sum(a * p) AS u FROM a JOIN p0 USING (s) GROUP BY m)
, ap AS (SELECT s, 1.5 * sum(a * u) AS ap FROM a JOIN vv USING (m) GROUP BY s)
, st0 AS (SELECT sum(b * p) / sum(p * (ap + 0.8 * p)) AS step FROM p0 JOIN ap USING (s))
""" + f" SELECT m AS marker_idx, {_r('r / 10 + 1.5 * step * u')} AS x2 FROM vv JOIN r USING (m), st0",
    "simulate_mixture": mixture_sql(["0.7", "0.2", "0.1"], ["0.0", "0.5", "4.0"]),
    "scan_bed": "WITH " + _DOSAGE + " SELECT m AS marker_idx, s AS sample_idx, CAST(v AS INTEGER) AS dosage FROM w2 WHERE m BETWEEN 8 AND 23",
    "scan_phen": "WITH " + _DOSAGE + " SELECT row_number() OVER (ORDER BY s) - 1 AS sample_idx, 'f' || s AS fid, 'i' || s AS iid, y FROM y2",
    "scan_bim": """SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS marker_idx,
        CAST(CASE WHEN p_partkey % 29 = 0 THEN 0 WHEN p_partkey % 23 = 0 THEN 23 ELSE 1 + p_partkey % 22 END AS INTEGER) AS chrom FROM part""",
    "scan_f64": """SELECT i - 100 AS idx, value FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, CAST(embedding[1] AS DOUBLE) AS value FROM embeddings)
        WHERE i BETWEEN 100 AND 299""",
}

QUERIES = {
    f.__name__: f
    for f in (
        lmmse_apply, cg_step_k, cg_step_on_cluster, cluster_fit_k, lmmse_sample_space, rademacher_trace, noise_precision_update, linear_fit_k, linear_fit_by_samples,
        probit_fit_k, robust_fit_k, probit_covariate_fit, simulate_mixture, simulate_linear, scan_bed, scan_phen, scan_bim,
        scan_cov, scan_f64,
    )
}
