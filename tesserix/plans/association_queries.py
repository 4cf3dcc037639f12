"""Queries of the matrix, scalar and association operators, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, special
from ..operators import association, cells as op, evaluate, prior as em
from . import workloads as w

GAMMA = 2.0
PRIOR = em.Prior((0.7, 0.2, 0.1), (0.0, 0.5, 4.0))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns))


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


# -- the workloads in SQL: c (cells), p (phenotype), st (statistics), a (scaled standardised cells)
_CELLS = """
w1 AS (
  SELECT vec_id AS s, CAST(i - 1 AS BIGINT) AS m, CAST(embedding[i] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
), y1 AS (SELECT vec_id AS s, CAST(label AS DOUBLE) AS y FROM embeddings)"""
_DOSAGE = _CELLS + """, w2 AS (
  SELECT s, m, CAST(CASE WHEN (7 * s + m) % 50 = 0 THEN NULL WHEN v < -0.06 THEN 0 WHEN v <= 0.06 THEN 1 ELSE 2 END AS DOUBLE) AS v FROM w1
), y2 AS (SELECT s, CASE WHEN s % 37 <> 0 THEN y END AS y FROM y1)"""
_STATS = """, st AS (
  SELECT m, avg(v) AS mu, count(v) AS n,
         CASE WHEN var_pop(v) * count(v) > 0 THEN 1 / sqrt(var_pop(v) * count(v) / ((SELECT count(y) FROM p) - 1)) ELSE 1.0 END AS isd
  FROM c JOIN p USING (s) WHERE y IS NOT NULL GROUP BY m
), z AS (
  SELECT s, m, v, coalesce((v - mu) * isd, 0) AS z FROM c JOIN st USING (m) JOIN p USING (s) WHERE y IS NOT NULL
), a AS (SELECT s, m, v, z, z / sqrt((SELECT count(*) FROM p)) AS a FROM z)
, ys AS (SELECT s, y / (SELECT stddev_samp(y) FROM p) AS y FROM p)"""
DENSE = "WITH " + _CELLS + ", c AS (SELECT * FROM w1), p AS (SELECT * FROM y1)" + _STATS
DOSAGE = "WITH " + _DOSAGE + ", c AS (SELECT * FROM w2), p AS (SELECT * FROM y2)" + _STATS
_ATY = ", r AS (SELECT m, sum(a * y) AS r FROM a JOIN ys USING (s) GROUP BY m)"


class _Load:
    """A workload with its statistics."""

    def __init__(self, spark: SparkSession, sf_dir: str, kind: str = "dense"):
        self.cells = getattr(w, kind)(spark, sf_dir)
        self.pheno = getattr(w, f"{kind}_phenotype")(spark, sf_dir)
        self.stats = op.marker_stats(self.cells, self.pheno)
        self.n = self.pheno.agg(F.count("*").alias("n")).scalar().cast("double")
        self.scaled = op.scaled_phenotype(self.pheno)

    def z(self) -> DataFrame:
        return op.standardised(op.of_present(self.cells, self.pheno).drop("y"), self.stats)

    def aty(self) -> DataFrame:
        u = op.filled_phenotype(self.scaled).select("sample_idx", F.col("y").alias("u"))
        return op.at_x(self.cells, self.stats, u, self.n)

    def r(self) -> DataFrame:
        return self.aty().select("marker_idx", F.col("value").alias("r"))


def marginal_ttest(spark, d):
    load = _Load(spark, d, "dosage")
    sums = op.regression_sums(load.cells, load.pheno)
    tests = sums.select("marker_idx", "n", op.t_statistic().alias("t")).join(load.aty(), "marker_idx")
    return rounded(tests.select("marker_idx", "n", F.col("value").alias("aty"), "t"), 5)


_T = "sqrt(({n} - 2) / (1 - r * r)) * r"


def _regression(rows: str, keys: str, z: str, y: str) -> str:
    return f"""SELECT {keys}, count(*) AS n, corr({z}, {y}) AS r FROM {rows} GROUP BY {keys}"""


_MARGINAL_SQL = DOSAGE + _ATY + f""", g AS ({_regression("c JOIN p USING (s) WHERE v IS NOT NULL AND y IS NOT NULL", "m", "v", "y")})
SELECT m AS marker_idx, n, round(r.r, 5) + 0.0 AS aty, round(g.r * sqrt((n - 2) / (1 - g.r * g.r)), 5) + 0.0 AS t FROM g JOIN r USING (m)"""


def packed_dosages(cells: DataFrame) -> DataFrame:
    """Two-bit calls of a dosage table whose samples are numbered from 0."""
    code = F.when(F.col("value").isNull(), 1).when(F.col("value") == 2, 0).when(F.col("value") == 1, 2).otherwise(3)
    at = F.floor(F.col("sample_idx") / 4)
    byte = F.sum(code * F.pow(F.lit(4), F.col("sample_idx") % 4)).cast("int")
    return (
        cells.groupBy("marker_idx", at.alias("at")).agg(byte.alias("byte"))
        .groupBy("marker_idx").agg(F.sort_array(F.collect_list(F.struct("at", "byte"))).alias("bytes"))
        .select("marker_idx", F.unhex(F.array_join(F.transform("bytes", lambda b: F.lpad(F.hex(b["byte"]), 2, "0")), "")).alias("payload"))
    )


def genotype_decode(spark, d):
    cells = w.dosage(spark, d)
    n = cells.agg(F.max("sample_idx") + 1).first()[0]
    return op.decode(packed_dosages(cells), n)


def standardize(spark, d):
    return rounded(_Load(spark, d, "dosage").z().select("marker_idx", "sample_idx", "z"))


def phenotype_scale(spark, d):
    return rounded(op.scaled_phenotype(w.dosage_phenotype(spark, d)))


def phenotype_filter(spark, d):
    return op.filled_phenotype(w.dosage_phenotype(spark, d))


def marker_stats(spark, d):
    return rounded(_Load(spark, d, "dosage").stats)


def dense_marker_stats(spark, d):
    return rounded(_Load(spark, d).stats)


def sample_stats(spark, d):
    load = _Load(spark, d, "dosage")
    return rounded(op.sample_stats(load.cells, load.stats, load.pheno))


def _x_of_marker() -> Column:
    return 1 / (F.col("marker_idx") + 1.0)


def _vector(cells: DataFrame) -> DataFrame:
    return cells.select("marker_idx").distinct().select("marker_idx", _x_of_marker().alias("x"))


def a_x(spark, d):
    load = _Load(spark, d)
    return rounded(op.a_x(load.cells, load.stats, _vector(load.cells), load.n))


def at_x(spark, d):
    return rounded(_Load(spark, d).aty())


def sample_subrange_product(spark, d):
    """Samples 100 to 299 only, scaled by their number."""
    load = _Load(spark, d)
    part = load.cells.where(F.col("sample_idx").between(100, 299))
    u = load.scaled.where(F.col("sample_idx").between(100, 299)).select("sample_idx", F.col("y").alias("u"))
    return rounded(op.at_x(part, load.stats, u, u.agg(F.count("*").alias("n")).scalar().cast("double")))


def join_marker_stats(spark, d):
    load = _Load(spark, d, "relational")
    return rounded(load.z().select("sample_idx", "marker_idx", "z"))


_W3 = """WITH b AS (SELECT o_custkey AS s, p_brand AS b, least(count(*), 2) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), k AS (SELECT b, CAST(row_number() OVER (ORDER BY b) - 1 AS BIGINT) AS m FROM (SELECT DISTINCT p_brand AS b FROM part)
), c AS (SELECT c_custkey AS s, k.m, CAST(coalesce(b.v, 0) AS DOUBLE) AS v
  FROM customer CROSS JOIN k LEFT JOIN b ON b.s = c_custkey AND b.b = k.b
), p AS (SELECT c_custkey AS s, c_acctbal AS y FROM customer)""" + _STATS


def covariate_effect(spark, d):
    return rounded(op.covariate_effect(w.covariates(spark, d), [0.5, -0.1, 0.25]))


def _two(spark, d):
    return w.table(spark, d, "embeddings").select(
        F.col("embedding")[0].cast("double").alias("u"), F.col("embedding")[1].cast("double").alias("v")
    )


def inner_product(spark, d):
    return rounded(_two(spark, d).agg(F.sum(F.col("u") * F.col("v")).alias("value")))


def l2_norm2(spark, d):
    return rounded(_two(spark, d).agg(F.sum(F.col("u") * F.col("u")).alias("value")))


def stdev(spark, d):
    return rounded(w.dense_phenotype(spark, d).agg(F.stddev_samp("y").alias("value")))


def _denoised(spark, d) -> DataFrame:
    p, v = list(PRIOR.probs), list(PRIOR.variances)
    r = F.col("r")
    return _Load(spark, d).r().select(
        "marker_idx", "r", scalars.denoise(r, GAMMA, p, v).alias("x1"), scalars.denoise_slope(r, GAMMA, p, v).alias("d1")
    )


def denoise_linear(spark, d):
    return rounded(_denoised(spark, d).select("marker_idx", "x1"))


def denoise_linear_deriv(spark, d):
    return rounded(_denoised(spark, d).select("marker_idx", "d1"))


def onsager_alpha1(spark, d):
    return rounded(_denoised(spark, d).agg(F.avg("d1").alias("alpha1")))


def damped_update(spark, d):
    return rounded(_denoised(spark, d).select("marker_idx", scalars.damped(F.col("x1"), F.col("r") / 2, 0.15).alias("x1")))


# normal densities without their common factor, plainly: no shift of exponents is needed here
_MIX = ", w AS (SELECT m, r, " + ", ".join(
    f"{p} / sqrt({v} + 0.5) * exp(-r * r / (2 * ({v} + 0.5))) AS w{k}" for k, (p, v) in enumerate(zip(PRIOR.probs, PRIOR.variances))
) + " FROM r), d AS (SELECT m, r, " + ", ".join(
    "(" + " + ".join(f"w{k} / power({v} + 0.5, {n})" for k, v in enumerate(PRIOR.variances)) + f") AS t{n}" for n in range(3)
) + """ FROM w), g AS (SELECT m, r, r * (1 - 0.5 * t1 / t0) AS x1,
  1 + 0.5 * ((r * r * t2 - t1) / t0 - power(r * t1 / t0, 2)) AS d1 FROM d)"""


def _prior_rows(spark: SparkSession, p: em.Prior) -> DataFrame:
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(p.probs, p.variances, strict=True))]
    return rounded(spark.createDataFrame(rows, "k int, prob double, var double"))


def em_prior_step(spark, d):
    return _prior_rows(spark, em.em_step(_Load(spark, d).r(), GAMMA, PRIOR))


_CLOSE = em.Prior((0.7, 0.2, 0.1), (0.0, 0.5, 0.6))


def prior_merge(spark, d):
    return _prior_rows(spark, em.em_step(_Load(spark, d).r(), GAMMA, _CLOSE).merged())


def _em_sql(p: em.Prior) -> str:
    dens = ", ".join(f"{a} / sqrt({v} + 0.5) * exp(-r * r / (2 * ({v} + 0.5))) AS w{k}" for k, (a, v) in enumerate(zip(p.probs, p.variances)))
    total = " + ".join(f"w{k}" for k in range(len(p.probs)))
    sums = ", ".join(
        f"sum(w{k} / ({total})) AS b{k}, sum(w{k} / ({total}) * (power(r * 2 / (1.0 / {v} + 2), 2) + 1 / (1.0 / {v} + 2))) AS g{k}"
        for k, v in enumerate(p.variances) if k
    )
    slabs = " UNION ALL ".join(f"SELECT {k} AS k, b{k} / n AS prob, g{k} / b{k} AS var FROM e" for k in range(1, len(p.probs)))
    return DENSE + _ATY + f""", q AS (SELECT r, {dens} FROM r), e AS (SELECT count(*) AS n, sum(1 - w0 / ({total})) AS pi, {sums} FROM q)
, em AS (SELECT 0 AS k, 1 - pi / n AS prob, 0.0 AS var FROM e UNION ALL {slabs})"""


_EM_SQL = _em_sql(PRIOR) + f" SELECT CAST(k AS INTEGER) AS k, {_r('prob')} AS prob, {_r('var')} AS var FROM em"
_MERGE_SQL = _em_sql(_CLOSE) + f""", f AS (
  SELECT abs(x.var - y.var) / least(x.var, y.var) < 0.5 AS near, y.prob AS more FROM em x, em y WHERE x.k = 1 AND y.k = 2)
SELECT CAST(k AS INTEGER) AS k, {_r('CASE WHEN k = 1 AND near THEN prob + more ELSE prob END')} AS prob, {_r('var')} AS var
FROM em, f WHERE NOT (k = 2 AND near)"""


def noise_precision(spark, d):
    """Of a signal-to-noise ratio of 2 under the prior."""
    rows = spark.createDataFrame([(float(p), float(v)) for p, v in zip(PRIOR.probs, PRIOR.variances, strict=True)], "p double, v double")
    n = w.dense(spark, d).agg(F.count_distinct("marker_idx").alias("n")).scalar()
    return rounded(rows.agg((2.0 / (n * F.sum(F.col("p") * F.col("v")))).alias("gamw")))


def _test_train(spark, d):
    """Estimates of three iterations from the even samples, and the odd ones to test on."""
    cells, pheno = w.dense(spark, d), w.dense_phenotype(spark, d)
    even, odd = F.col("sample_idx") % 2 == 0, F.col("sample_idx") % 2 == 1
    train, train_y = cells.where(even), pheno.where(even)
    u = op.scaled_phenotype(train_y).select("sample_idx", F.col("y").alias("u"))
    r = op.at_x(train, op.marker_stats(train, train_y), u, train_y.agg(F.count("*").alias("n")).scalar().cast("double"))
    x = r.select("marker_idx", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("it"), "value").select(
        "it", "marker_idx", (F.col("value") * F.col("it") * 0.05).alias("x")
    )
    return train, train_y, cells.where(odd), pheno.where(odd), x


def _predicted(cells, pheno, x) -> DataFrame:
    """``it, sample_idx, y, z`` with the cells' own statistics: all iterations in one scan."""
    n = F.sqrt(pheno.agg(F.count("*").alias("n")).scalar().cast("double"))
    z = op.standardised(cells, op.marker_stats(cells, pheno)).join(x, "marker_idx").groupBy("it", "sample_idx")
    return z.agg((F.sum(F.col("z") * F.col("x")) / n).alias("z")).join(op.scaled_phenotype(pheno), "sample_idx")


def train_r2(spark, d):
    train, y, _, _, x = _test_train(spark, d)
    return rounded(evaluate.train_r2(_predicted(train, y, x), ("it",)))


def test_r2(spark, d):
    _, _, test, y, x = _test_train(spark, d)
    return rounded(evaluate.test_r2(_predicted(test, y, x.where("it = 2"))))


def predict_r2_by_iter(spark, d):
    _, _, test, y, x = _test_train(spark, d)
    return rounded(evaluate.test_r2(_predicted(test, y, x), ("it",)))


def best_iteration(spark, d):
    _, _, test, y, x = _test_train(spark, d)
    return rounded(evaluate.best_iteration(evaluate.test_r2(_predicted(test, y, x), ("it",))))


def predict_single(spark, d):
    _, _, test, y, x = _test_train(spark, d)
    return rounded(_predicted(test, y, x.where("it = 1")).select("sample_idx", "z"))


def _side(name: str, parity: int) -> str:
    return f""", {name}p AS (SELECT * FROM y1 WHERE s % 2 = {parity}), {name}c AS (SELECT * FROM w1 WHERE s % 2 = {parity})
, {name}t AS (SELECT m, avg(v) AS mu, 1 / stddev_samp(v) AS isd FROM {name}c GROUP BY m)
, {name}a AS (SELECT s, m, (v - mu) * isd / sqrt((SELECT count(*) FROM {name}p)) AS a FROM {name}c JOIN {name}t USING (m))
, {name}y AS (SELECT s, y / (SELECT stddev_samp(y) FROM {name}p) AS y FROM {name}p)"""


_SPLIT = "WITH " + _CELLS + _side("e", 0) + _side("o", 1) + """
, x AS (SELECT m, it, 0.05 * it * r AS x FROM (SELECT m, sum(a * y) AS r FROM ea JOIN ey USING (s) GROUP BY m), (SELECT unnest([1, 2, 3]) AS it))
, ef AS (SELECT it, s, sum(a * x) AS z FROM ea JOIN x USING (m) GROUP BY it, s)
, f AS (SELECT it, s, sum(a * x) AS z FROM oa JOIN x USING (m) GROUP BY it, s)
, q AS (SELECT it, 1 - sum(power(y - z, 2)) / (var_samp(y) * count(*)) AS r2 FROM f JOIN oy USING (s) GROUP BY it)"""


def _scores(spark, d) -> DataFrame:
    load = _Load(spark, d)
    return op.a_x(load.cells, load.stats, load.r().select("marker_idx", F.col("r").alias("x")), load.n)


def probit_classify(spark, d):
    return evaluate.classified(_scores(spark, d))


def confusion_rates(spark, d):
    truth = w.dense_phenotype(spark, d).select("sample_idx", (F.col("y") >= 5).cast("int").alias("y"))
    return rounded(evaluate.confusion_rates(truth.join(evaluate.classified(_scores(spark, d)), "sample_idx")))


_SCORES = ", f AS (SELECT s, CAST(sum(a * r) >= 0 AS INTEGER) AS yhat FROM a JOIN r USING (m) GROUP BY s)"


def _against_truth(spark, d):
    return _denoised(spark, d).select(F.col("x1").alias("a"), F.col("r").alias("b"))


def signal_cosine(spark, d):
    return rounded(evaluate.cosine(_against_truth(spark, d)))


def signal_l2_error(spark, d):
    return rounded(evaluate.l2_error(_against_truth(spark, d)))


def regression_suffstats(spark, d):
    load = _Load(spark, d, "dosage")
    return rounded(op.regression_sums(load.cells, load.pheno))


def ttest_statistic(spark, d):
    load = _Load(spark, d, "dosage")
    return rounded(op.regression_sums(load.cells, load.pheno).select("marker_idx", op.t_statistic().alias("t")))


def ttest_pvalue(spark, d):
    load = _Load(spark, d, "dosage")
    return association.marginal(op.regression_sums(load.cells, load.pheno)).select("marker_idx", "p")


def _residual(load: _Load) -> tuple[DataFrame, DataFrame, int]:
    """Effects a tenth of A'y, the residual they leave, and N."""
    x = load.r().select("marker_idx", (F.col("r") / 10).alias("x"))
    z = op.a_x(load.cells, load.stats, x, load.n, load.pheno)
    residual = load.scaled.where("y IS NOT NULL").join(z, "sample_idx").select("sample_idx", (F.col("y") - F.col("value")).alias("e"))
    return x, residual, load.pheno.count()


def loo_ttest(spark, d):
    load = _Load(spark, d, "dosage")
    x, e, n = _residual(load)
    return rounded(association.leave_one_out(load.z(), e, x, n), 5)


def loco_predictor(spark, d):
    load = _Load(spark, d, "dosage")
    x, _, n = _residual(load)
    return rounded(association.chromosome_predictor(load.z(), x, w.chromosomes(load.cells), n))


def loco_ttest(spark, d):
    load = _Load(spark, d, "dosage")
    x, e, n = _residual(load)
    return rounded(association.leave_one_chromosome_out(load.z(), e, x, w.chromosomes(load.cells), n), 5)


def lead_markers(spark, d):
    load = _Load(spark, d, "dosage")
    tests = op.regression_sums(load.cells, load.pheno).select("marker_idx", op.t_statistic().alias("t"))
    return rounded(association.lead_markers(tests.join(w.chromosomes(load.cells), "marker_idx"), 2))


_RESIDUAL = _ATY + """, x AS (SELECT m, r / 10 AS x FROM r), e AS (
  SELECT s, y - z AS e FROM (SELECT s, sum(a * x) AS z FROM a JOIN x USING (m) GROUP BY s) JOIN ys USING (s) WHERE y IS NOT NULL)
, h AS (SELECT s, m, v, z, a * x AS own, CAST(m // 8 + 1 AS INTEGER) AS chrom, e FROM a JOIN x USING (m) JOIN e USING (s))
, l AS (SELECT chrom, s, sum(own) AS value FROM h GROUP BY chrom, s)"""


def relative_change_by_iter(spark, d):
    return rounded(evaluate.relative_change(_test_train(spark, d)[4]))


def _events(spark, d):
    return w.table(spark, d, "events").select("event_id", "value")


def huber_prox(spark, d):
    p = F.col("value") / 10
    return rounded(_events(spark, d).select("event_id", scalars.huber_prox(p, 2.0, 0.5, F.lit(1.0)).alias("value")))


def huber_prox_deriv(spark, d):
    p = F.col("value") / 10
    return rounded(_events(spark, d).select("event_id", scalars.huber_prox_slope(p, 2.0, 0.5, F.lit(1.0)).alias("value")))


def huber_loss(spark, d):
    return rounded(_events(spark, d).select("event_id", scalars.huber_loss(F.col("value") / 7, 0.5, F.lit(1.0)).alias("value")))


def huber_delta_grid(spark, d):
    """Mean loss for each threshold, all thresholds in one scan."""
    grid = [0.001, 0.01, 0.1, 1.0, 10.0]
    losses = _events(spark, d).select(
        F.explode(F.array(*(F.struct(F.lit(g).alias("delta"), scalars.huber_loss(F.col("value") / 10, g, F.lit(1.0)).alias("loss")) for g in grid))).alias("x")
    )
    return rounded(losses.groupBy("x.delta").agg(F.avg("x.loss").alias("loss")))


def mixture_log_ratio(spark, d):
    ratio = scalars.mixture_log_ratio(F.col("value") / 100, [0.6, 0.4], [1.0, 4.0], [0.3, 0.7], [0.5, 9.0])
    return rounded(_events(spark, d).select("event_id", ratio.alias("value")))


def probit_denoise(spark, d):
    score = _scores(spark, d).join(w.dense_phenotype(spark, d), "sample_idx")
    both = special.probit_denoise_udf(2.0)(F.col("value"), (F.col("y") >= 5).cast("double"), F.lit(0.1))
    return score.select("sample_idx", both.alias("b")).select("sample_idx", "b.z1", "b.dz1")


def normal_cdf(spark, d):
    return _events(spark, d).select("event_id", special.normal_cdf_udf(F.col("value") / 100).alias("value"))


_DENSITY = lambda p, v: " + ".join(f"{a} / sqrt({b}) * exp(-value * value / 10000 / (2 * {b}))" for a, b in zip(p, v))
_IN = "abs(1.0 - value / 10) <= 0.75"

SQL = {
    "marginal_ttest": _MARGINAL_SQL,
    "genotype_decode": "WITH " + _DOSAGE + " SELECT m AS marker_idx, s AS sample_idx, CAST(v AS INTEGER) AS dosage FROM w2",
    "standardize": DOSAGE + f" SELECT m AS marker_idx, s AS sample_idx, {_r('z')} AS z FROM z",
    "phenotype_scale": DOSAGE + f" SELECT s AS sample_idx, {_r('y')} AS y FROM ys",
    "phenotype_filter": "WITH " + _DOSAGE + " SELECT s AS sample_idx, coalesce(y, 0.0) AS y FROM y2",
    "marker_stats": DOSAGE + f" SELECT m AS marker_idx, {_r('mu')} AS mu, {_r('isd')} AS isd, n FROM st",
    "dense_marker_stats": DENSE + f" SELECT m AS marker_idx, {_r('mu')} AS mu, {_r('isd')} AS isd, n FROM st",
    "sample_stats": DOSAGE + f""" SELECT s AS sample_idx, count(v) AS n, {_r("avg(z) FILTER (v IS NOT NULL)")} AS mean_z,
        {_r("1 / stddev_samp(z) FILTER (v IS NOT NULL)")} AS isd_z FROM z GROUP BY s""",
    "a_x": DENSE + f" SELECT s AS sample_idx, {_r('sum(a / (m + 1.0))')} AS value FROM a GROUP BY s",
    "at_x": DENSE + _ATY + f" SELECT m AS marker_idx, {_r('r')} AS value FROM r",
    "sample_subrange_product": DENSE + f""" SELECT m AS marker_idx, {_r("sum(z * ys.y) / sqrt(count(*))")} AS value
        FROM z JOIN ys USING (s) WHERE s BETWEEN 100 AND 299 GROUP BY m""",
    "join_marker_stats": _W3 + f" SELECT s AS sample_idx, m AS marker_idx, {_r('z')} AS z FROM z",
    "covariate_effect": f"""SELECT d.doc_id AS sample_idx, {_r("0.5 - 0.1 * ln(n_chars + 1.0) + CASE WHEN lang = 'en' THEN 0.25 ELSE 0 END")} AS value
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "inner_product": f"SELECT {_r('sum(CAST(embedding[1] AS DOUBLE) * CAST(embedding[2] AS DOUBLE))')} AS value FROM embeddings",
    "l2_norm2": f"SELECT {_r('sum(CAST(embedding[1] AS DOUBLE) * CAST(embedding[1] AS DOUBLE))')} AS value FROM embeddings",
    "stdev": f"SELECT {_r('stddev_samp(CAST(label AS DOUBLE))')} AS value FROM embeddings",
    "denoise_linear": DENSE + _ATY + _MIX + f" SELECT m AS marker_idx, {_r('x1')} AS x1 FROM g",
    "denoise_linear_deriv": DENSE + _ATY + _MIX + f" SELECT m AS marker_idx, {_r('d1')} AS d1 FROM g",
    "onsager_alpha1": DENSE + _ATY + _MIX + f" SELECT {_r('avg(d1)')} AS alpha1 FROM g",
    "damped_update": DENSE + _ATY + _MIX + f" SELECT m AS marker_idx, {_r('0.15 * x1 + 0.85 * r / 2')} AS x1 FROM g",
    "em_prior_step": _EM_SQL,
    "prior_merge": _MERGE_SQL,
    "noise_precision": DENSE + f" SELECT {_r('2.0 / (count(*) * (0.2 * 0.5 + 0.1 * 4.0))')} AS gamw FROM st",
    "train_r2": _SPLIT + f" SELECT it, {_r('1 - sum(power(y - z, 2)) / sum(y * y)')} AS r2 FROM ef JOIN ey USING (s) GROUP BY it",
    "test_r2": _SPLIT + f" SELECT {_r('r2')} AS r2 FROM q WHERE it = 2",
    "predict_r2_by_iter": _SPLIT + f" SELECT it, {_r('r2')} AS r2 FROM q",
    "best_iteration": _SPLIT + f" SELECT it, {_r('r2')} AS r2 FROM q ORDER BY q.r2 DESC, it LIMIT 1",
    "predict_single": _SPLIT + f" SELECT s AS sample_idx, {_r('z')} AS z FROM f WHERE it = 1",
    "probit_classify": DENSE + _ATY + _SCORES + " SELECT s AS sample_idx, yhat FROM f",
    "confusion_rates": DENSE + _ATY + _SCORES + f""" SELECT count(*) FILTER (y >= 5) AS P, count(*) FILTER (y < 5) AS N,
        {_r("count(*) FILTER (y >= 5 AND yhat = 1) / count(*) FILTER (y >= 5)")} AS TPR,
        {_r("count(*) FILTER (y < 5 AND yhat = 1) / count(*) FILTER (y < 5)")} AS FPR FROM f JOIN p USING (s)""",
    "signal_cosine": DENSE + _ATY + _MIX + f" SELECT {_r('sum(x1 * r) / sqrt(sum(x1 * x1) * sum(r * r))')} AS cosine FROM g",
    "signal_l2_error": DENSE + _ATY + _MIX + f" SELECT {_r('sqrt(sum(power(x1 - r, 2)) / sum(r * r))')} AS l2_error FROM g",
    "regression_suffstats": DOSAGE + f""" SELECT m AS marker_idx, count(*) AS n, {_r('sum(v)')} AS sx, {_r('sum(v * v)')} AS sxx, {_r('sum(v * y)')} AS sxy,
        {_r('sum(y)')} AS sy, {_r('sum(y * y)')} AS syy FROM c JOIN p USING (s) WHERE v IS NOT NULL AND y IS NOT NULL GROUP BY m""",
    "ttest_statistic": DOSAGE + f""", g AS ({_regression("c JOIN p USING (s) WHERE v IS NOT NULL AND y IS NOT NULL", "m", "v", "y")})
        SELECT m AS marker_idx, {_r("r * sqrt((n - 2) / (1 - r * r))")} AS t FROM g""",
    "loo_ttest": DOSAGE + _RESIDUAL + f""", g AS ({_regression("h WHERE v IS NOT NULL", "m", "z", "e + own")})
        SELECT m AS marker_idx, n, round(r * sqrt((n - 2) / (1 - r * r)), 5) + 0.0 AS t FROM g""",
    "loco_predictor": DOSAGE + _RESIDUAL + f" SELECT chrom, s AS sample_idx, {_r('value')} AS value FROM l",
    "loco_ttest": DOSAGE + _RESIDUAL + f""", g AS ({_regression("h JOIN l USING (chrom, s) WHERE v IS NOT NULL", "chrom, m", "z", "e + value")})
        SELECT chrom, m AS marker_idx, n, round(r * sqrt((n - 2) / (1 - r * r)), 5) + 0.0 AS t FROM g""",
    "lead_markers": DOSAGE + f""", g AS ({_regression("c JOIN p USING (s) WHERE v IS NOT NULL AND y IS NOT NULL", "m", "v", "y")})
        , t AS (SELECT m, CAST(m // 8 + 1 AS INTEGER) AS chrom, r * sqrt((n - 2) / (1 - r * r)) AS t FROM g)
        , k AS (SELECT *, CAST(row_number() OVER (PARTITION BY chrom ORDER BY abs(t) DESC, m) AS INTEGER) AS rank FROM t)
        SELECT m AS marker_idx, {_r('t')} AS t, chrom, rank FROM k WHERE rank <= 2""",
    "relative_change_by_iter": _SPLIT + f""", b AS (SELECT it, m, x, lag(x) OVER (PARTITION BY m ORDER BY it) AS last FROM x)
        SELECT it, {_r("sqrt(sum(power(x - last, 2)) / sum(last * last))")} AS rel_change FROM b WHERE last IS NOT NULL GROUP BY it""",
    "huber_prox": f"""SELECT event_id, {_r(f"1.0 - CASE WHEN {_IN} THEN (1.0 - value / 10) / 1.5 ELSE 1.0 - value / 10 - sign(1.0 - value / 10) * 0.25 END")} AS value FROM events""",
    "huber_prox_deriv": f"SELECT event_id, {_r(f'CASE WHEN {_IN} THEN 1.0 / 1.5 ELSE 1.0 END')} AS value FROM events",
    "huber_loss": f"""SELECT event_id, {_r("CASE WHEN abs(1 - value / 7) <= 0.5 THEN power(1 - value / 7, 2) / 2 ELSE 0.5 * (abs(1 - value / 7) - 0.25) END")} AS value FROM events""",
    "huber_delta_grid": f"""SELECT delta, {_r("avg(CASE WHEN abs(1 - value / 10) <= delta THEN power(1 - value / 10, 2) / 2 ELSE delta * (abs(1 - value / 10) - delta / 2) END)")} AS loss
        FROM events, (SELECT CAST(unnest([0.001, 0.01, 0.1, 1.0, 10.0]) AS DOUBLE) AS delta) GROUP BY delta""",
    "mixture_log_ratio": f"SELECT event_id, {_r(f'ln(({_DENSITY((0.6, 0.4), (1.0, 4.0))}) / ({_DENSITY((0.3, 0.7), (0.5, 9.0))}))')} AS value FROM events",
}

QUERIES = {
    f.__name__: f
    for f in (
        marginal_ttest, genotype_decode, standardize, phenotype_scale, phenotype_filter, marker_stats, dense_marker_stats,
        sample_stats, a_x, at_x, sample_subrange_product, join_marker_stats, covariate_effect, inner_product, l2_norm2, stdev,
        denoise_linear, denoise_linear_deriv, onsager_alpha1, damped_update, em_prior_step, prior_merge, noise_precision,
        train_r2, test_r2, predict_r2_by_iter, best_iteration, predict_single, probit_classify, confusion_rates, signal_cosine,
        signal_l2_error, regression_suffstats, ttest_statistic, ttest_pvalue, loo_ttest, loco_predictor, loco_ttest, lead_markers,
        relative_change_by_iter, huber_prox, huber_prox_deriv, huber_loss, huber_delta_grid, mixture_log_ratio, probit_denoise,
        normal_cdf,
    )
}
