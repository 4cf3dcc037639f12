"""Command line: fit, test, predict, simulate and association tests over files.

``python -m tesserix --run-mode infere --bed-file g.bed --phen-files y.phen --N 1000 ...``

Options keep the names of the programs this engine replaces; an unknown one is an error, and so
is one that has no effect there.  The ``sim`` modes draw effects and a phenotype for the samples of
a matrix and fit a model to them.  Results are Parquet datasets under ``<out-dir><out-name>``, estimates partitioned by iteration.
"""

from __future__ import annotations

import argparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import association, evaluate, models, simulate
from .operators.markers import as_array
from .operators.matrix import MarkerMatrix
from .operators.prior import Prior, default_prior, halving_prior
from .sources import genomics

SIMULATIONS = ("sim", "sim_heavy_tails", "sim_realistic", "sim_probit")
MODES = ("infere", "test", "both", "pvals-calc", "restart", "predict", "predict_single", *SIMULATIONS)

#: Mixture of effects of the realistic simulation, and its heritability (fixed values).
REALISTIC = Prior(
    (0.9595661, 0.0008876436, 0.0367001, 0.002712435, 0.0001066884, 8.915961e-6, 1.814535e-5), (0.0, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
)
REALISTIC_H2 = 0.5525262


def _numbers(text: str) -> list[float]:
    return [float(x) for x in text.split(",") if x]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tesserix", allow_abbrev=False, description=__doc__.splitlines()[0])
    p.add_argument("--run-mode", choices=MODES, required=True)
    p.add_argument("--model", choices=("linear", "bin_class", "robust"), default="linear")
    for name in ("bed-file", "bed-file-test", "dense-file", "dense-file-test", "bim-file", "bim-file-test", "cov-file", "cov-file-test",
                 "cov-estimate-file", "estimate-file", "freeze-index-file", "out-dir", "out-name", "commits"):
        p.add_argument(f"--{name}", default="")
    for name in ("phen-files", "phen-files-test", "true-signal-files"):
        p.add_argument(f"--{name}", default="", help="comma-separated; the first counts")
    for name, kind, default in (
        ("N", int, 0), ("Mt", int, 0), ("N-test", int, 0), ("Mt-test", int, 0), ("C", int, 0), ("iterations", int, 1),
        ("num-mix-comp", int, 0), ("rho", float, 0.15), ("EM-max-iter", int, 2), ("EM-err-thr", float, 1e-2), ("CG-max-iter", int, 60),
        ("stop-criteria-thr", float, 1e-4), ("learn-vars", int, 1), ("use-lmmse-damp", int, 0), ("use-XXT-denoiser", int, 0),
        ("store-pvals", int, 0), ("alpha-scale", float, 1.0), ("h2", float, -1.0), ("CV", int, 0), ("probit-var", float, 1.0),
        ("gam1-init", float, -1.0), ("gamw-init", float, -1.0), ("init-est", int, 0), ("use-freeze", int, 0), ("seed", int, 1),
        ("red", int, 0), ("hold-out", float, 0.0), ("gamma-damp", int, 1), ("huber-delta", float, 1e-3), ("learn-delta", int, 0),
    ):
        p.add_argument(f"--{name}", type=kind, default=default)
    for name in ("probs", "vars", "test-iter-range"):
        p.add_argument(f"--{name}", type=_numbers, default=[])
    return p


def _options(a: argparse.Namespace) -> models.Options:
    return models.Options(
        model=a.model, iterations=a.iterations, rho=a.rho, h2=a.h2 if a.h2 >= 0 else None,
        gam1=a.gam1_init if a.gam1_init > 0 else None, gamw=a.gamw_init if a.gamw_init > 0 else None,
        em_rounds=a.EM_max_iter, em_tolerance=a.EM_err_thr, cg_rounds=a.CG_max_iter, stop=a.stop_criteria_thr,
        learn_variances=bool(a.learn_vars), by_samples=bool(a.use_XXT_denoiser), lmmse_damping=bool(a.use_lmmse_damp),
        probit_variance=a.probit_var, delta=a.huber_delta, learn_delta=bool(a.learn_delta), seed=a.seed,
        hold_out=a.hold_out, reduced=bool(a.red),
    )


def _checked(a: argparse.Namespace) -> argparse.Namespace:
    """The options, none of which goes without effect in silence."""
    if a.red not in (0, 1):
        raise SystemExit("--red is 1 for solves over a tenth of the samples each, or 0")
    if (a.red or a.hold_out) and a.model != "linear":
        raise SystemExit("--red and --hold-out are of the linear model")
    if a.gamma_damp != 1:
        raise SystemExit("--gamma-damp has no effect in any model")
    if a.CV and a.run_mode not in SIMULATIONS:
        raise SystemExit("--CV is the number of causal markers of a simulation")
    if a.num_mix_comp and a.probs:
        raise SystemExit("--num-mix-comp makes a prior, which --probs and --vars give already")
    if a.num_mix_comp and not a.CV:
        raise SystemExit("--num-mix-comp makes a prior from --CV causal markers")
    if a.run_mode in SIMULATIONS and not (a.N and (a.CV or a.run_mode == "sim_realistic")):
        raise SystemExit("a simulation needs --N and --CV")
    return a


class Study:
    """A matrix, its phenotype and covariates, from files; the phenotype of a simulation comes later."""

    def __init__(self, spark: SparkSession, a: argparse.Namespace, test: bool = False):
        suffix = "_test" if test else ""
        option = lambda name: getattr(a, name + suffix)
        if a.run_mode in SIMULATIONS:
            self.y = np.ones(a.N)
        else:
            self.y = self._phenotype(spark, a, option)
        bed = option("bed_file")
        read, path, kind = (genomics.read_bed, bed, "bed") if bed else (genomics.read_dense, option("dense_file"), "dense")
        self.matrix = MarkerMatrix(read(spark, path, len(self.y)), kind, ~np.isnan(self.y), a.alpha_scale)
        if option("Mt") and option("Mt") != self.matrix.n_markers:
            raise SystemExit(f"the matrix has {self.matrix.n_markers} markers, not {option('Mt')}")
        cov = option("cov_file")
        self.covariates = None
        if cov and a.C:
            self.covariates = genomics.read_covariates(spark, cov, a.C)

    @staticmethod
    def _phenotype(spark: SparkSession, a: argparse.Namespace, option) -> np.ndarray:
        rows = genomics.read_phenotypes(spark, option("phen_files").split(",")[0]).orderBy("sample_idx").select("y").toLocalIterator()
        y = np.array([np.nan if r[0] is None else r[0] for r in rows], float)
        if option("N") and option("N") != len(y):
            raise SystemExit(f"the phenotype file has {len(y)} samples, not {option('N')}")
        return y if a.model == "bin_class" else y / np.nanstd(y, ddof=1)


def _vector(spark: SparkSession, path: str) -> np.ndarray:
    """A vector by its file's last extension: .bin is binary, all else text."""
    read = genomics.read_vector if path.endswith(".bin") else genomics.read_text_vector
    return np.array([r[0] for r in read(spark, path).orderBy("idx").select("value").toLocalIterator()], float)


def _marker_table(spark: SparkSession, series: list[np.ndarray], first: int = 1) -> DataFrame:
    n = [len(x) for x in series]
    return spark.createDataFrame(
        pa.table({
            "it": np.repeat(np.arange(first, first + len(n), dtype=np.int32), n),
            "marker_idx": np.concatenate([np.arange(k) for k in n]), "beta": np.concatenate(series).astype(float),
        })
    )


def _prior(a: argparse.Namespace, study: Study) -> Prior:
    if a.probs:
        return Prior(tuple(a.probs), tuple(a.vars))
    if a.num_mix_comp:
        return halving_prior(study.matrix.n_markers, a.CV, a.num_mix_comp)
    return default_prior(study.matrix.n_markers, study.matrix.n_samples)


def simulated(spark: SparkSession, a: argparse.Namespace, out: str, study: Study) -> np.ndarray:
    """True effects, after the study got a phenotype that they explain to the share ``--h2``."""
    m, n = study.matrix.n_markers, study.matrix.n_samples
    h2 = REALISTIC_H2 if a.run_mode == "sim_realistic" else a.h2 if a.h2 >= 0 else 0.5
    if a.run_mode == "sim_realistic":
        drawn = simulate.rescaled_effects(spark, m, REALISTIC, h2, a.seed)
    else:
        drawn = (simulate.heavy_tailed_effects if a.run_mode == "sim_heavy_tails" else simulate.sparse_effects)(spark, m, a.CV, h2, a.seed)
    truth = np.array([r[0] for r in drawn.orderBy("idx").select("value").toLocalIterator()], float)
    g = study.matrix.times(truth * np.sqrt(n))
    if a.run_mode == "sim_probit" and study.covariates is not None:
        g = g + models.covariate_offset(study.covariates, simulate.alternating_covariate_effects(a.C), n)
    signal = spark.createDataFrame(pa.table({"sample_idx": np.arange(n), "value": g}))
    pheno = simulate.probit_phenotype(signal, a.probit_var, a.seed) if a.run_mode == "sim_probit" else simulate.linear_phenotype(signal, h2, a.seed)
    pheno.write.mode("overwrite").parquet(f"{out}_y")
    pheno = spark.read.parquet(f"{out}_y")
    _marker_table(spark, [truth]).drop("it").write.mode("overwrite").parquet(f"{out}_beta_true")
    simulate.variances(signal, pheno).write.mode("overwrite").parquet(f"{out}_variances")
    study.y = np.array([r[0] for r in pheno.orderBy("sample_idx").select("y").toLocalIterator()], float)
    return truth


def run_fit(spark: SparkSession, a: argparse.Namespace, out: str, study: Study, truth: np.ndarray | None = None) -> models.Fit:
    start = _vector(spark, a.estimate_file) if a.init_est and a.estimate_file else None
    r1 = _vector(spark, a.estimate_file) if a.run_mode == "restart" else None
    frozen = _vector(spark, a.freeze_index_file) > 0 if a.use_freeze and a.freeze_index_file else None
    if truth is None and a.true_signal_files:
        truth = _vector(spark, a.true_signal_files.split(",")[0])
    fitted = models.fit(study.matrix, study.y, _prior(a, study), _options(a), study.covariates, frozen, start, r1, truth, commits=a.commits or None)
    table = fitted.table(spark)
    genomics.write_estimates(table.select("it", "marker_idx", "beta"), f"{out}_estimates")
    genomics.write_estimates(table.select("it", "marker_idx", F.col("r1").alias("beta")), f"{out}_r1")
    spark.createDataFrame(fitted.trace or [(0, "none", 0.0)], "it int, name string, value double").write.mode("overwrite").parquet(f"{out}_trace")
    if fitted.covariate_effects is not None:
        rows = [(c, float(v)) for c, v in enumerate(fitted.covariate_effects)]  # a few
        spark.createDataFrame(rows, "c int, eta double").write.mode("overwrite").parquet(f"{out}_covariates")
    if a.store_pvals:
        effects = fitted.effects
        if effects is None:
            # the tests take their estimates broadcast
            last = table.where(F.col("it") == table.agg(F.max("it")).scalar()).withColumnRenamed("beta", "value")
            effects = as_array(last, study.matrix.n_markers)
        run_tests(spark, a, out, study, [effects], 1)
    return fitted


def run_tests(spark: SparkSession, a: argparse.Namespace, out: str, study: Study, series: list[np.ndarray], first: int) -> None:
    """Leave-one-out tests, and leave-one-chromosome-out ones if there is an annotation, straight
    on the packed markers and of all estimates at once."""
    x = np.stack(series, axis=1) * np.sqrt(study.matrix.n_samples)
    residual = study.y[:, None] - study.matrix.times(x)
    with_p = lambda t: t.withColumn("p", association.student_t_pvalue_udf("t", F.col("n") - 2.0))
    if a.store_pvals in (0, 1):
        with_p(association.packed_leave_one_out(study.matrix, residual, x, first)).write.mode("overwrite").parquet(f"{out}_pvals")
    if a.bim_file and (a.store_pvals in (0, 2) or a.run_mode != "pvals-calc"):
        rows = genomics.read_chromosomes(spark, a.bim_file).orderBy("marker_idx").select("chrom").toLocalIterator()
        chrom = np.array([r[0] for r in rows], np.int64)
        loco = association.packed_leave_one_chromosome_out(study.matrix, residual, x, chrom, first)
        with_p(loco).write.mode("overwrite").parquet(f"{out}_pvals_LOCO")


def _series(spark: SparkSession, a: argparse.Namespace) -> tuple[list[np.ndarray], int]:
    """Estimates to evaluate: a dataset's iterations, or one vector."""
    if a.estimate_file.endswith((".bin", ".txt", ".csv")):
        return [_vector(spark, a.estimate_file)], 1
    low, high = (int(x) for x in a.test_iter_range) if a.test_iter_range else (None, None)
    rows = genomics.read_estimates(spark, a.estimate_file, low, high).orderBy("it", "marker_idx").toLocalIterator()
    found: dict[int, list[float]] = {}
    for r in rows:
        found.setdefault(r["it"], []).append(r["beta"])
    return [np.array(x) for x in found.values()], min(found, default=1)


def _estimates(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """``it, marker_idx, beta`` to evaluate: a dataset's iterations, or one vector."""
    if a.estimate_file.endswith((".bin", ".txt", ".csv")):
        read = genomics.read_vector if a.estimate_file.endswith(".bin") else genomics.read_text_vector
        return read(spark, a.estimate_file).select(F.lit(1).alias("it"), F.col("idx").alias("marker_idx"), F.col("value").alias("beta"))
    low, high = (int(x) for x in a.test_iter_range) if a.test_iter_range else (None, None)
    return genomics.read_estimates(spark, a.estimate_file, low, high).select("it", "marker_idx", "beta")


def run_evaluation(spark: SparkSession, a: argparse.Namespace, out: str, estimates: DataFrame, effects=None) -> None:
    """Predictions of the test samples by iteration, with R squared or the rates of the classes."""
    study = Study(spark, a, test=True)
    its = sorted(r["it"] for r in estimates.select("it").distinct().collect())
    wide = estimates.groupBy("marker_idx").pivot("it", its).agg(F.first("beta"))
    names = [f"x{k}" for k in range(len(its))]
    wide = wide.toDF("marker_idx", *names)
    if a.bim_file and a.bim_file_test:
        wide, missing = evaluate.matched(wide, genomics.read_marker_ids(spark, a.bim_file), genomics.read_marker_ids(spark, a.bim_file_test))
        missing.write.mode("overwrite").parquet(f"{out}_unmatched")
    elif (found := estimates.agg(F.max("marker_idx") + 1).first()[0]) != study.matrix.n_markers:
        raise SystemExit(f"{found} estimates for {study.matrix.n_markers} test markers; give --bim-file and --bim-file-test to match ids")
    if effects is None and a.cov_estimate_file:
        effects = _vector(spark, a.cov_estimate_file)
    offset = np.zeros(len(study.y))
    if study.covariates is not None and effects is not None:
        offset = models.covariate_offset(study.covariates, effects, len(study.y))
    samples = spark.createDataFrame(pa.table({"sample_idx": np.arange(len(study.y)), "y": pa.array(study.y, from_pandas=True), "offset": offset}))
    root = float(np.sqrt(study.matrix.n_samples))
    by_it = F.posexplode("z").alias("k", "value")
    predicted = study.matrix.scores(wide, names).select("sample_idx", by_it).join(samples, "sample_idx").select(
        F.element_at(F.array(*map(F.lit, its)), F.col("k") + 1).alias("it"), "sample_idx", "y", (F.col("value") * root + F.col("offset")).alias("z")
    )
    predicted.write.mode("overwrite").partitionBy("it").parquet(f"{out}_predict")
    if a.run_mode.startswith("predict"):
        return
    predicted = spark.read.parquet(f"{out}_predict")
    if a.model == "bin_class":
        known = predicted.where("y IS NOT NULL").select("it", "y", (F.col("z") >= 0).cast("int").alias("yhat"))
        evaluate.confusion_rates(known, ("it",)).write.mode("overwrite").parquet(f"{out}_rates")
    else:
        r2 = evaluate.test_r2(predicted, ("it",))
        r2.write.mode("overwrite").parquet(f"{out}_r2")
        evaluate.best_iteration(r2).write.mode("overwrite").parquet(f"{out}_best")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _checked(parser().parse_args(arguments))
    spark = spark or SparkSession.builder.appName("tesserix").getOrCreate()
    out = a.out_dir + a.out_name
    if a.run_mode in ("infere", "restart", "both", *SIMULATIONS):
        study, truth = Study(spark, a), None
        if a.run_mode in SIMULATIONS:
            truth = simulated(spark, a, out, study)
            a.model = "bin_class" if a.run_mode == "sim_probit" else a.model
            study.y = study.y if a.model == "bin_class" else study.y / study.y.std(ddof=1)
        fitted = run_fit(spark, a, out, study, truth)
        if a.run_mode == "both":
            run_evaluation(spark, a, out, fitted.table(spark), fitted.covariate_effects)
    elif a.run_mode == "pvals-calc":
        series, first = _series(spark, a)
        run_tests(spark, a, out, Study(spark, a), series, first)
    else:
        estimates = _estimates(spark, a)
        if a.run_mode == "predict_single":
            estimates = estimates.where(F.col("it") == estimates.agg(F.max("it")).scalar())
        run_evaluation(spark, a, out, estimates)


if __name__ == "__main__":
    main()
