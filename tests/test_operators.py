import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserix.operators import association, cells as op, models, simulate, solvers
from tesserix.operators.matrix import MarkerMatrix
from tesserix.operators.prior import Prior
from tesserix.sources import genomics

#: Two-bit calls of three markers for six samples, and the phenotypes.
BED = b"\x6c\x1b\x01\xe4\x0e\x00\x00\x2b\x0b"
Y = [1.0, 2.0, None, 4.0, 5.0, 8.0]


@pytest.fixture
def study(spark, tmp_path):
    path = tmp_path / "x.bed"
    path.write_bytes(BED)
    packed = genomics.read_bed(spark, str(path), 6)
    cells = op.decode(packed, 6).select("marker_idx", "sample_idx", F.col("dosage").cast("double").alias("value"))
    return packed, cells, spark.createDataFrame(list(enumerate(Y)), "sample_idx long, y double")


def test_decode(spark):
    packed = spark.createDataFrame([(0, b"\xe4")], "marker_idx long, payload binary")
    assert [r["dosage"] for r in op.decode(packed, 4).orderBy("sample_idx").collect()] == [2, None, 1, 0]


def test_statistics_and_products(study):
    packed, cells, pheno = study
    stats = op.marker_stats(cells, pheno).orderBy("marker_idx").collect()
    assert [r["n"] for r in stats] == [4, 5, 5]
    assert [r["mu"] for r in stats] == pytest.approx([0.75, 2, 0.8])
    assert [r["isd"] for r in stats] == pytest.approx([1.206045, 1, 1.195229], abs=1e-6)
    u = op.filled_phenotype(op.scaled_phenotype(pheno)).select("sample_idx", F.col("y").alias("u"))
    table = op.marker_stats(cells, pheno)
    aty = [r["value"] for r in op.at_x(cells, table, u, 6).orderBy("marker_idx").collect()]
    assert aty == pytest.approx([-1.168613, 0, 0.356348], abs=1e-6)
    t = op.regression_sums(cells, pheno).select("marker_idx", op.t_statistic().alias("t")).orderBy("marker_idx").collect()
    assert [t[0]["t"], t[2]["t"]] == pytest.approx([-1.785687, 0.387298], abs=1e-6) and t[1]["t"] is None
    x = cells.sparkSession.createDataFrame([(0, 1.0), (1, -2.0), (2, 0.5)], "marker_idx long, x double")
    ax = [r["value"] for r in op.a_x(cells, table, x, 6, pheno).orderBy("sample_idx").collect()]
    want = [0.420277, 0.048795, 0, -0.076504, -0.072089, -0.320479]
    assert ax == pytest.approx(want, abs=1e-6)
    matrix = MarkerMatrix(packed, "bed", np.array([y is not None for y in Y]))
    assert matrix.times(np.array([1.0, -2.0, 0.5])) == pytest.approx(want, abs=1e-6)
    y = np.array([0 if v is None else v for v in Y]) / np.std([v for v in Y if v is not None], ddof=1)
    assert matrix.transpose_times(y) == pytest.approx([-1.168613, 0, 0.356348], abs=1e-6)


def _dense(spark, n=60, m=20, seed=3):
    cells = simulate.dense_cells(spark, n, m, seed)
    values = np.zeros((n, m))
    for r in cells.collect():
        values[r["sample_idx"], r["marker_idx"]] = r["value"]
    z = (values - values.mean(axis=0)) / values.std(axis=0, ddof=1) / np.sqrt(n)
    pheno = spark.range(n).select(F.col("id").alias("sample_idx"), F.lit(1.0).alias("y"))
    return cells, pheno, z, MarkerMatrix.from_cells(cells, pheno)


def test_solvers_agree_with_direct_ones(spark):
    _, _, a, matrix = _dense(spark)
    rng = np.random.default_rng(1)
    u, x, r2 = rng.normal(size=60), rng.normal(size=20), rng.normal(size=20)
    assert matrix.times(x) @ u == pytest.approx(x @ matrix.transpose_times(u))
    q = 1.5 * a.T @ a + 0.7 * np.eye(20)
    want = np.linalg.solve(q, 1.5 * a.T @ u + 0.7 * r2)
    got, alpha, probe, solved = solvers.lmmse(matrix, 1.5, 0.7, u, r2)
    assert got == pytest.approx(want, abs=1e-4)
    assert alpha == pytest.approx(0.7 * probe @ np.linalg.solve(q, probe), abs=1e-4)
    by_samples, _ = solvers.lmmse_by_samples(matrix, 1.5, 0.7, u, r2)
    assert by_samples == pytest.approx(want, abs=1e-3)
    two = matrix.times(np.stack([x, r2], axis=1))
    assert two[:, 1] == pytest.approx(matrix.times(r2))


def test_leave_one_out_is_the_explicit_test(spark):
    cells, pheno, a, _ = _dense(spark)
    n, rng = 60, np.random.default_rng(2)
    x, e = rng.normal(size=20), rng.normal(size=n)
    z = op.standardised(cells, op.marker_stats(cells, pheno))
    residual = spark.createDataFrame([(i, float(v)) for i, v in enumerate(e)], "sample_idx long, e double")
    effects = spark.createDataFrame([(j, float(v)) for j, v in enumerate(x)], "marker_idx long, x double")
    got = association.leave_one_out(z, residual, effects, n).orderBy("marker_idx").collect()
    for j, row in enumerate(got):
        r = np.corrcoef(a[:, j], e + a[:, j] * x[j])[0, 1]
        assert row["t"] == pytest.approx(r * np.sqrt((n - 2) / (1 - r * r)), rel=1e-6)
    chrom = spark.createDataFrame([(j, 1 if j < 10 else 30) for j in range(20)], "marker_idx long, chrom int")
    loco = {r["marker_idx"]: r["t"] for r in association.leave_one_chromosome_out(z, residual, effects, chrom, n).collect()}
    r = np.corrcoef(a[:, 4], e + a[:, :10] @ x[:10])[0, 1]
    assert loco[4] == pytest.approx(r * np.sqrt((n - 2) / (1 - r * r)), rel=1e-6)
    assert loco[15] is None


def test_chromosomes_are_left_out_a_few_at_a_time(spark, monkeypatch):
    """Whatever is broadcast at a time, tests are the same, also with chromosomes in pieces."""
    _, _, a, matrix = _dense(spark)
    rng = np.random.default_rng(2)
    x, residual = rng.normal(size=(20, 3)), rng.normal(size=(60, 3))
    chrom = np.array([1, 1, 2, 2, 2, 3, 1, 1, 30, 30, 4, 4, 4, 5, 5, 2, 2, 3, 3, 3])
    rows = lambda: sorted((r["it"], r["marker_idx"], r["chrom"], r["n"], None if r["t"] is None else round(r["t"], 9)) for r in association.packed_leave_one_chromosome_out(matrix, residual, x, chrom, 4).collect())
    want = rows()
    assert len(want) == 60 and {r[0] for r in want} == {4, 5, 6}
    for room in (1, 2, 4, 6, 13):
        monkeypatch.setattr(association, "PREDICTOR_BYTES", 8 * 60 * room)
        assert rows() == want


class Dense:
    """A matrix in memory with the products of MarkerMatrix."""

    def __init__(self, a):
        self.a, (self.n_samples, self.n_markers) = a, a.shape
        self.present = np.ones(len(a), bool)

    def times(self, x):
        return self.a @ x

    def transpose_times(self, u):
        return self.a.T @ u

    def sample_diagonal(self):
        return (self.a**2).sum(axis=1)

    def sample_range(self, start, end):
        part = Dense(self.a[start:end] * np.sqrt(self.n_samples / (end - start)))
        part.present = self.present[start:end]
        return part


def _simulated(n, m, causal, h2, seed):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, m))
    z = (z - z.mean(axis=0)) / z.std(axis=0, ddof=1)
    beta = np.zeros(m)
    beta[rng.choice(m, causal, replace=False)] = rng.normal(0, np.sqrt(h2 / causal), causal)
    return z / np.sqrt(n), z @ beta, beta, rng


def _cosine(a, b):
    return a @ b / np.linalg.norm(a) / np.linalg.norm(b)


def test_linear_model_finds_the_truth():
    a, signal, beta, rng = _simulated(2000, 1000, 50, 0.5, 1)
    y = signal + rng.normal(0, np.sqrt(0.5), 2000)
    prior = Prior((0.9, 0.05, 0.03, 0.02), (0.0, 1e-4, 1e-3, 1e-2))
    fit = models.fit(Dense(a), y / y.std(ddof=1), prior, models.Options(iterations=30))
    r2 = {it: v for it, name, v in fit.trace if name == "r2_x1"}
    assert not fit.estimates[0].any() and r2[1] == 0
    assert [_cosine(fit.estimates[it - 1], beta) > 0.95 for it in (2, 5, 10, 20)] == [True] * 4
    assert [r2[it] for it in (2, 5, 10, 20)] == pytest.approx([0.159, 0.368, 0.536, 0.599], abs=0.1)
    assert sum(fit.prior.probs) == pytest.approx(1)


@pytest.mark.parametrize("model", ["bin_class", "robust"])
def test_other_likelihoods_find_the_truth(model):
    a, signal, beta, rng = _simulated(2000, 1000, 50, 0.5, 1)
    prior = Prior((0.9, 0.05, 0.03, 0.02), (0.0, 1e-4, 1e-3, 1e-2))
    noisy = signal + (rng.normal(0, 0.6, 2000) if model == "bin_class" else 0.5 * rng.standard_t(2, 2000))
    y = (noisy > 0).astype(float) if model == "bin_class" else noisy
    fit = models.fit(Dense(a), y, prior, models.Options(model=model, iterations=6, delta=1.0))
    assert _cosine(fit.effects, beta) > 0.9


@pytest.mark.parametrize("model", ["linear", "bin_class", "robust"])
def test_the_cluster_fits_as_memory_does(spark, model):
    _, _, a, matrix = _dense(spark)
    rng = np.random.default_rng(9)
    y = a @ rng.normal(size=20) + rng.normal(0, 0.3, 60)
    y = (y > 0).astype(float) if model == "bin_class" else y / y.std(ddof=1)
    prior = Prior((0.8, 0.2), (0.0, 1e-2))
    fits = [models.fit(x, y, prior, models.Options(model=model, iterations=3, delta=1.0)) for x in (matrix, Dense(a))]
    assert fits[0].effects == pytest.approx(fits[1].effects, rel=1e-4, abs=1e-7)


@pytest.mark.parametrize("model", ["linear", "by samples", "bin_class", "robust"])
def test_vectors_on_the_cluster_give_the_same_fit(spark, model):
    """Effects, precisions and the prior of three iterations, with a start, frozen markers and the truth."""
    _, _, a, matrix = _dense(spark)
    rng = np.random.default_rng(9)
    truth = rng.normal(size=20) * (np.arange(20) % 3 == 0)
    y = a @ truth + rng.normal(0, 0.3, 60)
    y = (y > 0).astype(float) if model == "bin_class" else y / y.std(ddof=1)
    options = models.Options(model="linear" if model == "by samples" else model, by_samples=model == "by samples", iterations=3 if model == "linear" else 2, delta=1.0, gram=False, cg_rounds=5)
    given = {"frozen": np.arange(20) == 4, "start": rng.normal(size=20) / 50, "truth": truth}
    one, two = (models.fit(matrix, y, Prior((0.8, 0.2), (0.0, 1e-2)), options, on_cluster=c, **given) for c in (False, True))
    assert two.effects is None and not two.estimates
    rows = two.table(spark).orderBy("it", "marker_idx").collect()
    for name, want in (("beta", one.estimates), ("r1", one.r1)):
        got = np.array([r[name] for r in rows]).reshape(len(want), -1)
        assert got == pytest.approx(np.stack(want), rel=1e-8, abs=1e-8)
    assert [t[:2] for t in one.trace] == [t[:2] for t in two.trace]
    assert [t[2] for t in two.trace] == pytest.approx([t[2] for t in one.trace], rel=1e-6, abs=1e-9)
    assert two.prior.probs == pytest.approx(one.prior.probs) and two.prior.variances == pytest.approx(one.prior.variances)
    again = one.table(spark).orderBy("it", "marker_idx").collect()
    assert [r["marker_idx"] for r in again] == [r["marker_idx"] for r in rows] and [r["it"] for r in again] == [r["it"] for r in rows]


@pytest.mark.parametrize("kind", ["bed", "dense"])
def test_sample_ranges_of_packed_payloads(spark, kind):
    """Products over a range are those of its decoded cells, at any offset within a byte."""
    from tesserix.operators.matrix import pack_dosages

    rng = np.random.default_rng(6)
    cells = rng.choice([0.0, 1.0, 2.0, np.nan], size=(7, 41)) if kind == "bed" else rng.normal(size=(7, 41))
    payload = pack_dosages if kind == "bed" else lambda v: v.astype("<f8").tobytes()
    packed = spark.createDataFrame([(j, bytearray(payload(v))) for j, v in enumerate(cells)], "marker_idx long, payload binary")
    present = rng.random(41) > 0.2
    matrix = MarkerMatrix(packed, kind, present)
    stats = matrix.rows.orderBy("marker_idx").collect()
    z = (cells - np.array([[r["mu"]] for r in stats])) * np.array([[r["isd"]] for r in stats])
    z = np.where(np.isnan(z) | ~present, 0.0, z)
    x, u = rng.normal(size=7), rng.normal(size=41)
    table = spark.createDataFrame([(j, float(v)) for j, v in enumerate(x)], "marker_idx long, x double")
    for a, b in ((0, 41), (0, 8), (4, 12), (5, 6), (3, 41), (18, 39)):
        part, own = matrix.sample_range(a, b), z[:, a:b]
        assert part.times(x) == pytest.approx(own.T @ x / np.sqrt(b - a))
        assert part.transpose_times(u[a:b]) == pytest.approx(own @ u[a:b] / np.sqrt(b - a))
        assert part.gram_times(u[a:b]) == pytest.approx(own.T @ (own @ u[a:b]) / (b - a))
        assert part.times_columns(table, ["x"])[:, 0] == pytest.approx(own.T @ x / np.sqrt(b - a))
    assert matrix.sample_range(8, 40).sample_range(3, 9).times(x) == pytest.approx(z[:, 11:17].T @ x / np.sqrt(6))
    for a, b in ((-1, 3), (3, 3), (0, 42)):
        with pytest.raises(ValueError, match="no samples"):
            matrix.sample_range(a, b)


@pytest.mark.parametrize("kind", ["bed", "dense"])
def test_gram_is_a_product_of_decoded_cells(spark, kind, monkeypatch):
    from tesserix.operators import matrix as packed_matrix

    monkeypatch.setattr(packed_matrix, "SEGMENT", 8)
    rng = np.random.default_rng(6)
    cells = rng.choice([0.0, 1.0, 2.0, np.nan], size=(7, 41)) if kind == "bed" else rng.normal(size=(7, 41))
    payload = packed_matrix.pack_dosages if kind == "bed" else lambda v: v.astype("<f8").tobytes()
    packed = spark.createDataFrame([(j, bytearray(payload(v))) for j, v in enumerate(cells)], "marker_idx long, payload binary")
    matrix = MarkerMatrix(packed, kind, rng.random(41) > 0.2)
    for part in (matrix, matrix.sample_range(12, 39)):
        a = part.transpose_times(np.eye(part.n_samples))
        got = {(r["i"], r["j"]): r["value"] for r in part.gram().collect()}
        want = a @ a.T
        assert got == {(i, j): pytest.approx(want[i, j], abs=1e-12) for i in range(7) for j in range(i, 7)}


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("gaps", [False, True])
def test_cells_are_packed_by_segments_of_samples(spark, monkeypatch, few, gaps):
    """No payload has more samples than a segment, and products are those of the whole matrix: with ids
    in a row or not, missing cells, cells without a row, samples without a phenotype."""
    from tesserix.operators import markers, matrix as packed_matrix

    monkeypatch.setattr(packed_matrix, "SEGMENT", 8)
    monkeypatch.setattr(packed_matrix, "SEGMENT_MARKERS", 2048 if few else 0)
    rng = np.random.default_rng(6)
    values, present = rng.normal(5, 1, size=(7, 41)), rng.random(41) > 0.2
    values[rng.random(values.shape) < 0.1] = np.nan
    values[3, 8:16] = np.nan
    ids = [3 * s + s % 2 if gaps else s + 100 for s in range(41)]
    rows = [(ids[s], j, None if np.isnan(v) else float(v)) for j in range(7) for s, v in enumerate(values[j]) if not (j == 3 and 8 <= s < 16)]
    cells = spark.createDataFrame(rows, "sample_idx long, marker_idx long, value double")
    pheno = spark.createDataFrame([(i, 1.0 if p else None) for i, p in zip(ids, present)], "sample_idx long, y double")
    matrix = MarkerMatrix.from_cells(cells, pheno)
    assert max(len(r["payload"]) for r in matrix.rows.collect()) == 8 * 8 and matrix.sample_ids == ids
    known = np.where(present, values, np.nan)
    mean = np.nanmean(known, axis=1, keepdims=True)
    z = (values - mean) / np.sqrt(np.nansum((known - mean) ** 2, axis=1, keepdims=True) / (present.sum() - 1))
    z = np.where(np.isnan(z) | ~present, 0.0, z)
    x, u = rng.normal(size=(7, 2)), rng.normal(size=(41, 2))
    for a, b in ((0, 41), (3, 30)):
        part, own = matrix.sample_range(a, b), z[:, a:b] / np.sqrt(b - a)
        assert part.times(x) == pytest.approx(own.T @ x) and part.transpose_times(u[a:b]) == pytest.approx(own @ u[a:b])
        assert part.gram_times(u[a:b]) == pytest.approx(own.T @ (own @ u[a:b])) and part.sample_diagonal() == pytest.approx((own**2).sum(axis=0))
        assert {(r["i"], r["j"]): r["value"] for r in part.gram().collect()} == {(i, j): pytest.approx((own @ own.T)[i, j]) for i in range(7) for j in range(i, 7)}
    tests = [{(r["marker_idx"], r["it"]): (r["n"], r["t"]) for r in association.packed_leave_one_out(m, u, x).collect()} for m in (matrix, MarkerMatrix(
        spark.createDataFrame([(j, bytearray(v.astype("<f8").tobytes())) for j, v in enumerate(values)], "marker_idx long, payload binary"), "dense", present))]
    assert tests[0] == {k: (n, pytest.approx(t)) for k, (n, t) in tests[1].items()}
    vectors = markers.ClusterMarkers(matrix)
    vectors.transpose_times("b", u[:, 0])
    assert [r["b"] for r in vectors.table.orderBy("marker_idx").collect()] == pytest.approx(z @ u[:, 0] / np.sqrt(41))
    assert vectors.times("b")[:, 0] == pytest.approx(z.T @ (z @ u[:, 0]) / 41)
    with pytest.raises(Exception, match="no phenotype row"):
        MarkerMatrix.from_cells(cells, pheno.where(F.col("sample_idx") != ids[20]))


@pytest.mark.parametrize("few", [True, False])
def test_workers_have_their_segments_part_of_sample_vectors(spark, monkeypatch, few):
    """Nothing as long as the samples is broadcast to Python workers for a product of several segments, where
    vectors are long, nor which samples are present."""
    import pickle

    from pyspark import SparkContext

    from tesserix.operators import markers, matrix as packed_matrix

    monkeypatch.setattr(packed_matrix, "SEGMENT", 128)
    monkeypatch.setattr(packed_matrix, "WHOLE_BYTES", 0)
    monkeypatch.setattr(packed_matrix, "SEGMENT_MARKERS", 2048 if few else 0)
    n, rng = 3000, np.random.default_rng(8)
    values, present = rng.normal(5, 1, size=(3, n)), rng.random(n) > 0.2
    cells = spark.createDataFrame([(s, j, float(v)) for j in range(3) for s, v in enumerate(values[j])], "sample_idx long, marker_idx long, value double")
    pheno = spark.createDataFrame([(s, 1.0 if p else None) for s, p in enumerate(present)], "sample_idx long, y double")
    matrix = MarkerMatrix.from_cells(cells, pheno)
    known = values[:, present]
    z = np.where(present, (values - known.mean(axis=1, keepdims=True)) / known.std(axis=1, ddof=1, keepdims=True), 0.0)
    u, x, sizes = rng.normal(size=(n, 2)), rng.normal(size=3), []
    plain = SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: (sizes.append(len(pickle.dumps(value))), plain(self, value))[1])
    for a, b in ((0, n), (100, 2601)):
        part, own = matrix.sample_range(a, b), z[:, a:b] / np.sqrt(b - a)
        assert part.times(x) == pytest.approx(own.T @ x) and part.transpose_times(u[a:b]) == pytest.approx(own @ u[a:b])
        assert part.sample_diagonal() == pytest.approx((own**2).sum(axis=0))
        if few:
            q, back = part.samples_step(u[a:b, 0], 1 + u[a:b, 1] ** 2, x, 1.5, 0.7)
            assert q == pytest.approx(1.5 * (x @ own) + 0.7 * u[a:b, 0]) and back == pytest.approx(own @ (q / (1 + u[a:b, 1] ** 2)))
            assert {(r["i"], r["j"]): r["value"] for r in part.gram().collect()} == {(i, j): pytest.approx((own @ own.T)[i, j]) for i in range(3) for j in range(i, 3)}
    vectors = markers.ClusterMarkers(matrix)
    vectors.transpose_times("b", u[:, 0])
    assert vectors.times("b")[:, 0] == pytest.approx(z.T @ (z @ u[:, 0]) / n)
    assert sizes and max(sizes) < n


def test_solves_by_samples_pass_once_a_round(spark, monkeypatch):
    """The rounds of conjugate gradients are the plain ones, and each passes over the segments once."""
    from tesserix.operators import matrix as packed_matrix

    monkeypatch.setattr(packed_matrix, "SEGMENT", 16)
    _, _, a, matrix = _dense(spark)
    passes = []
    for name in ("transpose_times", "times", "samples_step"):
        plain = getattr(MarkerMatrix, name)
        monkeypatch.setattr(MarkerMatrix, name, lambda self, *given, plain=plain, name=name: (passes.append(name), plain(self, *given))[1])
    rng = np.random.default_rng(4)
    target, r2, start = rng.normal(size=60), rng.normal(size=20), rng.normal(size=60)
    for begin, rounds in ((None, 1), (None, 7), (start, 7), (start, 60)):
        want = solvers.lmmse_by_samples(Dense(a), 1.5, 0.7, target, r2, begin, rounds)
        passes.clear()
        got = solvers.lmmse_by_samples(matrix, 1.5, 0.7, target, r2, begin, rounds)
        assert got[0] == pytest.approx(want[0], rel=1e-8, abs=1e-10) and got[1] == pytest.approx(want[1], rel=1e-8, abs=1e-10)
        assert passes.count("transpose_times") <= 3 and passes.count("times") <= 2 and passes.count("samples_step") <= min(rounds, 20)
    passes.clear()
    gram = solvers.Gram(matrix)
    assert solvers.probe_trace(matrix, 1.5, 0.7, gram=gram)[2] == pytest.approx(solvers.probe_trace(Dense(a), 1.5, 0.7)[2], rel=1e-8)
    assert not passes


def test_fits_by_way_of_the_gram_matrix(spark):
    """Chosen by the number of markers, and the same as by conjugate gradients to their tolerance."""
    _, _, a, matrix = _dense(spark)
    y = a @ np.random.default_rng(9).normal(size=20)
    y = y / y.std(ddof=1)
    prior = Prior((0.8, 0.2), (0.0, 1e-2))
    one, two, three = (models.fit(matrix, y, prior, models.Options(iterations=3, gram=g)) for g in (False, True, None))
    assert two.effects == pytest.approx(one.effects, rel=1e-3, abs=1e-6) and three.effects.tolist() == two.effects.tolist()
    q = 1.5 * a.T @ a + 0.7 * np.eye(20)
    assert solvers.Gram(matrix).solve(1.5, 0.7, np.ones(20)) == pytest.approx(np.linalg.solve(q, np.ones(20)))


@pytest.mark.parametrize("model", ["linear", "by samples", "held out", "bin_class", "robust"])
def test_a_fit_goes_on_from_its_last_commit(tmp_path, model, monkeypatch):
    """Two iterations and three more are five to the bit, also when the third was lost before its commit."""
    from tesserix.operators import commits

    a, signal, beta, rng = _simulated(300, 120, 10, 0.5, 1)
    y = signal + rng.normal(0, np.sqrt(0.5), 300)
    y = (y > 0).astype(float) if model == "bin_class" else y / y.std(ddof=1)
    kind = model if model in ("bin_class", "robust") else "linear"
    options = lambda k: models.Options(
        model=kind, iterations=k, delta=1.0, stop=0.0, by_samples=model == "by samples", hold_out=0.1 if model == "held out" else 0.0, lmmse_damping=True
    )
    fit = lambda k, **more: models.fit(Dense(a), y, Prior((0.8, 0.2), (0.0, 1e-2)), options(k), **more)
    whole, path = fit(5), str(tmp_path / "commits")
    begun = fit(2, commits=path)
    assert begun.first == 1 and len(begun.estimates) == 2
    real = commits.Commits.save

    def lost(self, it, scalars, vectors, arrays):
        # the vectors are written, but what names them isn't
        vectors.save(f"{self.path}/it-{it:06d}-lost-vectors", ("r1", "x1", "x2"))
        raise RuntimeError("lost")

    monkeypatch.setattr(commits.Commits, "save", lost)
    with pytest.raises(RuntimeError, match="lost"):
        fit(5, commits=path)
    monkeypatch.setattr(commits.Commits, "save", real)
    later = fit(5, commits=path)
    assert later.first == 3
    assert [x.tolist() for x in begun.estimates + later.estimates] == [x.tolist() for x in whole.estimates]
    assert later.effects.tolist() == whole.effects.tolist() and later.prior == whole.prior
    assert begun.trace + later.trace == whole.trace
    # nothing is left to do
    assert fit(5, commits=path).effects.tolist() == whole.effects.tolist()


def test_a_fit_on_the_cluster_goes_on_from_its_last_commit(spark, tmp_path):
    _, _, a, matrix = _dense(spark)
    y = a @ np.random.default_rng(9).normal(size=20)
    y = y / y.std(ddof=1)
    fit = lambda k, **more: models.fit(matrix, y, Prior((0.8, 0.2), (0.0, 1e-2)), models.Options(iterations=k, cg_rounds=4), on_cluster=True, **more)
    fit(1, commits=str(tmp_path / "c"))
    later = fit(2, commits=str(tmp_path / "c"))
    rows, whole = (f.table(spark).where("it = 2").orderBy("marker_idx").collect() for f in (later, fit(2)))
    assert [r["beta"] for r in rows] == pytest.approx([r["beta"] for r in whole], rel=1e-8, abs=1e-10)
    assert later.first == 2 and {r["it"] for r in later.table(spark).collect()} == {2}


def _correlated(n, m, seed):
    """Markers in blocks that are nearly the same, with a part that all share: without damping, messages diverge."""
    rng = np.random.default_rng(seed)
    z = np.repeat(rng.normal(size=(n, m // 10)), 10, axis=1) + 0.25 * rng.normal(size=(n, m)) + 3 * rng.normal(size=(n, 1))
    z = (z - z.mean(axis=0)) / z.std(axis=0, ddof=1)
    beta = np.zeros(m)
    beta[rng.choice(m, m // 20, replace=False)] = rng.normal(0, 0.2, m // 20)
    signal = z @ beta
    y = signal + rng.normal(0, signal.std(), n)
    return z / np.sqrt(n), y / y.std(ddof=1)


def test_damping_by_held_out_samples_converges_where_a_fixed_one_fails():
    a, y = _correlated(600, 400, 2)
    prior, options = Prior((0.95, 0.05), (0.0, 4e-2)), {"iterations": 25, "rho": 1.0, "stop": 0.0, "learn_variances": False}
    fixed = models.fit(Dense(a).sample_range(0, 540), y[:540], prior, models.Options(**options))
    chosen = models.fit(Dense(a), y, prior, models.Options(hold_out=0.1, **options))
    z = a[540:] * np.sqrt(600)
    r2 = lambda x: 1 - ((y[540:] - z @ x) ** 2).sum() / ((y[540:] - y[540:].mean()) ** 2).sum()
    held = [v for _, name, v in chosen.trace if name == "r2_held_out"]
    # never worse than the last, and what the trace tells is what the estimates do
    assert all(b >= a - 1e-12 for a, b in zip(held, held[1:]))
    assert [r2(x) for x in chosen.estimates] == pytest.approx(held, abs=1e-9) and held[-1] > 0.4
    assert min(r2(x) for x in fixed.estimates[-4:]) < -5


def test_held_out_and_reduced_fits_are_the_same_on_the_cluster(spark):
    _, _, a, matrix = _dense(spark)
    y = a @ np.random.default_rng(9).normal(size=20)
    y = y / y.std(ddof=1)
    for options in (models.Options(iterations=2, hold_out=0.2, gram=False, cg_rounds=4), models.Options(iterations=2, reduced=True, cg_rounds=4)):
        one, two = (models.fit(matrix, y, Prior((0.8, 0.2), (0.0, 1e-2)), options, on_cluster=c) for c in (False, True))
        got = [r["beta"] for r in two.table(spark).where("it = 2").orderBy("marker_idx").collect()]
        assert got == pytest.approx(one.effects, rel=1e-8, abs=1e-8)
        assert [t[2] for t in two.trace] == pytest.approx([t[2] for t in one.trace], rel=1e-6, abs=1e-9)
    with pytest.raises(ValueError, match="only the linear"):
        models.fit(matrix, y, Prior((0.8, 0.2), (0.0, 1e-2)), models.Options(model="robust", reduced=True))


def test_solving_over_tenths_finds_the_truth():
    a, signal, beta, rng = _simulated(2000, 200, 10, 0.8, 1)
    y = signal + rng.normal(0, np.sqrt(0.2), 2000)
    fit = models.fit(Dense(a), y / y.std(ddof=1), Prior((0.95, 0.05), (0.0, 8e-2)), models.Options(iterations=12, reduced=True))
    assert _cosine(fit.effects, beta) > 0.9


def test_a_denoiser_of_the_user_runs_on_the_cluster(spark):
    """The prior's own, as a user would give it, and a soft threshold, on Arrow batches of the table."""
    from tesserix.operators import markers

    _, _, a, matrix = _dense(spark)
    y = a @ np.random.default_rng(9).normal(size=20)
    prior = Prior((0.8, 0.2), (0.0, 1e-2))
    own = lambda r, gamma: markers.denoise(r, gamma, prior.scaled(60))
    soft = lambda r, gamma: (np.sign(r) * np.maximum(np.abs(r) - 0.01, 0), (np.abs(r) > 0.01) + 1e-3)
    for denoiser in (own, soft):
        fits = [models.fit(matrix, y, prior, models.Options(iterations=2, gram=False, cg_rounds=4), denoiser=denoiser, on_cluster=c) for c in (False, True)]
        got = [r["beta"] for r in fits[1].table(spark).where("it = 2").orderBy("marker_idx").collect()]
        assert got == pytest.approx(fits[0].effects, rel=1e-8, abs=1e-8)


def test_payloads_stay_where_they_are(spark):
    """Tables of markers are brought to the matrix: its side of the join has no exchange."""
    _, _, a, matrix = _dense(spark)
    matrix.partition_by_marker()
    table = spark.createDataFrame([(j, float(j)) for j in range(20)], "marker_idx long, x double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = matrix.rows.join(table, "marker_idx")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    own = [x for x in lines if x.lstrip().startswith(":")]
    cached = next(k for k, x in enumerate(own) if "InMemoryRelation" in x)
    assert not any("Exchange" in x or "Sort " in x for x in own[:cached])
    assert any("SortMergeJoin" in x for x in lines) and any(x.lstrip().startswith("+- Exchange hashpartitioning(marker_idx") for x in lines)
    assert matrix.times_columns(table, ["x"])[:, 0] == pytest.approx(a @ np.arange(20.0))
    u = np.random.default_rng(3).normal(size=60)
    assert matrix.gram_times(u) == pytest.approx(a @ (a.T @ u))


def test_tables_of_a_fit_are_deleted(spark):
    from tesserix.operators import markers
    from tesserix.sources import genomics

    _, _, _, matrix = _dense(spark)
    v = markers.ClusterMarkers(matrix)
    for _ in range(3):
        v.put("x1", None)
        v.put("r1", None)
        v.settle("x1", "r1")
    v.keep(1, 1.0)
    files, name = genomics.opened(v.folder)
    import pyarrow.fs as pafs

    assert sorted(f.base_name for f in files.get_file_info(pafs.FileSelector(name))) == ["3", "series"]


def test_probit_fit_takes_covariates_as_a_table(spark):
    _, _, a, matrix = _dense(spark)
    rng = np.random.default_rng(4)
    z = np.column_stack([np.ones(60), rng.normal(size=60)])
    y = (a @ rng.normal(size=20) + z @ [0.3, -0.8] + rng.normal(size=60) > 0).astype(float)
    table = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(z)], "sample_idx long, z array<double>").repartition(3)
    one, two = (models.fit(matrix, y, Prior((0.8, 0.2), (0.0, 1e-2)), models.Options(model="bin_class", iterations=2), covariates=c) for c in (z, table))
    assert two.covariate_effects == pytest.approx(one.covariate_effects, abs=1e-7)
    assert two.effects == pytest.approx(one.effects, rel=1e-5, abs=1e-9)
    assert models.covariate_offset(table, [2.0, -1.0], 60) == pytest.approx(z @ [2.0, -1.0])


def test_huber_threshold_is_learnt_on_the_cluster(spark):
    """The loss of each threshold is its mean over draws, as an average in memory has it."""
    from tesserix.operators import evaluate

    rng = np.random.default_rng(4)
    p, y, tau = rng.normal(size=50), rng.normal(size=50), 2.0
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, y))], "idx long, p double, y double")
    got = {r["delta"]: r["loss"] for r in evaluate.expected_huber_loss(points, tau, list(models.DELTAS), 400).collect()}
    w = np.abs(y - p - rng.normal(0, 1 / np.sqrt(tau), (4000, 50)))
    for d in models.DELTAS:
        assert got[d] == pytest.approx(np.where(w <= d, w * w / 2, d * (w - d / 2)).mean(), rel=0.03)
    assert models.huber_delta(p, tau, y, spark=spark) == models.huber_delta(p, tau, y) == models.DELTAS[0]
    _, _, a, matrix = _dense(spark)
    target = a @ rng.normal(size=20)
    fit = models.fit(matrix, target / target.std(ddof=1), Prior((0.8, 0.2), (0.0, 1e-2)), models.Options(model="robust", iterations=1, learn_delta=True, delta=1.0))
    assert [v for _, name, v in fit.trace if name == "delta"] == [models.DELTAS[0]]


def test_bucketed_cells_stay_where_they_are(spark):
    from tesserix.operators.cell_tables import CellTables

    cells, pheno, a, _ = _dense(spark)
    tables = CellTables(cells, pheno, 4)
    rng = np.random.default_rng(5)
    u, x = rng.normal(size=60), rng.normal(size=20)
    table = lambda v, index, name: spark.createDataFrame([(k, float(e)) for k, e in enumerate(v)], f"{index} long, {name} double")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in (before, "100"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            for product, want, side in ((tables.at_x(table(u, "sample_idx", "u")), a.T @ u, "sample"), (tables.a_x(table(x, "marker_idx", "x")), a @ x, "marker")):
                assert [r["value"] for r in product.orderBy(product.columns[0]).collect()] == pytest.approx(want)
                exchanges = [line for line in plan(product).splitlines() if "Exchange hashpartitioning" in line]
                # the vector and the partial sums, if the vector is long
                assert len(exchanges) == (0 if limit == before else 2)
                if limit != before:
                    other = "marker" if side == "sample" else "sample"
                    assert [f"hashpartitioning({other}_idx" in e for e in exchanges].count(True) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    tables.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cells_by_")]


def test_state_evolution_tells_a_fit_s_mean_derivatives():
    """Of a fit over a random matrix, with the prior that effects were drawn from."""
    from tesserix.operators import markers, state_evolution as se

    n, m = 3000, 2000
    rng = np.random.default_rng(8)
    z = rng.normal(size=(n, m))
    z = (z - z.mean(axis=0)) / z.std(axis=0, ddof=1)
    prior = Prior((0.9, 0.1), (0.0, 0.5 / (0.1 * m)))
    beta = np.where(rng.random(m) < 0.1, rng.normal(0, np.sqrt(0.5 / (0.1 * m)), m), 0.0)
    y = z @ beta + rng.normal(0, np.sqrt(0.5), n)
    fit = models.fit(Dense(z / np.sqrt(n)), y, prior, models.Options(iterations=6, rho=1.0, em_rounds=0, gamw=2.0, learn_variances=False))
    traced = {name: {it: v for it, k, v in fit.trace if k == name} for name in ("alpha1", "gam1")}
    for it in range(2, 7):
        step = se.denoising_step(traced["gam1"][it], prior.scaled(n))
        assert step.alpha == pytest.approx(traced["alpha1"][it], rel=0.05)
        assert step.eta == pytest.approx(traced["gam1"][it] / step.alpha) and step.gamma == pytest.approx(step.eta - traced["gam1"][it])
    # quadrature against plain averages, damping, and the other step against its trace
    draws = rng.normal(size=400_000) * np.sqrt(np.where(rng.random(400_000) < 0.1, prior.variances[1] * n, 0) + 1 / 2.0)
    assert se.mean_slope(2.0, prior.scaled(n)) == pytest.approx(markers.denoise(draws, 2.0, prior.scaled(n))[1].mean(), rel=0.01)
    damped = se.denoising_step(2.0, prior.scaled(n), 0.25, 3.0)
    assert damped.alpha == pytest.approx(0.25 * se.mean_slope(2.0, prior.scaled(n)) + 0.75 * se.mean_slope(3.0, prior.scaled(n)))
    spectrum = np.linalg.eigvalsh(z.T @ z / n)
    assert se.lmmse_step(0.7, 2.0, spectrum).alpha == pytest.approx(0.7 * np.trace(np.linalg.inv(2.0 * z.T @ z / n + 0.7 * np.eye(m))) / m)
    path = se.trajectory(traced["gam1"][2], 2.0, prior.scaled(n), spectrum, 8)
    assert path[-1][0].alpha == pytest.approx(path[-2][0].alpha, rel=1e-2) and path[-1][0].alpha == pytest.approx(traced["alpha1"][6], rel=0.1)


def test_probit_variance_is_recovered(spark):
    rng = np.random.default_rng(12)
    z = rng.normal(0, 2, 40_000)
    for planted in (0.3, 2.5):
        y = (z + np.sqrt(planted) * rng.normal(size=len(z)) > 0).astype(float)
        got = models.probit_variance((z, y))
        assert got == pytest.approx(planted, rel=0.1)
    import pandas as pd

    table = spark.createDataFrame(pd.DataFrame({"z": z, "y": y})).repartition(5).unionAll(spark.createDataFrame([(None, 1.0), (1.0, None)], "z double, y double"))
    assert models.probit_variance(table) == pytest.approx(got, rel=1e-9)
    # latent values that are known with some noise: quadrature against draws
    few = slice(0, 400)
    want = np.mean([models._variance_scores(z[few] + rng.normal(0, 0.5, 400), y[few], np.array([0.5, 2.0]), None) for _ in range(2000)], axis=0)
    assert models._variance_scores(z[few], y[few], np.array([0.5, 2.0]), 4.0) == pytest.approx(want, rel=0.02, abs=0.3)
    # no sign change: the bound that the likelihood tends to
    assert models.probit_variance((np.ones(50), np.ones(50))) == 1e-4
    assert models.probit_variance((np.ones(50), np.zeros(50))) == 1e4


def test_probit_fit_learns_its_noise_variance(spark):
    _, _, a, matrix = _dense(spark)
    rng = np.random.default_rng(4)
    y = (a @ rng.normal(size=20) * 3 + rng.normal(size=60) > 0).astype(float)
    options = lambda learn: models.Options(model="bin_class", iterations=2, learn_probit_variance=learn)
    one, two = (models.fit(x, y, Prior((0.8, 0.2), (0.0, 1e-2)), options(True)) for x in (matrix, Dense(a)))
    learnt = [[v for _, name, v in f.trace if name == "probit_variance"] for f in (one, two)]
    assert len(learnt[0]) == 1 and learnt[0] == pytest.approx(learnt[1], rel=1e-3)
    assert not any(name == "probit_variance" for _, name, _ in models.fit(Dense(a), y, Prior((0.8, 0.2), (0.0, 1e-2)), options(False)).trace)


def test_probit_covariates():
    rng = np.random.default_rng(4)
    z = np.column_stack([np.ones(4000), rng.normal(size=4000)])
    y = (z @ [0.3, -0.8] + rng.normal(size=4000) > 0).astype(float)
    assert models.probit_covariates(y, z) == pytest.approx([0.3, -0.8], abs=0.1)


def test_simulation_ignores_partitions(spark):
    prior = Prior((0.5, 0.5), (0.0, 2.0))
    draws = simulate.mixture(spark, 4000, prior)
    again = draws.repartition(13).orderBy("idx").collect()
    assert again == draws.orderBy("idx").collect()
    values = np.array([r["value"] for r in again])
    assert (values == 0).mean() == pytest.approx(0.5, abs=0.05) and values.var() == pytest.approx(1.0, abs=0.15)
