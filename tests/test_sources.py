import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserix import cli
from tesserix.sources import genomics


def test_vectors(spark, tmp_path):
    path = str(tmp_path / "v.bin")
    values = np.random.default_rng(1).normal(size=1000)
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx long, value double")
    genomics.write_vector(table.repartition(7), path)
    assert np.fromfile(path, "<f8").tolist() == values.tolist()
    assert [r["value"] for r in genomics.read_vector(spark, path, 10, 5).orderBy("idx").collect()] == values[10:15].tolist()
    genomics.write_text_vector(table, str(tmp_path / "v.txt"))
    (tmp_path / "w.txt").write_text("1 2\n\n3.5\n")
    assert [tuple(r) for r in genomics.read_text_vector(spark, str(tmp_path / "w.txt")).orderBy("idx").collect()] == [(0, 1.0), (1, 2.0), (2, 3.5)]


class _Counted:
    """A file system that tells how many bytes were read."""

    def __init__(self, files):
        self.files, self.read = files, 0

    def get_file_info(self, name):
        return self.files.get_file_info(name)

    def open_input_file(self, name):
        own, f = self, self.files.open_input_file(name)

        class File:
            def read_at(self, n, at):
                own.read += n
                return f.read_at(n, at)

            def __enter__(self):
                return self

            def __exit__(self, *_):
                f.close()

        return File()


def _rows(monkeypatch, reader, filters):
    """What a reader yields under filters, those it leaves to Spark, and the bytes it read."""
    real, counted = genomics.opened, []

    def opened(path):
        files, name = real(path)
        counted.append(_Counted(files))
        return counted[-1], name

    monkeypatch.setattr(genomics, "opened", opened)
    left = list(reader.pushFilters(filters))
    out = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    monkeypatch.setattr(genomics, "opened", real)
    return out, left, sum(c.read for c in counted)


def test_filters_decide_which_bytes_are_read(monkeypatch, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

    path, n = tmp_path / "v.bin", 5000
    np.arange(n, dtype="<f8").tofile(path)
    new = lambda: genomics._Records(str(path), 0, 8, False)
    at, null = ("idx",), IsNotNull(("idx",))
    for filters, want in (
        ([GreaterThanOrEqual(at, 100), LessThan(at, 300)], range(100, 300)), ([GreaterThan(at, 4990), null], range(4991, n)), ([LessThanOrEqual(at, 2)], range(3)),
        ([EqualTo(at, 7)], [7]), ([In(at, (5, 3, 4, 99, 7000, -2))], [3, 4, 5, 99]), ([EqualTo(at, 9), EqualTo(at, 10)], []), ([GreaterThan(at, n)], []), ([In(at, ())], []),
        ([In(at, (1, 2, 3)), GreaterThan(at, 1)], [2, 3]),
    ):
        rows, left, read = _rows(monkeypatch, new(), filters)
        assert rows == [(k, float(k)) for k in want] and read == 8 * len(want)
        assert left == [f for f in filters if f is null]
    # others are Spark's
    others = [EqualTo(("value",), 3.0), GreaterThan(at, 1.5)]
    assert _rows(monkeypatch, new(), others)[1:] == (others, 8 * n)


def test_sample_ranges_decide_which_bytes_are_read(monkeypatch, tmp_path):
    from pyspark.sql.datasource import LessThan

    path, n, m = tmp_path / "m.bin", 20_000, 6
    cells = np.arange(n * m, dtype="<f8").reshape(m, n)
    cells.tofile(path)
    rows, _, read = _rows(monkeypatch, genomics._Records(str(path), 0, 8 * n, True, (800, 1600)), [LessThan(("marker_idx",), 4)])
    assert [np.frombuffer(p).tolist() for _, p in rows] == cells[:4, 100:200].tolist() and read == 4 * 800


def test_matrices_are_written_and_read_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(3)
    cells = rng.choice([0.0, 1.0, 2.0, np.nan], size=(30, 37))
    from tesserix.operators.matrix import pack_dosages, unpack

    packed = spark.createDataFrame([(j, bytearray(pack_dosages(v))) for j, v in enumerate(cells)], "marker_idx long, payload binary").repartition(5)
    genomics.write_matrix(packed, "bed", f"{tmp_path}/g.bed")
    genomics.write_bed(list(cells), f"{tmp_path}/h.bed")
    assert (tmp_path / "g.bed").read_bytes() == (tmp_path / "h.bed").read_bytes()
    part = genomics.read_bed(spark, f"{tmp_path}/g.bed", 37, (8, 20)).where("marker_idx >= 10 AND marker_idx < 13 AND marker_idx != 11")
    rows = part.orderBy("marker_idx").toArrow()
    assert rows["marker_idx"].to_pylist() == [10, 12]
    assert np.array_equal(unpack(rows["payload"].combine_chunks(), "bed", 12), cells[[10, 12], 8:20], equal_nan=True)
    assert "PushedFilters" in part._jdf.queryExecution().executedPlan().toString() or part.count() == 2
    dense = spark.createDataFrame([(j, bytearray(v.astype("<f8").tobytes())) for j, v in enumerate(np.nan_to_num(cells))], "marker_idx long, payload binary")
    genomics.write_matrix(dense, "dense", f"{tmp_path}/d.bin")
    own = genomics.read_dense(spark, f"{tmp_path}/d.bin", 37, (5, 37)).where("marker_idx = 29").first()
    assert np.frombuffer(own["payload"]).tolist() == np.nan_to_num(cells)[29, 5:].tolist()
    for bad in ((3, 20), (8, 21), (20, 8), (0, 40)):
        with pytest.raises(ValueError, match="no range"):
            genomics.read_bed(spark, f"{tmp_path}/g.bed", 37, bad)


def test_text_vector_in_several_files(spark, tmp_path):
    # later files are larger, so they are read first
    table = spark.range(20_000).select(F.col("id").alias("idx"), (F.col("id") / F.when(F.col("id") < 9_000, 1).otherwise(7)).alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        genomics.write_text_vector(table, str(tmp_path / "v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "v").glob("part-*"))) > 1
    back = genomics.read_text_vector(spark, str(tmp_path / "v"))
    assert back.exceptAll(table).isEmpty() and back.count() == 20_000
    part = genomics.read_text_vector(spark, str(tmp_path / "v"), 8_999, 3).orderBy("idx").collect()
    assert [tuple(r) for r in part] == [(0, 8999.0), (1, 9000 / 7), (2, 9001 / 7)]


def test_empty_text_files(spark, tmp_path):
    (tmp_path / "e").write_text("\n  \n")
    assert genomics.read_text_vector(spark, str(tmp_path / "e")).isEmpty() and genomics.lines(spark, str(tmp_path / "e")).isEmpty()


def test_a_truncated_file_is_an_error(spark, tmp_path):
    (tmp_path / "x.bed").write_bytes(b"\x6c\x1b\x01\x00\x00\x00")
    with pytest.raises(Exception, match="no whole number"):
        genomics.read_bed(spark, str(tmp_path / "x.bed"), 6).collect()


def test_covariates_need_their_number(spark, tmp_path):
    (tmp_path / "z").write_text("1 2\n1\n")
    with pytest.raises(Exception, match="has not 2 covariates"):
        genomics.read_covariates(spark, str(tmp_path / "z"), 2).collect()


def test_command_line(spark, tmp_path):
    rng = np.random.default_rng(3)
    n, m = 200, 40
    g = rng.integers(0, 3, (m, n)).astype(float)
    g[rng.random((m, n)) < 0.02] = np.nan
    genomics.write_bed(list(g), str(tmp_path / "g.bed"))
    y = np.nan_to_num(g[:3]).sum(axis=0) + rng.normal(0, 0.5, n)
    y -= y.mean()  # phenotypes are scaled, not centred
    (tmp_path / "y.phen").write_text("".join(f"f{i} i{i} {'NA' if i % 29 == 0 else v}\n" for i, v in enumerate(y)))
    (tmp_path / "g.bim").write_text("".join(f"{1 + j % 2} rs{j}\n" for j in range(m)))
    files = ["--bed-file", f"{tmp_path}/g.bed", "--phen-files", f"{tmp_path}/y.phen", "--out-dir", f"{tmp_path}/", "--out-name", "run"]
    test = ["--bed-file-test", f"{tmp_path}/g.bed", "--phen-files-test", f"{tmp_path}/y.phen"]
    prior = ["--probs", "0.8,0.2", "--vars", "0,0.1", "--iterations", "3", "--h2", "0.5", "--rho", "0.9"]
    cli.main(["--run-mode", "both", "--N", str(n), "--Mt", str(m), "--bim-file", f"{tmp_path}/g.bim", "--store-pvals", "1", *files, *test, *prior], spark)
    assert spark.read.parquet(f"{tmp_path}/run_best").first()["r2"] > 0.7
    p = spark.read.parquet(f"{tmp_path}/run_pvals").orderBy("p").limit(3).collect()
    assert {r["marker_idx"] for r in p} == {0, 1, 2}
    assert spark.read.parquet(f"{tmp_path}/run_pvals_LOCO").count() == m
    cli.main(["--run-mode", "predict", "--estimate-file", f"{tmp_path}/run_estimates", "--out-dir", f"{tmp_path}/", "--out-name", "later", *test], spark)
    assert spark.read.parquet(f"{tmp_path}/later_predict").where(F.col("it") == 3).count() == n
    with pytest.raises(SystemExit):
        cli.main(["--run-mode", "infere", "--no-such-option", "1"], spark)

    # the other modes: tests of stored estimates, a restart, markers matched by their ids
    cli.main(["--run-mode", "pvals-calc", "--estimate-file", f"{tmp_path}/run_estimates", "--test-iter-range", "2,3", "--bim-file", f"{tmp_path}/g.bim", *files, *prior[:4]], spark)
    both = [spark.read.parquet(f"{tmp_path}/run_{name}") for name in ("pvals", "pvals_LOCO")]
    assert [t.count() for t in both] == [2 * m, 2 * m] and {r["it"] for r in both[0].select("it").distinct().collect()} == {2, 3}
    beta = [r["beta"] for r in spark.read.parquet(f"{tmp_path}/run_estimates").where("it = 3").orderBy("marker_idx").collect()]
    np.array(beta).astype("<f8").tofile(tmp_path / "beta.bin")
    cli.main(["--run-mode", "restart", "--estimate-file", f"{tmp_path}/beta.bin", "--true-signal-files", f"{tmp_path}/beta.bin", "--gam1-init", "5", *files[:5], f"{tmp_path}/again", *prior[:6]], spark)
    traced = {r["name"] for r in spark.read.parquet(f"{tmp_path}/again_trace").collect()}
    assert {"cosine_to_truth", "l2_error_to_truth"} <= traced
    order = rng.permutation(m)[:30]
    genomics.write_bed([g[j] for j in order] + [g[0]], str(tmp_path / "t.bed"))
    (tmp_path / "t.bim").write_text("".join(f"1 rs{j}\n" for j in order) + "1 other\n")
    part = ["--bed-file-test", f"{tmp_path}/t.bed", "--phen-files-test", f"{tmp_path}/y.phen", "--bim-file", f"{tmp_path}/g.bim", "--bim-file-test", f"{tmp_path}/t.bim"]
    cli.main(["--run-mode", "predict_single", "--estimate-file", f"{tmp_path}/beta.bin", "--out-dir", f"{tmp_path}/", "--out-name", "part", *part], spark)
    unmatched = {(r["marker_id"], r["only_in"]) for r in spark.read.parquet(f"{tmp_path}/part_unmatched").collect()}
    assert unmatched == {("other", "test")} | {(f"rs{j}", "fit") for j in set(range(m)) - set(order.tolist())}
    with pytest.raises(SystemExit, match="match ids"):
        cli.main(["--run-mode", "predict_single", "--estimate-file", f"{tmp_path}/beta.bin", "--out-dir", f"{tmp_path}/", "--out-name", "part", *part[:4]], spark)


@pytest.mark.parametrize("mode", ["sim", "sim_heavy_tails", "sim_realistic", "sim_probit"])
def test_simulations(spark, tmp_path, mode):
    rng = np.random.default_rng(5)
    n, m = 400, 60
    genomics.write_bed(list(rng.integers(0, 3, (m, n)).astype(float)), str(tmp_path / "g.bed"))
    more = ["--CV", "10", "--num-mix-comp", "4"] if mode != "sim_realistic" else ["--probs", "0.9,0.1", "--vars", "0,0.01"]
    cli.main(["--run-mode", mode, "--bed-file", f"{tmp_path}/g.bed", "--N", str(n), "--out-dir", f"{tmp_path}/", "--out-name", "s", "--iterations", "4", "--h2", "0.8", "--rho", "0.9", *more], spark)
    assert spark.read.parquet(f"{tmp_path}/s_beta_true").count() == m and spark.read.parquet(f"{tmp_path}/s_y").count() == n
    cosine = max(r["value"] for r in spark.read.parquet(f"{tmp_path}/s_trace").where("name = 'cosine_to_truth'").collect())
    assert cosine > (0.5 if mode != "sim_realistic" else -1)


@pytest.mark.parametrize("options", [["--red", "2"], ["--model", "robust", "--hold-out", "0.1"], ["--gamma-damp", "0"], ["--CV", "3"], ["--num-mix-comp", "3"]])
def test_options_without_effect_are_errors(spark, options):
    with pytest.raises(SystemExit):
        cli.main(["--run-mode", "infere", *options], spark)
