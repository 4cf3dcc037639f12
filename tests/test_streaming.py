from datetime import datetime, timedelta

from tesserix.streaming.scoring import score


def test_a_sample_s_cells_are_one_session_wherever_the_clock_stands(spark):
    at = datetime(2024, 1, 1)
    cells = [(at + timedelta(seconds=s), 7, m, 1.0) for m, s in enumerate((599, 601, 1190))]
    table = spark.createDataFrame(cells, "ts timestamp, sample_idx long, marker_idx long, value double")
    stats = spark.createDataFrame([(m, 0.0, 1.0) for m in range(3)], "marker_idx long, mu double, isd double")
    effects = spark.createDataFrame([(m, 2.0) for m in range(3)], "marker_idx long, x double")
    assert [tuple(r) for r in score(table, stats, effects, 4).collect()] == [(7, 3.0)]


def test_stream_scores_as_a_batch_does(spark, tmp_path):
    start = datetime(2024, 1, 1)
    cells = [(start + timedelta(seconds=s), s, m, None if (s + m) % 5 == 0 else float(s * m % 3)) for s in range(6) for m in range(4)]
    table = spark.createDataFrame(cells, "ts timestamp, sample_idx long, marker_idx long, value double")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stats = spark.createDataFrame([(m, 0.5 * m, 1.0 + m) for m in range(4)], "marker_idx long, mu double, isd double")
    effects = spark.createDataFrame([(m, 2.0 - m) for m in range(4)], "marker_idx long, x double")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = score(stream, stats, effects, 4).writeStream.outputMode("complete").format("memory").queryName("scores")
    query = query.option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["sample_idx"]: round(r["value"], 9) for r in spark.table("scores").collect()}
    want = {s: round(sum((v - 0.5 * m) * (1 + m) * (2 - m) for _, t, m, v in cells if t == s and v is not None) / 2, 9) for s in range(6)}
    assert got == want
