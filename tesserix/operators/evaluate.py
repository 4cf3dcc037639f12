"""How good an estimate is: R squared, rates of a classifier, agreement with a known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train_r2(fitted: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``r2`` of ``y, z`` rows: 1 - |y - z|^2 / |y|^2, y not centred."""
    y, z = F.col("y"), F.col("z")
    r2 = 1 - F.sum((y - z) * (y - z)) / F.sum(y * y)
    return fitted.groupBy(*keys).agg(r2.alias("r2"))


def test_r2(fitted: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``r2`` of ``y, z`` rows: 1 - sum (y - z)^2 / (sd(y)^2 n); rows without y don't count."""
    y, z = F.col("y"), F.col("z")
    known = fitted.where("y IS NOT NULL")
    return known.groupBy(*keys).agg((1 - F.sum((y - z) * (y - z)) / (F.var_samp("y") * F.count("*"))).alias("r2"))


def best_iteration(r2: DataFrame) -> DataFrame:
    """``it, r2`` of the largest R squared; the first of equals."""
    best = F.max(F.struct("r2", (-F.col("it")).alias("back")))
    return r2.agg(best.alias("best")).select((-F.col("best.back")).cast("int").alias("it"), F.col("best.r2").alias("r2"))


def classified(scores: DataFrame) -> DataFrame:
    """``sample_idx, yhat``: 1 where the latent score is 0 or more."""
    return scores.select("sample_idx", (F.col("value") >= 0).cast("int").alias("yhat"))


def confusion_rates(predicted: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``P, N, TPR, FPR`` of ``y, yhat`` rows; a rate is null without rows of its class."""
    y, hat = F.col("y"), F.col("yhat")
    return predicted.groupBy(*keys).agg(
        F.count_if(y == 1).alias("P"), F.count_if(y == 0).alias("N"),
        F.try_divide(F.count_if((y == 1) & (hat == 1)), F.count_if(y == 1)).alias("TPR"),
        F.try_divide(F.count_if((y == 0) & (hat == 1)), F.count_if(y == 0)).alias("FPR"),
    )


def cosine(pairs: DataFrame) -> DataFrame:
    """``cosine`` of ``a, b`` rows, not centred."""
    a, b = F.col("a"), F.col("b")
    return pairs.agg((F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("cosine"))


def l2_error(pairs: DataFrame) -> DataFrame:
    """``l2_error``: |a - b| / |b| of ``a, b`` rows."""
    a, b = F.col("a"), F.col("b")
    return pairs.agg(F.sqrt(F.sum((a - b) * (a - b)) / F.sum(b * b)).alias("l2_error"))


def expected_huber_loss(points: DataFrame, tau: float, deltas: list[float], draws: int, seed: int = 1) -> DataFrame:
    """``delta, loss``: the mean Huber loss of ``y`` over ``draws`` values z ~ N(p, 1/tau) for each
    row of ``idx, p, y``; all thresholds in one scan, nothing shuffled but their sums."""
    from ..functions.scalars import huber_loss
    from .simulate import normal

    drawn = points.select("p", "y", F.explode(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda k: F.col("idx") * draws + k)).alias("draw"))
    z = drawn.select("y", (F.col("p") + normal(F.col("draw"), seed) / tau**0.5).alias("z"))
    losses = [huber_loss(F.col("z"), d, F.col("y")) for d in deltas]
    one = z.agg(*(F.avg(loss).alias(f"d{k}") for k, loss in enumerate(losses)))
    pairs = F.array(*(F.struct(F.lit(float(d)).alias("delta"), F.col(f"d{k}").alias("loss")) for k, d in enumerate(deltas)))
    return one.select(F.explode(pairs).alias("x")).select("x.delta", "x.loss")


def relative_change(estimates: DataFrame) -> DataFrame:
    """``it, rel_change``: |x - previous x| / |previous x| over the markers of each iteration."""
    lagged = estimates.withColumn("last", F.expr("lag(x) OVER (PARTITION BY marker_idx ORDER BY it)")).where("last IS NOT NULL")
    x, last = F.col("x"), F.col("last")
    return lagged.groupBy("it").agg(F.sqrt(F.sum((x - last) * (x - last)) / F.sum(last * last)).alias("rel_change"))


def matched(estimates: DataFrame, fitted: DataFrame, tested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table of estimates by the test markers' numbers, joined by their ids (``marker_idx, marker_id`` of
    both sides), and the ids that one side lacks (``marker_id, only_in``); their effects count as 0."""
    fitted, tested = fitted.withColumnRenamed("marker_idx", "fitted_idx"), tested.select(F.col("marker_idx").alias("tested_idx"), "marker_id")
    missing = tested.join(fitted, "marker_id", "left_anti").select("marker_id", F.lit("test").alias("only_in"))
    missing = missing.unionAll(fitted.join(tested, "marker_id", "left_anti").select("marker_id", F.lit("fit")))
    pairs = tested.join(fitted, "marker_id").select("tested_idx", F.col("fitted_idx").alias("marker_idx"))
    return estimates.join(pairs, "marker_idx").drop("marker_idx").withColumnRenamed("tested_idx", "marker_idx"), missing
