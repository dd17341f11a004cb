"""Losses, accuracies, confusion and threshold curves over scored lines or separators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions import sequences as S

EPS = 1e-7


def class_weights(df: DataFrame, keys: list[str], target: str = "target") -> DataFrame:
    """Weights of zeros and ones: inverse shares, normalised, which is the other class's share."""
    s = F.avg(F.col(target).cast("double"))
    return df.groupBy(*keys).agg(s.alias("w0"), (1 - s).alias("w1"))


def cross_entropy(p: Column, t: Column, w0: Column | float = 1.0, w1: Column | float = 1.0) -> Column:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return -F.avg(w0 * (1 - t) * F.ln(1 - q) + w1 * t * F.ln(q))


def count_loss(predicted: Column, wanted: Column, limit: float = 0.5) -> Column:
    return F.avg(2 * limit / (1 + F.exp(-F.abs(predicted - wanted) / 2)) - limit)


def accuracy(df: DataFrame, keys: list[str], cut: float = 0.5) -> DataFrame:
    hit = (F.col("p") >= cut).cast("long")
    return df.groupBy(*keys).agg(F.avg((hit == F.col("target")).cast("double")).alias("accuracy"), F.sum(hit).alias("n_predicted"), F.sum("target").alias("n_target"), F.count("*").alias("n"))


def batch_losses(df: DataFrame, batch: list[str], sample: str, cut: float = 0.5) -> DataFrame:
    """Of df(batch, sample, at, p, target) without padding, per batch: loss and right ones over all
    lines, and how many separators begin in the scores and in the targets of its samples."""
    keys = [*batch, sample]
    begun = lambda col: S.starts_count(df.withColumn("_on", col.cast("long")), keys, "at", "_on").groupBy(*batch).agg(F.sum("n_separators").alias("_n"))
    hit = (F.col("p") >= cut).cast("long")
    lines = df.groupBy(*batch).agg(cross_entropy(F.col("p"), F.col("target")).alias("loss"), F.count_if(hit == F.col("target")).alias("n_right"), F.count("*").alias("n"))
    return lines.join(begun(hit).withColumnRenamed("_n", "n_predicted"), batch).join(begun(F.col("target")).withColumnRenamed("_n", "n_target"), batch)


def mean_of_means(df: DataFrame, batch: str, loss: Column) -> DataFrame:
    return df.groupBy(batch).agg(loss.alias("_l")).agg(F.avg("_l").alias("loss"))


def confusion(df: DataFrame, keys: list[str], cut: float = 0.5) -> DataFrame:
    """Shares of ones and zeros judged right, of all judged wrong, and the number wrong."""
    hit = F.col("p") > cut
    one = F.col("target") == 1
    right = (hit == one).cast("double")
    return df.groupBy(*keys).agg(F.avg(F.when(one, right)).alias("true_positive"), F.avg(F.when(~one, right)).alias("true_negative"), F.avg(1 - right).alias("wrong"), F.count_if(hit != one).alias("n_wrong"))


def verdict(p: Column, target: Column, cut: float = 0.5) -> Column:
    return F.when((p > cut) & (target == 1), "correct keep").when((p <= cut) & (target == 0), "correct drop").when((p <= cut) & (target == 1), "wrong drop").otherwise("wrong keep")


def threshold_curve(df: DataFrame, steps: int = 100) -> DataFrame:
    """False positives (p > tau) and false negatives (p <= tau) at `steps` thresholds from 0 to 1.

    A row falls into the number of thresholds that its probability exceeds; sums over those at
    most `steps` + 1 classes give all counts, so no row meets more than one threshold.
    """
    last = steps - 1
    # thresholds below p: those of k / last < p
    guess = F.ceil(F.col("p") * last)
    below = F.when(guess / F.lit(float(last)) < F.col("p"), guess + 1).when((guess - 1) / F.lit(float(last)) >= F.col("p"), guess - 1).otherwise(guess)
    classes = df.groupBy(F.least(F.greatest(below, F.lit(0)), F.lit(steps)).cast("long").alias("c")).agg(F.count_if(F.col("target") == 0).alias("zeros"), F.count_if(F.col("target") == 1).alias("ones"))
    taus = df.sparkSession.range(steps).select(F.col("id").alias("k"), (F.col("id") / F.lit(float(last))).alias("tau"))
    up = F.broadcast(classes.agg(F.collect_list(F.struct("c", "zeros", "ones")).alias("all")))  # one row of steps + 1 at most
    add = lambda cond, part: F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + F.when(cond(x), x[part]).otherwise(F.lit(0)))
    out = taus.crossJoin(up)
    return out.select("k", "tau", add(lambda x: x["c"] > F.col("k"), "zeros").alias("fp"), add(lambda x: x["c"] <= F.col("k"), "ones").alias("fn"))


def cost_curves(curve: DataFrame, ratio: float = 4.0) -> DataFrame:
    """Logarithmic cost, weighted and neutral, each relative to its largest."""
    out = curve.withColumn("_w", F.ln(F.col("fp") + ratio * F.col("fn") + 1)).withColumn("_n", F.ln(F.col("fp") + F.col("fn") + 1))
    top = out.agg(F.max("_w").alias("_mw"), F.max("_n").alias("_mn"))
    return out.crossJoin(F.broadcast(top)).select("k", "tau", "fp", "fn", (F.col("_w") / F.col("_mw")).alias("weighted"), (F.col("_n") / F.col("_mn")).alias("neutral"))


def best_thresholds(costs: DataFrame, ratio: float = 4.0) -> DataFrame:
    return costs.agg(F.min_by("tau", F.struct("weighted", "tau")).alias("weighted"), F.min_by("tau", F.struct("neutral", "tau")).alias("neutral")).withColumn("cost_ratio_fn_over_fp", F.lit(ratio))


def precision_recall(curve: DataFrame, totals: DataFrame) -> DataFrame:
    """Precision and recall at each threshold; totals has one row with the number of ones."""
    out = curve.crossJoin(F.broadcast(totals.select("ones"))).withColumn("tp", F.col("ones") - F.col("fn"))
    share = lambda a, b: F.when(b > 0, a / b)
    return out.select("k", "tau", share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("ones")).alias("recall"))


def line_losses(df: DataFrame, keys: list[str]) -> DataFrame:
    """Class-weighted cross entropy and count loss per table, then per axis."""
    s = F.avg(F.col("target").cast("double")).over(W.partitionBy(*keys))
    weighted = df.withColumn("_s", s)
    return weighted.groupBy(*keys).agg(cross_entropy(F.col("p"), F.col("target"), F.col("_s"), 1 - F.col("_s")).alias("loss"), F.count("*").alias("n"))
