"""Separators: intervals between rows or columns of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions import sequences as S


def from_edges(boxes: DataFrame, keys: list[str], widen: bool = False) -> DataFrame:
    """Sorted boxes (start, end) -> separators from one's end to the next one's start. Rows: both
    floored; columns (widen): floor - 1 and ceiling + 1."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    nxt = F.lead("start").over(order)
    low, high = F.least("end", "_n"), F.greatest("end", "_n")
    out = boxes.withColumn("_n", nxt).where("_n IS NOT NULL")
    grow = 1 if widen else 0
    return out.select(*keys, (F.floor(low) - grow).alias("start"), ((F.ceil(high) + 1) if widen else F.floor(high)).cast("long").alias("end"))


def to_vector(separators: DataFrame, sizes: DataFrame, keys: list[str], size: str) -> DataFrame:
    """0/1 on each position of the axis, ends included."""
    dense = S.on_dense_axis(S.stabbing_counts(separators, keys, "start", "end"), sizes, keys, size)
    return dense.select(*keys, "at", (F.col("n") > 0).cast("long").alias("on"))


def edge_separators(ink: DataFrame, text: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """A separator at an edge where ink lies more than `least` beyond the text: (side, start, end)."""
    a = ink.groupBy(*keys).agg(F.min("at").alias("i0"), F.max("at").alias("i1"))
    b = text.groupBy(*keys).agg(F.min("at").alias("t0"), F.max("at").alias("t1"))
    both = a.join(b, keys)
    low = both.where(F.col("t0") - F.col("i0") > least).select(*keys, F.lit("low").alias("side"), F.col("i0").alias("start"), (F.col("t0") - 1).alias("end"))
    high = both.where(F.col("i1") - F.col("t1") > least).select(*keys, F.lit("high").alias("side"), (F.col("t1") + 1).alias("start"), F.col("i1").alias("end"))
    return low.unionByName(high)


def framed(separators: DataFrame, sizes: DataFrame, keys: list[str], size: str, padding: int = 40) -> DataFrame:
    """Separators plus one at the low and one at the high end of the table's frame, with midpoints."""
    low = sizes.select(*keys, F.lit(padding - 1).cast("long").alias("start"), F.lit(padding).cast("long").alias("end"))
    high = sizes.select(*keys, (F.col(size) - padding).alias("start"), (F.col(size) - padding + 1).alias("end"))
    out = separators.select(*keys, "start", "end").unionByName(low).unionByName(high)
    return out.withColumn("mid", F.floor((F.col("start") + F.col("end")) / 2) + 1)


def segment_features(separators: DataFrame, lines: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Minimum and maximum of line features over each separator, ends included. A separator lists
    its lines, which join by equality: no range join."""
    wide = separators.withColumn("at", F.explode(F.sequence("start", F.greatest("start", "end"))))
    aggs = [f(c).alias(f"{c}_{n}") for c in features for n, f in (("min", F.min), ("max", F.max))]
    return wide.join(lines, [*keys, "at"], "left").groupBy(*keys, "start", "end").agg(*aggs)


def words_between(separators: DataFrame, words: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Per separator in order of midpoint: whether a word lies wholly between its midpoint and the
    next one's (the last: the last word's end). As words are sorted to the last midpoint strictly
    before them, one window decides."""
    order = W.partitionBy(*keys).orderBy("mid")
    edge = words.groupBy(*keys).agg(F.max(high).alias("_edge"))
    mids = separators.select(*keys, "mid").distinct().join(edge, keys, "left").withColumn("next_mid", F.coalesce(F.lead("mid").over(order), F.col("_edge"))).drop("_edge")
    placed = S.as_of(words.select(*keys, (F.col(low) - 1).alias("at"), F.col(high).alias("high")), mids, keys, "at", "mid", ["mid", "next_mid"])
    n = placed.where(F.col("mid").isNotNull() & (F.col("high") <= F.col("next_mid"))).groupBy(*keys, "mid").agg(F.count("*").alias("n"))
    return separators.join(n, [*keys, "mid"], "left").withColumn("n_words", F.coalesce("n", F.lit(0))).withColumn("has_text", (F.col("n_words") > 0).cast("long")).drop("n")


def targets(separators: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """1 for a proposal that holds target lines on [start, end) unless a target ends within it
    before another begins."""
    change = truth.withColumn("_d", F.col("on") - F.lag("on").over(W.partitionBy(*keys).orderBy("at")))
    wide = separators.where(F.col("end") > F.col("start")).withColumn("at", F.explode(F.sequence("start", F.col("end") - 1)))
    seen = wide.join(change, [*keys, "at"], "left").groupBy(*keys, "start", "end").agg(F.max("on").alias("any"), F.min(F.when((F.col("_d") == -1) & (F.col("at") > F.col("start")), F.col("at"))).alias("falls"), F.max(F.when((F.col("_d") == 1) & (F.col("at") > F.col("start")), F.col("at"))).alias("rises"))
    split = F.coalesce(F.col("falls") < F.col("rises"), F.lit(False))
    out = separators.join(seen, [*keys, "start", "end"], "left")
    return out.select(*keys, "start", "end", (F.coalesce(F.col("any"), F.lit(0)).cast("int").eqNullSafe(1) & ~split).cast("long").alias("target"))


def kept(separators: DataFrame, p: str = "p", threshold: float = 0.5) -> DataFrame:
    return separators.where(F.col(p) >= threshold)


def confidence(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Twice the mean over both axes of the median distance of probabilities from a half."""
    per = scores.groupBy(*keys, "axis").agg(F.expr("percentile(abs(p - 0.5D), 0.5D)").alias("m"))
    return per.groupBy(*keys).agg((2 * F.avg("m")).alias("confidence"))


def cell_spans(separators: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive separators -> spans: number, low = end + 1, high = next start."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    out = separators.withColumn("n", (F.row_number().over(order) - 1).cast("long")).withColumn("high", F.lead("start").over(order))
    return out.where("high IS NOT NULL").select(*keys, "n", (F.col("end") + 1).alias("low"), "high")


def _off(measure: str):
    return lambda x: F.abs(x - F.col(measure))


def widened(separators: DataFrame, lines: DataFrame, keys: list[str], most: dict[str, float], reach: int = 50) -> DataFrame:
    """Separators widened on either side up to the first line that differs from every line of the
    separator by more than a measure's limit, in any of the measures (`most`: measure -> limit), at
    most `reach` lines and not beyond the lines there are. lines(keys, at, measures...)."""
    own = [*keys, "start", "end"]
    wide = separators.select(*own).withColumn("at", F.explode(F.sequence(F.col("start") - reach, F.col("end") + reach)))
    seen = wide.join(lines.select(*keys, "at", *most), [*keys, "at"])
    inside = F.col("at").between(F.col("start"), F.col("end"))
    of_own = seen.where(inside).groupBy(*own).agg(F.collect_list(F.struct(*most)).alias("_own"))
    near = seen.where(~inside).join(of_own, own, "left")
    unlike = F.lit(False)
    for m, limit in most.items():
        unlike = unlike | F.coalesce(F.array_min(F.transform(F.col(f"_own.{m}"), _off(m))) > limit, F.lit(False))
    stop = near.groupBy(*own).agg(F.max(F.when(unlike & (F.col("at") < F.col("start")), F.col("at"))).alias("_low"), F.min(F.when(unlike & (F.col("at") > F.col("end")), F.col("at"))).alias("_high"))
    ends = lines.groupBy(*keys).agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    out = separators.select(*own).join(stop, own, "left").join(ends, keys)
    low = F.greatest(F.coalesce(F.col("_low") + 1, F.col("start") - reach), F.least("_first", "start"))
    high = F.least(F.coalesce(F.col("_high") - 1, F.col("end") + reach), F.greatest("_last", "end"))
    return out.select(*own, low.alias("wide_start"), high.alias("wide_end"))


def faulty(boxes: DataFrame, keys: list[str], box: list[str]) -> DataFrame:
    """Keys whose boxes repeat."""
    return boxes.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*box)).alias("n_distinct")).where("n <> n_distinct")
