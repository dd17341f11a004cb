"""Ordered sequences in long form (key columns, index, value): islands, scans, as-of, stabbing.

All are windows or groups per key, so they scale with the number of keys; none needs a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec


def ordered(keys: list[str], at: str) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(at)


def running(keys: list[str], at: str) -> WindowSpec:
    return ordered(keys, at).rowsBetween(W.unboundedPreceding, W.currentRow)


def runs(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Maximal runs of equal values: keys, run (from 0), value, start, end, length."""
    change = F.coalesce((F.lag(value).over(ordered(keys, at)) != F.col(value)).cast("long"), F.lit(0))
    marked = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(running(keys, at)))
    return marked.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("length"))


def intervals_where(df: DataFrame, keys: list[str], at: str, hit: Column) -> DataFrame:
    """Runs of rows that satisfy hit, as (start, end): one before the first, and the last."""
    found = runs(df.withColumn("_hit", hit.cast("int")), keys, at, "_hit").where("_hit = 1")
    return found.select(*keys, (F.col("start") - 1).alias("start"), F.col("end").alias("end"))


def scores_to_intervals(df: DataFrame, keys: list[str], at: str, score: str, size: str, cut: float = 0.8, padding: int = 40) -> DataFrame:
    """Intervals of scores above the cut (strictly), scores within the padding counting as 0."""
    inner = (F.col(at) >= padding) & (F.col(at) < F.col(size) - padding)
    return intervals_where(df, keys, at, F.when(inner, F.col(score)).otherwise(F.lit(0.0)) > cut)


def starts_count(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Number of 0 to 1 transitions of each key; a leading 1 is none."""
    rise = (F.col(value) == 1) & (F.lag(value).over(ordered(keys, at)) == 0)
    return df.withColumn("_r", F.coalesce(rise.cast("long"), F.lit(0))).groupBy(*keys).agg(F.sum("_r").alias("n_separators"))


def reset_cumsum(df: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """Running sum that starts over where the value is 0."""
    island = F.sum((F.col(value) == 0).cast("long")).over(running(keys, at))
    return df.withColumn("_i", island).withColumn(out, F.sum(value).over(running([*keys, "_i"], at))).drop("_i")


def zero_start(df: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """0 before the key's first 0 (all 0 if there is none), the value from there on."""
    first = F.min(F.when(F.col(value) == 0, F.col(at))).over(W.partitionBy(*keys))
    return df.withColumn(out, F.when(F.col(at) >= first, F.col(value)).otherwise(F.lit(0)))


def carried(df: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """Nulls filled with the last value before."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(running(keys, at)))


def as_of(axis: DataFrame, events: DataFrame, keys: list[str], at: str, event_at: str, payload: list[str]) -> DataFrame:
    """axis with the payload of the last event at or before its position. One window over the
    union of both; events come first at equal positions, and of equal ones the last by payload."""
    left = axis.withColumn("_p", F.lit(None).cast(events.select(F.struct(*payload)).schema[0].dataType)).withColumn("_tag", F.lit(1))
    right = events.select(*keys, F.col(event_at).alias(at), F.struct(*payload).alias("_p"), F.lit(0).alias("_tag"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy(at, "_tag", "_p").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = both.withColumn("_last", F.last("_p", ignorenulls=True).over(order)).where("_tag = 1")
    return out.select(*axis.columns, *[F.col(f"_last.{c}").alias(c) for c in payload])


def stabbing_counts(df: DataFrame, keys: list[str], low: str, high: str, at: str = "at") -> DataFrame:
    """How many closed intervals cover each position, as steps: keys, at, n (valid up to the next
    row). +1 at an interval's start, -1 after its end, summed up: linear in the intervals."""
    steps = df.select(*keys, F.explode(F.array(F.struct(F.col(low).alias("at"), F.lit(1).alias("d")), F.struct((F.col(high) + 1).alias("at"), F.lit(-1).alias("d")))).alias("_s"))
    steps = steps.select(*keys, F.col("_s.at").alias(at), F.col("_s.d").alias("d")).groupBy(*keys, at).agg(F.sum("d").alias("d"))
    return steps.withColumn("n", F.sum("d").over(running(keys, at))).drop("d")


def on_dense_axis(steps: DataFrame, sizes: DataFrame, keys: list[str], size: str, at: str = "at", value: str = "n") -> DataFrame:
    """Step values on positions 0 to size - 1; 0 before the first step."""
    axis = sizes.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col(size) - 1)).alias(at))
    return as_of(axis, steps.withColumnRenamed(at, "_at"), keys, at, "_at", [value]).withColumn(value, F.coalesce(value, F.lit(0)))


def rolling_median(df: DataFrame, keys: list[str], at: str, value: str, width: int, out: str = "median") -> DataFrame:
    """Median of each full window of `width` rows that starts at the row."""
    frame = ordered(keys, at).rowsBetween(0, width - 1)
    return df.withColumn("_n", F.count("*").over(frame)).withColumn(out, F.expr(f"percentile({value}, 0.5)").over(frame)).where(F.col("_n") == width).drop("_n")


def rolled(df: DataFrame, keys: list[str], at: str, value: str, shifts: list[int]) -> DataFrame:
    """Circular lags of positions 0 to n - 1: a row's values come by a join on the positions they go to."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    values = df.select(*keys, F.col(at).alias("_at"), F.col(value).alias("_v")).join(sizes, keys)
    out = df
    for s in shifts:
        sent = values.select(*keys, F.pmod(F.col("_at") + s, F.col("_n")).alias(at), F.col("_v").alias(f"{value}_roll_{s}".replace("-", "m")))
        out = out.join(sent, [*keys, at])
    return out
