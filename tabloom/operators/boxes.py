"""Joins of boxes and intervals. A box is (l, t, r, b); boxes meet within equal key columns.

Rows are dealt by key and horizontal band, so a page of many thousand words costs its own size and
not the square; the exact test follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BAND = 64


def overlaps(l: Column, t: Column, r: Column, b: Column, tl: Column, tt: Column, tr: Column, tb: Column) -> Column:  # noqa: E741
    """A box touches a target: half-open on the target's far sides."""
    return (l < tr) & (r >= tl) & (t < tb) & (b >= tt)


def within(l: Column, t: Column, r: Column, b: Column, x0, y0, x1, y1) -> Column:  # noqa: E741
    return (t >= y0) & (l >= x0) & (b <= y1) & (r <= x1)


def contained(boxes: DataFrame, rectangles: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes with each rectangle (x0, y0, x1, y1) of their key that holds them wholly."""
    c = F.col
    return boxes.join(rectangles, keys).where(within(c("l"), c("t"), c("r"), c("b"), c("x0"), c("y0"), c("x1"), c("y1")))


def _banded(df: DataFrame, top: str, bottom: str, band: int) -> DataFrame:
    low = F.floor(F.col(top) / band)
    return df.withColumn("_band", F.explode(F.sequence(low, F.greatest(low, F.floor(F.col(bottom) / band)))))


def touching(boxes: DataFrame, targets: DataFrame, keys: list[str], band: int = BAND) -> DataFrame:
    """Pairs of a box and a target that it touches, once each. Targets carry tl, tt, tr, tb."""
    pairs = _banded(boxes, "t", "b", band).join(_banded(targets, "tt", "tb", band), [*keys, "_band"])
    first = F.greatest(F.floor(F.col("t") / band), F.floor(F.col("tt") / band))
    c = F.col
    return pairs.where(overlaps(c("l"), c("t"), c("r"), c("b"), c("tl"), c("tt"), c("tr"), c("tb")) & (c("_band") == first)).drop("_band")


def untouched(boxes: DataFrame, targets: DataFrame, keys: list[str], id_cols: list[str], band: int = BAND) -> DataFrame:
    """Boxes that touch no target of their key."""
    hit = touching(boxes.select(*keys, *[c for c in id_cols if c not in keys], "l", "t", "r", "b"), targets, keys, band).select(*id_cols).distinct()
    return boxes.join(hit, id_cols, "left_anti")


def as_targets(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.col("l").alias("tl"), F.col("t").alias("tt"), F.col("r").alias("tr"), F.col("b").alias("tb"))


def by_precedence(first: DataFrame, second: DataFrame, third: DataFrame, keys: list[str], id_cols: list[str]) -> DataFrame:
    """first, and what of (second, and what of third touches none of second) touches none of first."""
    rest = second.unionByName(untouched(third, as_targets(second, keys), keys, id_cols))
    return first.unionByName(untouched(rest, as_targets(first, keys), keys, id_cols))


def snapped(intervals: DataFrame, better: DataFrame, keys: list[str]) -> DataFrame:
    """Each (start, end) replaced by the first better interval that ends at or after its start, if
    the two overlap; else unchanged. Better intervals are disjoint, so the first is a minimum."""
    b = better.select(*keys, F.col("start").alias("bs"), F.col("end").alias("be"))
    rows = intervals.withColumn("_id", F.monotonically_increasing_id()) if "_id" not in intervals.columns else intervals
    # the next end at or after a start: one window over both, from the right
    marks = b.select(*keys, F.col("be").alias("_at"), F.struct("be", "bs").alias("_b"), F.lit(1).alias("_tag"))
    asks = rows.withColumn("_at", F.col("start")).withColumn("_b", F.lit(None).cast("struct<be:bigint,bs:bigint>")).withColumn("_tag", F.lit(0))
    order = W.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_tag"), F.desc("_b")).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = asks.unionByName(marks, allowMissingColumns=True).withColumn("_next", F.last("_b", ignorenulls=True).over(order)).where("_tag = 0")
    meets = F.col("_next").isNotNull() & (F.col("end") >= F.col("_next.bs"))
    out = both.withColumn("new_start", F.when(meets, F.col("_next.bs")).otherwise(F.col("start"))).withColumn("new_end", F.when(meets, F.col("_next.be")).otherwise(F.col("end")))
    return out.drop("_id", "_at", "_b", "_tag", "_next")


def nearest(edges: DataFrame, separators: DataFrame, keys: list[str], edge: str, at: str) -> DataFrame:
    """Each edge with the separator nearest to it, the smaller on a tie, and the signed distance.
    Separators of a table are few, so they travel as one sorted array per key."""
    all_ = separators.groupBy(*keys).agg(F.array_sort(F.collect_set(at)).alias("_all"))
    best = F.array_min(F.transform("_all", lambda s: F.struct(F.abs(s - F.col(edge)).alias("d"), s.alias("s"))))
    return edges.join(all_, keys, "left").withColumn("_best", best).withColumn("nearest", F.col("_best.s")).withColumn("delta", F.col(edge) - F.col("_best.s")).drop("_all", "_best")


def spanning_edges(cells: DataFrame, separators: DataFrame, keys: list[str], edge: str, at: str, overflow: int) -> DataFrame:
    """Edges snapped to the nearest separator if it lies within the overflow."""
    out = nearest(cells, separators, keys, edge, at)
    return out.withColumn("snapped", F.when(F.abs("delta") <= overflow, F.col("nearest")).otherwise(F.col(edge)))


def interior(cells: DataFrame, separators: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Cell extents clipped by separators (start, end) that touch their edges; `bad` marks cells
    with nothing left (rows for the reject table)."""
    all_ = separators.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_all"))
    at_low = F.filter("_all", lambda s: (s["start"] <= F.col(low)) & (s["end"] >= F.col(low)))
    at_high = F.filter("_all", lambda s: (s["start"] <= F.col(high)) & (s["end"] >= F.col(high)))
    out = cells.join(all_, keys, "left").withColumn("inner_low", F.coalesce(F.get(at_low, F.lit(0))["end"] + 1, F.col(low)))
    out = out.withColumn("inner_high", F.coalesce(F.get(at_high, F.lit(0))["start"] - 1, F.col(high))).drop("_all")
    return out.withColumn("bad", F.col("inner_high") <= F.col("inner_low"))
