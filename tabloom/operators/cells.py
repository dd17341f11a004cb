"""Cells, their text, and the table made of them. The long form (key, row, col, text) is canonical;
a wide table exists per table only, as its columns depend on the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions import text as X
from tabloom.operators import boxes as B
from tabloom.operators import separators as P


def grid(rows: DataFrame, cols: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of both axes -> cells row, col, x0, y0, x1, y1."""
    r = P.cell_spans(rows, keys).select(*keys, F.col("n").alias("row"), F.col("low").alias("y0"), F.col("high").alias("y1"))
    c = P.cell_spans(cols, keys).select(*keys, F.col("n").alias("col"), F.col("low").alias("x0"), F.col("high").alias("x1"))
    return r.join(c, keys)


def with_text(cells: DataFrame, words: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Each cell's words in order, joined by spaces; a word may lie in several cells."""
    targets = cells.select(*keys, "row", "col", F.col("x0").alias("tl"), F.col("y0").alias("tt"), F.col("x1").alias("tr"), F.col("y1").alias("tb"))
    pairs = B.touching(words.select(*keys, F.col(order).alias("_o"), "text", "l", "t", "r", "b"), targets, keys)
    parts = F.array_sort(F.collect_list(F.struct("_o", "text")))
    found = pairs.groupBy(*keys, "row", "col").agg(F.concat_ws(" ", F.transform(parts, lambda p: p["text"])).alias("text"))
    out = cells.join(found, [*keys, "row", "col"], "left")
    return out.withColumn("text", X.blank_to_null(F.coalesce("text", F.lit(""))))


def without_empty(grid_: DataFrame, keys: list[str]) -> DataFrame:
    """Columns without text go, then rows; rows are numbered anew, columns keep their labels."""
    col, row = W.partitionBy(*keys, "col"), W.partitionBy(*keys, "row")
    out = grid_.withColumn("_n", F.count("text").over(col)).where("_n > 0").withColumn("_n", F.count("text").over(row)).where("_n > 0")
    return out.withColumn("row", (F.dense_rank().over(W.partitionBy(*keys).orderBy("row")) - 1).cast("long")).drop("_n")


def parentheses_merged(grid_: DataFrame, keys: list[str]) -> DataFrame:
    """Columns that hold only '(' are put before the next column's text, those that hold only ')'
    after the previous one's; then they go. Columns at the edge just go."""
    per = grid_.groupBy(*keys, "col").agg(F.array_sort(F.collect_set("text")).alias("_set"))
    order = W.partitionBy(*keys).orderBy("col")
    kind = F.when(F.col("_set") == F.array(F.lit("(")), "open").when(F.col("_set") == F.array(F.lit(")")), "close").otherwise("text")
    per = per.withColumn("kind", kind).withColumn("before", F.lag("kind").over(order)).withColumn("after", F.lead("kind").over(order)).drop("_set")
    cells = W.partitionBy(*keys, "row").orderBy("col")
    out = grid_.join(per, [*keys, "col"]).withColumn("_p", F.lag("text").over(cells)).withColumn("_a", F.lead("text").over(cells))
    pre = F.when((F.col("before") == "open"), F.coalesce("_p", F.lit(""))).otherwise(F.lit(""))
    post = F.when((F.col("after") == "close"), F.coalesce("_a", F.lit(""))).otherwise(F.lit(""))
    text = F.concat(pre, F.coalesce("text", F.lit("")), post)
    return out.withColumn("text", F.when(text == "", F.lit(None)).otherwise(text)).where("kind = 'text'").drop("kind", "before", "after", "_p", "_a")


def without_ruled_last(grid_: DataFrame, keys: list[str]) -> DataFrame:
    """The last column goes if it holds nothing but '1' and '|'."""
    last = F.max("col").over(W.partitionBy(*keys))
    rule = F.min((F.col("text").isNull() | F.col("text").isin("1", "|")).cast("int")).over(W.partitionBy(*keys, "col"))
    return grid_.withColumn("_l", last).withColumn("_r", rule).where((F.col("col") < F.col("_l")) | (F.col("_r") == 0)).drop("_l", "_r")


def labelled(grid_: DataFrame, keys: list[str]) -> DataFrame:
    """If the longest text below the first row stands in column 0, cell (0, 0) reads 'Labels'."""
    body = F.when(F.col("row") >= 1, F.struct(F.length("text"), -F.col("col"), -F.col("row")))
    longest = F.max_by(F.when(F.col("row") >= 1, F.col("col")), body).over(W.partitionBy(*keys))
    return grid_.withColumn("text", F.when((longest == 0) & (F.col("row") == 0) & (F.col("col") == 0), F.lit("Labels")).otherwise(F.col("text")))


def headers(grid_: DataFrame, keys: list[str]) -> DataFrame:
    """Per column: the first text of its first five rows, 'empty' or 'numeric' where there is none
    or a number; repeats are numbered _2, _3, ..."""
    first = F.min_by("text", F.when((F.col("row") < 5) & F.col("text").isNotNull(), F.col("row")))
    out = grid_.groupBy(*keys, "col").agg(first.alias("_h"))
    head = F.when(F.col("_h").isNull(), "empty").when(X.is_numeric(F.col("_h")), "numeric").otherwise(F.col("_h"))
    out = out.withColumn("header", head).withColumn("_k", F.row_number().over(W.partitionBy(*keys, "header").orderBy("col")))
    return out.withColumn("header", F.when(F.col("_k") > 1, F.concat_ws("_", "header", F.col("_k").cast("string"))).otherwise(F.col("header"))).drop("_h", "_k")


def finished(grid_: DataFrame, keys: list[str]) -> DataFrame:
    """Headers, the header row dropped, rows with labels or codes only dropped: key, row, col, header, text."""
    heads = headers(grid_, keys)
    out = grid_.where("row > 0").withColumn("row", F.col("row") - 1).join(heads, [*keys, "col"])
    value = ~((F.col("header") == "Labels") | F.col("header").startswith("Codes"))
    n = F.count(F.when(value, F.col("text"))).over(W.partitionBy(*keys, "row"))
    return out.withColumn("_n", n).where("_n > 0").drop("_n")


def cleaned(grid_: DataFrame, keys: list[str]) -> DataFrame:
    out = without_empty(grid_, keys)
    out = without_ruled_last(parentheses_merged(out, keys), keys)
    return finished(labelled(out, keys), keys)


def wide(long: DataFrame, columns: list[int]) -> DataFrame:
    """One table as it is printed: a column per col of `columns`."""
    return long.groupBy("row").pivot("col", columns).agg(F.first("text"))
