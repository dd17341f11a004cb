"""Made-up table images with known separators, for tests: ten blocks an axis, each with a solid or dashed
separator, one that only looks like it (rows), or none. Text is not drawn; its boxes are given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.sampling import lot

#: Blocks an axis; of each axis a block's size, and its separator's size and place.
BLOCKS = 10
SHAPE = {"row": (60, 7, 26), "col": (80, 6, 66)}
KINDS = {"row": ("none", "solid", "dashed", "fake"), "col": ("none", "solid", "dashed")}


def blocks(spark: SparkSession, samples: int, seed: int = 0) -> DataFrame:
    """sample, axis, block, kind; the same for the same seed."""
    ids = spark.range(samples).withColumnRenamed("id", "sample").withColumn("axis", F.explode(F.array(F.lit("row"), F.lit("col"))))
    ids = ids.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
    drawn = ids.withColumn("_id", F.concat("sample", "axis", "block"))
    drawn = drawn.withColumn("_lot", lot("_id", seed))
    kind = lambda axis: F.get(F.array(*[F.lit(k) for k in KINDS[axis]]), (F.col("_lot") % len(KINDS[axis])).cast("int"))
    return drawn.select("sample", "axis", "block", F.when(F.col("axis") == "row", kind("row")).otherwise(kind("col")).alias("kind"))


def lines(blocks_: DataFrame) -> DataFrame:
    """sample, axis, at, pattern (solid, dashed or none) and target of every pixel line."""
    out = None
    for axis, (size, wide, start) in SHAPE.items():
        one = blocks_.where(F.col("axis") == axis).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
        inside = F.col("_o").between(start, start + wide - 1)
        pattern = F.when(inside & F.col("kind").isin("solid", "fake"), "solid").when(inside & (F.col("kind") == "dashed"), "dashed").otherwise("none")
        target = (inside & F.col("kind").isin("solid", "dashed")).cast("long")
        one = one.select("sample", "axis", (F.col("block") * size + F.col("_o")).alias("at"), pattern.alias("pattern"), target.alias("target"))
        out = one if out is None else out.unionByName(one)
    return out


def pixels(lines_: DataFrame) -> DataFrame:
    """sample, y, x, v: white (1) but on separators; of dashed ones every tenth pixel stays white."""
    rows = lines_.where("axis = 'row'").selectExpr("sample", "at AS y", "pattern AS across")
    cols = lines_.where("axis = 'col'").selectExpr("sample", "at AS x", "pattern AS down")
    dark = lambda pattern, along: (F.col(pattern) == "solid") | ((F.col(pattern) == "dashed") & (F.col(along) % 10 != 0))
    return rows.join(cols, "sample").select("sample", "y", "x", F.when(dark("across", "x") | dark("down", "y"), 0).otherwise(1).cast("long").alias("v"))


def text_boxes(blocks_: DataFrame, seed: int = 0) -> DataFrame:
    """One box a row block; it starts with a capital where the block has a real separator."""
    rows = blocks_.where("axis = 'row'").withColumn("_id", F.concat("sample", "block")).withColumn("b", F.col("block") * SHAPE["row"][0] + 18)
    return rows.select("sample", "block", F.lit(3).alias("l"), F.greatest(F.col("b") - 17, F.lit(0)).alias("t"), F.lit(43).alias("r"), "b", (50 + lot("_id", seed) % 50).alias("conf"), F.col("kind").isin("solid", "dashed").cast("long").alias("start_like"))
