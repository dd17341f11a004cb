"""Comparing table images by their hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text as X

#: Fixed value: the least similarity of images of one table.
ALIKE = 0.85


def matched(images: DataFrame, candidates: DataFrame, keys: list[str], number: str, least: float = ALIKE) -> DataFrame:
    """images and candidates(keys, number, bits, w, h): each image with the candidate of its page that it
    shows: that of its own number if that is alike enough, else the most similar (the smaller number on
    a tie), and none where even that one is not. A page's images meet all its candidates, which are
    the tables of one page. Keys, number, found, similarity (of the best one), own (similarity)."""
    left = images.select(*keys, number, F.col("bits").alias("_bits"), F.col("w").alias("_w"), F.col("h").alias("_h"))
    right = candidates.select(*keys, F.col(number).alias("_c"), "bits", "w", "h")
    gap = F.greatest(F.abs(F.col("w") - F.col("_w")), F.abs(F.col("h") - F.col("_h")))
    pairs = left.join(right, keys, "left").withColumn("_s", F.coalesce(X.hash_similarity(F.col("_bits"), F.col("bits"), gap), F.lit(0.0)))
    out = pairs.groupBy(*keys, number).agg(
        F.max(F.when(F.col("_c") == F.col(number), F.col("_s"))).alias("own"), F.max(F.struct("_s", (-F.col("_c")).alias("_c"))).alias("_best"))
    found = F.when(F.col("own") >= least, F.col(number)).when(F.col("_best._s") >= least, -F.col("_best._c"))
    return out.select(*keys, number, found.alias("found"), F.col("_best._s").alias("similarity"), "own")
