"""Samples, splits, chunks and batches. Random order is the order of a seeded hash, so results
repeat on any cluster and any partitioning."""

from __future__ import annotations

import math
import re
import tempfile

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def lot(col: str, seed: int) -> Column:
    """A number of 48 bits from an md5 sum: the same order in every engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(col).cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def running_total(df: DataFrame, order: list[str], amount: Column, out: str, rows_a_part: int = 250_000) -> DataFrame:
    """Adds the sum of amount over the rows before, in the given order (the first column numeric).

    No task orders everything: the first column is cut at quantiles found once, a number for every
    `rows_a_part` rows; cells are ordered apart and start from the sums of those before. Rows equal in
    the first column share a cell.
    """
    parts = max(8, -(-df.count() // rows_a_part))
    bounds = sorted(set(df.approxQuantile(order[0], [i / parts for i in range(1, parts)], min(0.002, 0.25 / parts))))
    rows = df.withColumn("_at", F.col(order[0]).cast("double")).withColumn("_amount", amount)
    # found by bisection, so that many parts cost no more; nulls come first
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_at", outputCol="_cell", handleInvalid="keep")
    rows = cut.transform(rows).withColumn("_cell", F.when(F.col("_at").isNull(), -1).otherwise(F.col("_cell").cast("int"))).drop("_at")
    inside = F.sum("_amount").over(W.partitionBy("_cell").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    sums = rows.groupBy("_cell").agg(F.sum("_amount").alias("_c"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_c").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    total = (F.col("_base") + F.coalesce("_in", F.lit(0))).cast("long")
    return rows.withColumn("_in", inside).join(base, "_cell").withColumn(out, total).drop("_cell", "_amount", "_in", "_base")


def numbered(df: DataFrame, order: list[str], out: str = "n") -> DataFrame:
    return running_total(df, order, F.lit(1).cast("long"), out)


def top_k(values: Column, k: int) -> Column:
    return F.slice(F.sort_array(values, asc=False), 1, k)


def until_enough(df: DataFrame, order: str, amount: str, most: int) -> DataFrame:
    """First rows in order until their amounts reach `most`; the row that crosses it is included."""
    return running_total(df, [order], F.col(amount).cast("long"), "_before").where(F.col("_before") < most).drop("_before")


def sample(df: DataFrame, col: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement, all if there are fewer."""
    return df.orderBy(lot(col, seed), col).limit(k)


def chunks(df: DataFrame, col: str, size: int, seed: int) -> DataFrame:
    """Random chunks of `size` rows, the last one short."""
    rows = numbered(df.withColumn("_lot", lot(col, seed)), ["_lot", col], "_n")
    return rows.withColumn("chunk", F.floor(F.col("_n") / size).cast("long")).drop("_n", "_lot")


def split(df: DataFrame, col: str, shares: dict[str, float], seed: int) -> DataFrame:
    """Named parts by ratio: cut points int(n * cumulative share) of the random order."""
    n, at, cut = df.count(), 0.0, F.lit(None).cast("string")
    rows = numbered(df.withColumn("_lot", lot(col, seed)), ["_lot", col], "_n")
    names = list(shares)
    for name in names:
        at += shares[name]
        end = n if name == names[-1] else int(n * at)
        cut = F.coalesce(cut, F.when(F.col("_n") < end, F.lit(name)))
    return rows.withColumn("split", cut).drop("_n", "_lot")


def split_keeping(df: DataFrame, col: str, prior: DataFrame, shares: dict[str, float], most: dict[str, int], seed: int) -> DataFrame:
    """Split that keeps what earlier splits decided (train over val over test), then fills test,
    then val, and gives the rest to train. prior(col, split)."""
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    before = prior.groupBy(col).agg(F.min_by("split", rank).alias("_old"))
    rows = df.join(before, col, "left")
    n = df.count()
    have = {r["_old"]: r["count"] for r in rows.where("_old IS NOT NULL").groupBy("_old").count().collect()}  # three rows at most
    need = {s: max(0, min(round(shares.get(s, 0) * n), most.get(s, n)) - have.get(s, 0)) for s in ("test", "val")}
    free = numbered(rows.where("_old IS NULL").withColumn("_lot", lot(col, seed)), ["_lot", col], "_n").drop("_lot")
    new = F.when(F.col("_n") < need["test"], "test").when(F.col("_n") < need["test"] + need["val"], "val").otherwise("train")
    return rows.where("_old IS NOT NULL").withColumnRenamed("_old", "split").unionByName(free.withColumn("split", new).drop("_n", "_old"))


def kept(df: DataFrame) -> DataFrame:
    """df computed once and stored in the folder that the cluster names in spark.checkpoint.dir. Only
    where that is unset and master is local, a folder of this machine does."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="batches-"))
    return df.checkpoint()


def naive_batches(df: DataFrame, order: str, size: int) -> DataFrame:
    return numbered(df, [order], "_n").withColumn("batch", F.floor(F.col("_n") / size).cast("long")).drop("_n")


def bucket_batches(df: DataFrame, id_col: str, x: str, y: str, size: int, bins: int = 16, rounds: int = 32) -> DataFrame:
    """Batches of rows alike in two measures. Equal-width cells in both (the root of `bins` each
    way, fewer every round), full batches of a cell are accepted, the rest goes on; what no round
    places is batched in order of the measures. No row is lost. Each round's rows are stored, so that
    none is computed again."""
    left, out, first = df, None, 0
    for _ in range(rounds):
        side = max(1, math.ceil(math.sqrt(bins)))
        lo = left.agg(F.min(x), F.max(x), F.min(y), F.max(y), F.count("*")).first()
        if not lo[4] or bins <= 2:
            break
        cell = [F.least(F.floor((F.col(c) - a) * side / max(b - a, 1e-12)), F.lit(side - 1)) if b > a else F.lit(0) for c, a, b in ((x, lo[0], lo[1]), (y, lo[2], lo[3]))]
        rows = left.withColumn("_cell", cell[0] * side + cell[1])
        order = W.partitionBy("_cell").orderBy(x, y, id_col)
        rows = rows.withColumn("_b", F.floor((F.row_number().over(order) - 1) / size)).withColumn("_full", F.floor(F.count("*").over(W.partitionBy("_cell")) / size))
        rows = kept(rows)
        done = rows.where("_b < _full").withColumn("batch", F.concat_ws("-", F.lit(f"{first:02d}"), F.col("_cell").cast("string"), F.col("_b").cast("string")))
        done = done.drop("_cell", "_b", "_full")
        out = done if out is None else out.unionByName(done)
        left = rows.where("_b >= _full").drop("_cell", "_b", "_full")
        bins, first = bins // 2, first + 1
    rest = numbered(left, [x, y, id_col], "_n")
    rest = rest.withColumn("batch", F.concat_ws("-", F.lit("rest"), F.floor(F.col("_n") / size).cast("string"))).drop("_n")
    return rest if out is None else out.unionByName(rest)


def shuffled_batches(batches: DataFrame, batch: str, seed: int) -> DataFrame:
    """Batches in random order, rows within a batch as they were."""
    names = numbered(batches.select(batch).distinct().withColumn("_lot", lot(batch, seed)), ["_lot", batch], "batch_order").drop("_lot")
    return batches.join(names, batch)


def padded(df: DataFrame, batch: str, values: str) -> DataFrame:
    """Arrays of a batch made as long as its longest by repeating their last value."""
    most = F.max(F.size(values)).over(W.partitionBy(batch))
    out = df.withColumn("_m", most)
    return out.withColumn(values, F.concat(F.col(values), F.array_repeat(F.element_at(values, -1), F.col("_m") - F.size(values)))).drop("_m")


def padded_proposals(df: DataFrame, batch: str, spans: str, size: str) -> DataFrame:
    """Arrays of proposals (start, end) made as long as the batch's longest; what is added lies on the
    last two lines of the batch's largest table."""
    one = W.partitionBy(batch)
    out = df.withColumn("_m", F.max(F.size(spans)).over(one)).withColumn("_z", F.max(size).over(one).cast("long"))
    last = F.struct((F.col("_z") - 2).alias("start"), (F.col("_z") - 1).alias("end"))
    return out.withColumn(spans, F.concat(F.col(spans), F.array_repeat(last, F.col("_m") - F.size(spans)))).drop("_m", "_z")


def unpadded(df: DataFrame, keys: list[str], arrays: list[str], size: str) -> DataFrame:
    """One row a position of padded arrays, without what padding added: keys, at, and the arrays' values."""
    own = [F.slice(F.col(a), 1, F.col(size)).alias(a) for a in arrays]
    return df.select(*keys, *own).select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("at", "_v")).select(*keys, F.col("at").cast("long").alias("at"), *[F.col(f"_v.{a}").alias(a) for a in arrays])
