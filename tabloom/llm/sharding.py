"""Sharding by proportional stratified interleaving.

Rows are put into a seeded random order within their source; a row's rank divided by the
number of its source's rows is its fractional rank. Sorted by fractional rank all sources
advance in step, so cutting that order into equal parts gives every shard the mixture of the
whole, a source of n rows having n/shards +- 1 rows in each. The law is `rows`: shard
sizes differ by one at most.

No task sorts a source or the whole: ranks come from bucket counts plus an order within a
bucket (see prefix_within), a bucket being about one part in `BUCKETS` of a source or of all.

Defined results: source null -> a source of its own; text null -> size 1, CRC of no bytes (0);
repeated rows are interchangeable, each gets its own slot; ties in the random order go by
doc_id; an empty table gives an empty result; columns shard and slot of the input are replaced,
other extra columns are kept. Equal texts are not held together: a group of copies
larger than a shard cannot be while counts stay one apart, so the law `rows` and groups exclude each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.llm._shared import prefix_within, read_table, unit_hash

SEED = 77
BUCKETS = 4096


def interleave(df: DataFrame, keys: list[str], source_col: str = "source", shards: int = 8, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """df plus shard int and slot long. `keys`: columns that tell rows apart; rows equal in
    them are interchangeable. Column names with a leading underscore are reserved here."""
    rows = df.drop("shard", "slot").withColumn("_src", F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")))
    rows = rows.withColumn("_u", unit_hash(*[F.col(k) for k in keys], F.col("_src"), seed=seed)).withColumn("_one", F.lit(1).cast("long"))
    ranked = prefix_within(rows, "_src", "_u", "_one", "_rank", "_n", buckets)
    at = (F.col("_rank") + F.lit(0.5)) / F.col("_n")
    ranked = ranked.withColumn("_at", at)
    # a source's rows are spread evenly, so a bucket of the merged order has its share of all rows
    cell = F.least(F.floor(F.col("_at") * buckets), F.lit(buckets - 1)).cast("int")
    ranked = ranked.withColumn("_cell", cell)
    counts = ranked.groupBy("_cell").agg(F.count("*").alias("_c"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_c").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    total = F.broadcast(counts.agg(F.sum("_c").alias("_total")))
    inside = F.row_number().over(W.partitionBy("_cell").orderBy("_at", F.xxhash64("_src"), "_src", "_u"))
    out = ranked.withColumn("_in", inside - 1).join(F.broadcast(base), "_cell").crossJoin(total)
    pos = F.col("_base") + F.col("_in")
    out = out.withColumn("_pos", pos).withColumn("shard", F.floor(F.col("_pos") * shards / F.col("_total")).cast("int"))
    # integer arithmetic decides: the first position of a shard is ceil(shard * total / shards)
    first = lambda s: F.expr(f"({s} * _total + {shards - 1}) div {shards}")
    out = out.withColumn("shard", F.when(F.col("_pos") < first("shard"), F.col("shard") - 1).when(F.col("_pos") >= first("(shard + 1)"), F.col("shard") + 1).otherwise(F.col("shard")))
    out = out.withColumn("slot", (F.col("_pos") - first("shard")).cast("long"))
    return out.drop("_src", "_u", "_one", "_rank", "_n", "_at", "_cell", "_in", "_base", "_total", "_pos")


def sharded(docs: DataFrame, source_col: str = "source", shards: int = 8, seed: int = SEED) -> DataFrame:
    """Whole documents with shard and slot. Slots are found on (key, source) alone; the texts
    are shuffled once, to their rows' slots. Rows equal in every column share them in any order."""
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    key = F.xxhash64(*columns)
    rows = docs.select(F.struct(*columns).alias("row"), key.alias("_key"))
    rows = rows.withColumn("_copy", F.row_number().over(W.partitionBy("_key").orderBy("_key")))
    slim = docs.select(key.alias("_key"), F.col(source_col).alias("_source"))
    slots = interleave(slim, ["_key"], "_source", shards, seed)
    slots = slots.withColumn("_copy", F.row_number().over(W.partitionBy("_key").orderBy("shard", "slot"))).drop("_source")
    return rows.join(slots, ["_key", "_copy"]).select("row.*", "shard", "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    out = interleave(slim, ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
