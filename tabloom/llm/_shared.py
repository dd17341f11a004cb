"""Helpers that several corpus operators use: stored intermediate tables, splits of rows
without a hot task, connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: ASCII white space: 0x20 and 0x09 to 0x0D.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is
    unset and master is local (tests on one machine) a folder of this machine is chosen."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tabloom-"))
            atexit.register(shutil.rmtree, _LOCAL[0].removeprefix("file://"), ignore_errors=True)
        folder = _LOCAL[0]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and reread: lineage ends there, and lost
    executors cost no more than the tasks they were running."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing will read again."""
    jvm = df.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_hash(*cols: Column, seed: int) -> Column:
    """A value of [0, 1) with 52 random bits, the same in every run."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def prefix_within(df: DataFrame, group: str, at: str, size: str, out: str, total: str, buckets: int = 4096) -> DataFrame:
    """Adds `out`: the sum of `size` over the rows of the same group with smaller `at`
    (a value of [0, 1) that is uniform and has no ties but between interchangeable rows),
    and `total`, the sum over the group.

    No task gets a group: [0, 1) is cut into equal buckets, their sums (at most `buckets`
    rows a group, added up before the shuffle) are accumulated, and only rows of one group
    and one bucket are put in order together. A row without group forms a group with its like.
    """
    cell = F.least(F.floor(F.col(at) * buckets), F.lit(buckets - 1)).cast("int")
    rows = df.withColumn("_cell", cell).withColumn("_null", F.col(group).isNull()).withColumn("_grp", F.coalesce(F.col(group).cast("string"), F.lit("")))
    key = ["_null", "_grp", "_cell"]
    before = W.partitionBy("_null", "_grp").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    base = rows.groupBy(*key).agg(F.sum(size).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).withColumn(total, F.sum("_sum").over(W.partitionBy("_null", "_grp"))).drop("_sum")
    inside = W.partitionBy(*key).orderBy(at, size).rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return ranked.join(base, key).withColumn(out, F.col("_base") + F.col("_in")).drop(*key, "_in", "_base")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(a, b) of any orderable type -> (node, root) for every node of an edge, root being
    the smallest node of its connected component.

    Every round each node adopts its smallest neighbour (sums by key, so a hub is added up
    before the shuffle), pointers are followed twice, and edges are rewritten to the roots.
    The edges between different roots fall fast; a table of each round is stored, and nothing
    but their number reaches the driver.
    """
    links = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    labels = stored(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node")), name)
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        step = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        for _ in range(2):
            up = step.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            step = step.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
        step = stored(step, name)
        moved = links.join(step.withColumnRenamed("p", "pa"), "a").join(step.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        # a node that others now point at but that points on itself stays tied to its pointer
        halfway = step.where("a <> p").join(step.select(F.col("p").alias("a")).distinct(), "a", "left_semi")
        moved = moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        old = links, labels, step
        links = stored(moved.union(halfway.select("p", "a")).distinct(), name)
        labels = stored(labels.join(step.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), name)
        for table in old:
            dropped(table)
    return labels
