"""Readers: word tables, features, annotations, detected boxes, and names as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
VOC = f"struct<name:string,bndbox:{BOX}>"
META = "table_coords struct<x0:double,x1:double,y0:double,y1:double>, dpi_pdf int, dpi_model int, dpi_words int, padding_model int, name_stem string, image_angle double"
PROPOSALS = "row_separator_predictions array<array<int>>, col_separator_predictions array<array<int>>"


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Page words; what names the page is taken from the partition columns or the file name."""
    return spark.read.parquet(path).withColumn("source_file", F.col("_metadata.file_name"))


def features(spark: SparkSession, path: str, names: list[str], scalars: list[str]) -> DataFrame:
    """Feature documents with an explicit schema: vectors by name, and scalars."""
    schema = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in names] + [T.StructField(n, T.DoubleType()) for n in scalars])
    return spark.read.schema(schema).json(path, multiLine=True)


def long_features(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Vectors side by side -> one row a position."""
    return df.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("at", "_v")).select(*keys, F.col("at").cast("long").alias("at"), *[F.col(f"_v.{n}").alias(n) for n in names])


def proposals(df: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """Separator proposals from their JSON: key, axis, number, start, end."""
    parsed = df.select(*keys, F.from_json(json_col, PROPOSALS).alias("_p"))
    axes = [parsed.select(*keys, F.lit(a).alias("axis"), F.posexplode(f"_p.{a}_separator_predictions").alias("n", "_s")) for a in ("row", "col")]
    both = axes[0].unionByName(axes[1])
    return both.select(*keys, "axis", F.col("n").cast("long").alias("n"), F.get("_s", F.lit(0)).cast("long").alias("start"), F.get("_s", F.lit(1)).cast("long").alias("end"))


def annotation_boxes(df: DataFrame, xml_col: str, keys: list[str], name: str) -> DataFrame:
    """Boxes of one object name from VOC annotations held in a column."""
    parsed = df.select(*keys, F.from_xml(xml_col, f"object array<{VOC}>").alias("_a"))
    rows = parsed.select(*keys, F.posexplode(F.filter("_a.object", lambda o: o["name"] == name)).alias("n", "_o"))
    return rows.select(*keys, F.col("n").cast("long").alias("n"), *[F.col(f"_o.bndbox.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def read_annotations(spark: SparkSession, path: str, name: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "object").schema(f"name string, bndbox {BOX}").load(path)
    return rows.where(F.col("name") == name).select("name", "bndbox.*")


def detected_boxes(lines: DataFrame, line_col: str, width: Column, height: Column, rotation: Column | None = None) -> DataFrame:
    """Relative `cat xc yc w h [conf]` lines -> boxes in pixels; a page turned by a quarter swaps its sides."""
    part = F.split(F.trim(F.col(line_col)), r"\s+")
    upright = F.lit(True) if rotation is None else rotation.isin(0, 180)
    w, h = F.when(upright, width).otherwise(height), F.when(upright, height).otherwise(width)
    v = [F.get(part, F.lit(i)).cast("double") for i in range(6)]
    return lines.select(*[c for c in lines.columns if c != line_col], v[0].cast("long").alias("cat"), ((v[1] - v[3] / 2) * w).alias("x0"), ((v[2] - v[4] / 2) * h).alias("y0"), ((v[1] + v[3] / 2) * w).alias("x1"), ((v[2] + v[4] / 2) * h).alias("y1"), v[5].alias("conf"))


def whole_boxes(df: DataFrame, line: str, width: Column, height: Column) -> DataFrame:
    """Boxes in whole pixels (half to even) from a detector's lines of exactly six numbers: class, centre,
    size, confidence. Another number of fields is an error."""
    parts = F.split(line, " ")
    six = F.when(F.size(parts) == 6, parts).otherwise(F.raise_error(F.concat(F.lit("six numbers expected: "), F.col(line))))
    n = lambda i: F.col("_f")[i].cast("double")
    edge = lambda centre, size, sign, whole: F.bround((n(centre) + sign * n(size) / 2) * whole, 0).cast("long")
    out = df.withColumn("_f", six)
    return out.withColumn("x0", edge(1, 3, -1, width)).withColumn("y0", edge(2, 4, -1, height)).withColumn("x1", edge(1, 3, 1, width)).withColumn("y1", edge(2, 4, 1, height)).drop("_f", line)


def word_quads(df: DataFrame) -> DataFrame:
    """Quadrilaterals of an OCR engine -> boxes and percentages."""
    corner = lambda i, j: F.get(F.get("quad", F.lit(i)), F.lit(j))
    return df.withColumn("left", corner(0, 0)).withColumn("right", corner(1, 0)).withColumn("top", corner(0, 1)).withColumn("bottom", corner(2, 1)).withColumn("conf", F.col("conf") * 100).drop("quad")


def with_angle(pages: DataFrame, angles: DataFrame, keys: list[str]) -> DataFrame:
    """Skew angles by look-up; 0 where none is known."""
    return pages.join(angles, keys, "left").withColumn("angle", F.coalesce("angle", F.lit(0.0)))


def most_frequent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, the smallest on a tie."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = W.partitionBy(*keys).orderBy(F.desc("n"), value)
    return counts.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def otsu(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Threshold of greatest between-class variance of each image's histogram (256 rows a key)."""
    hist = pixels.groupBy(*keys, value).agg(F.count("*").alias("n"))
    up, all_ = W.partitionBy(*keys).orderBy(value), W.partitionBy(*keys)
    w0, s0 = F.sum("n").over(up), F.sum(F.col(value) * F.col("n")).over(up)
    h = hist.withColumn("w0", w0).withColumn("s0", s0).withColumn("w", F.sum("n").over(all_)).withColumn("s", F.sum(F.col(value) * F.col("n")).over(all_))
    w1 = F.col("w") - F.col("w0")
    apart = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    h = h.where(F.col("w0") < F.col("w")).withColumn("variance", F.col("w0") * w1 * apart * apart)
    return h.groupBy(*keys).agg(F.max_by(value, F.struct("variance", -F.col(value))).alias("threshold"))


def name_parts(name: Column) -> Column:
    """`document-p3_t2` -> struct of document, page and table."""
    p = r"^(.*)-p([0-9]+)(?:_t([0-9]+))?"
    number = lambda g: F.nullif(F.regexp_extract(name, p, g), F.lit("")).cast("long")
    return F.struct(F.regexp_extract(name, p, 1).alias("pdf"), number(2).alias("page"), number(3).alias("table"))


def pages_of(names: DataFrame, col: str) -> DataFrame:
    parts = names.select(name_parts(F.col(col)).alias("_p")).select("_p.*")
    return parts.groupBy("pdf").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.count("table").alias("n_tables"))
