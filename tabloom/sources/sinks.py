"""Writers: words, features, tables, annotations, rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Directory policies and the writer modes that do the same. `warn` asks before it writes into a folder that
#: exists; nobody can be asked here, so such a write is an error, never left out in silence.
MODES = {"fail": "errorifexists", "replace": "overwrite", "overwrite": "append", "warn": "errorifexists"}


def write_words(df: DataFrame, path: str, by: str = "pdf", policy: str = "fail") -> None:
    df.write.mode(MODES[policy]).partitionBy(by).parquet(path)


def write_long(df: DataFrame, path: str, policy: str = "fail") -> None:
    df.write.mode(MODES[policy]).parquet(path)


def write_json(df: DataFrame, path: str, policy: str = "fail") -> None:
    df.write.mode(MODES[policy]).json(path)


def write_rejects(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("sep", "\t").option("header", "true").csv(path)


def as_json(df: DataFrame, keys: list[str], values: list[str], out: str = "json") -> DataFrame:
    """Vectors of each key's rows in order of `at`, as one JSON document."""
    sorted_ = F.array_sort(F.collect_list(F.struct("at", *[v for v in values if v != "at"])))
    g = df.groupBy(*keys).agg(sorted_.alias("_a"))
    return g.select(*keys, F.to_json(F.struct(*[F.col(f"_a.{v}").alias(v) for v in values])).alias(out))


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def as_annotation(boxes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """VOC annotation of each key: boxes name, xmin, ymin, xmax, ymax[, confidence] in order; with the
    image's size before them if the boxes have width and height."""
    tag = lambda n: F.concat(F.lit(f"<{n}>"), F.col(n).cast("string"), F.lit(f"</{n}>"))
    sure = F.concat(F.lit("<confidence>"), F.col("confidence").cast("string"), F.lit("</confidence>")) if "confidence" in boxes.columns else F.lit("")
    one = F.concat(F.lit("<object><name>"), _escaped(F.col("name")), F.lit("</name>"), F.coalesce(sure, F.lit("")), F.lit("<bndbox>"), tag("xmin"), tag("ymin"), tag("xmax"), tag("ymax"), F.lit("</bndbox></object>"))
    parts = F.array_sort(F.collect_list(F.struct(*order, one.alias("_x"))))
    body = F.concat_ws("", F.transform(parts, lambda p: p["_x"]))
    sized = {"width", "height"} <= set(boxes.columns)
    of = lambda n: F.concat(F.lit(f"<{n}>"), F.max(n).cast("string"), F.lit(f"</{n}>"))
    size = F.concat(F.lit("<size>"), of("width"), of("height"), F.lit("</size>")) if sized else F.lit("")
    return boxes.groupBy(*keys).agg(F.concat(F.lit("<annotation>"), size, body, F.lit("</annotation>")).alias("xml"))


def as_detector_lines(boxes: DataFrame, classes: dict[str, int], width: Column, height: Column) -> DataFrame:
    """Boxes -> class number, centre and size relative to the page. Unknown names are left out."""
    number = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    c = F.col
    out = boxes.withColumn("cat", F.try_element_at(number, c("name")).cast("long")).where("cat IS NOT NULL")
    return out.withColumn("xc", (c("xmin") + c("xmax")) / 2 / width).withColumn("yc", (c("ymin") + c("ymax")) / 2 / height).withColumn("w", (c("xmax") - c("xmin")) / width).withColumn("h", (c("ymax") - c("ymin")) / height)


def span_boxes(rows: DataFrame, cols: DataFrame, keys: list[str]) -> DataFrame:
    """Row and column boxes between consecutive wide separators, and the table's own."""
    from tabloom.operators.separators import cell_spans

    r, k = cell_spans(rows, keys), cell_spans(cols, keys)
    extent = lambda d, a, b: d.groupBy(*keys).agg(F.min("low").alias(a), F.max("high").alias(b))
    frame = extent(r, "y0", "y1").join(extent(k, "x0", "x1"), keys)
    row = r.join(frame, keys).select(*keys, F.lit("table row").alias("name"), "n", F.col("x0").alias("xmin"), F.col("low").alias("ymin"), F.col("x1").alias("xmax"), F.col("high").alias("ymax"))
    col = k.join(frame, keys).select(*keys, F.lit("table column").alias("name"), "n", F.col("low").alias("xmin"), F.col("y0").alias("ymin"), F.col("high").alias("xmax"), F.col("y1").alias("ymax"))
    own = frame.select(*keys, F.lit("table").alias("name"), F.lit(0).cast("long").alias("n"), F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), F.col("x1").alias("xmax"), F.col("y1").alias("ymax"))
    return row.unionByName(col).unionByName(own)
