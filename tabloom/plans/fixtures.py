"""Word, image and score tables derived from the driver's tables, in Spark and in the oracle's SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document, laid out eight a line, five lines a block."""
    clean = F.split(F.trim(F.regexp_replace("text", "[ \\t\\n\\r\\f]+", " ")), " ")
    tok = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(clean).alias("pos", "text"))
    tok = tok.withColumn("pos", F.col("pos").cast("long")).withColumn("n", F.length("text").cast("long"))
    return tok.selectExpr(
        "page", "pos", "text", "pos div 40 AS block", "(pos div 8) % 5 AS line", "pos % 8 AS word",
        "40 + (pos % 8) * 90 + (pos * 7) % 13 AS l", "40 + (pos div 8) * 30 + (pos * 5) % 4 AS t",
        "40 + (pos % 8) * 90 + (pos * 7) % 13 + least(9 * n, 80) AS r",
        "40 + (pos div 8) * 30 + (pos * 5) % 4 + 14 + n % 5 + CASE WHEN pos % 37 = 0 THEN 18 ELSE 0 END AS b",
    )


def ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping sources of words, each missing some."""
    w = words(spark, sf_dir).withColumn("src", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
    return w.where("(pos + src) % (3 + src) <> 0").selectExpr("page", "src", "pos", "text", "l + 3 * src AS l", "t + src AS t", "r + 3 * src AS r", "b + src AS b", "(page * 31 + pos * 17 + src * 7) % 101 AS conf")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored sequence per user."""
    e = table(spark, sf_dir, "events")
    i = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    p = (F.floor(F.col("value") * 100).cast("long") % 1001).cast("double") / F.lit(1000.0)
    return e.select(F.col("user_id").cast("long").alias("k"), i.alias("i"), p.alias("p"), F.col("event_type").isin("error", "signup").cast("long").alias("target"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as binary images of 50 lines."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.posexplode("embedding").alias("x", "e"))
    return e.selectExpr("vec_id div 50 AS img", "vec_id % 50 AS y", "CAST(x AS BIGINT) AS x", "CASE WHEN e > 0 THEN 1L ELSE 0L END AS v")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word box per vector, fifty an image of 64 x 50."""
    e = table(spark, sf_dir, "embeddings").selectExpr("CAST(vec_id AS BIGINT) div 50 AS img", "CAST(vec_id AS BIGINT) % 50 AS word")
    return e.selectExpr("img", "word", "(word * 7 + img) % 50 AS l", "(word * 13 + img) % 40 AS t", "(word * 7 + img) % 50 + 3 + word % 5 AS r", "(word * 13 + img) % 40 + 2 + word % 4 AS b", "CASE WHEN word % 3 = 0 THEN 1L ELSE 0L END AS start_like", "CASE WHEN word % 11 = 0 THEN '(' WHEN word % 11 = 5 THEN ')' WHEN word % 3 = 0 THEN concat('A', word) ELSE CAST(word * 37 AS STRING) END AS text")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).groupBy("img").agg(F.lit(64).cast("long").alias("w"), F.lit(50).cast("long").alias("h"), F.max("word").alias("last"))


def axis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the pixel lines of both axes of padded tables."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    score = lambda c: f"CAST(CAST(floor(abs({c}) * 100000) AS BIGINT) % 1000 AS DOUBLE) / 1000.0D"
    row = e.selectExpr("vec_id div 50 AS img", "'row' AS axis", "40 + vec_id % 50 AS at", "130L AS size", score("e[1]") + " AS p")
    col = e.where("vec_id % 50 = 0").selectExpr("vec_id div 50 AS img", "posexplode(e) AS (x, v)").selectExpr("img", "'col' AS axis", "40L + x AS at", "144L AS size", score("v") + " AS p")
    return row.unionByName(col).selectExpr("*", "CASE WHEN (at * 7 + img) % 5 = 0 THEN 1L ELSE 0L END AS target")


def table_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).selectExpr("img", "word AS pos", "text", "l + 40 AS l", "t + 40 AS t", "r + 40 AS r", "b + 40 AS b")


SCORE = "CAST(CAST(floor(abs({}) * 100000) AS BIGINT) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)"
SQL = {
    "tok": "SELECT page, unnest(w) AS text, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS pos FROM (SELECT doc_id AS page, string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), ' ') AS w FROM documents)",
    "words": "SELECT page, pos, text, pos // 40 AS block, (pos // 8) % 5 AS line, pos % 8 AS word, 40 + (pos % 8) * 90 + (pos * 7) % 13 AS l, 40 + (pos // 8) * 30 + (pos * 5) % 4 AS t, 40 + (pos % 8) * 90 + (pos * 7) % 13 + least(9 * length(text), 80) AS r, 40 + (pos // 8) * 30 + (pos * 5) % 4 + 14 + length(text) % 5 + CASE WHEN pos % 37 = 0 THEN 18 ELSE 0 END AS b FROM tok",
    "ocr": "SELECT page, src, pos, text, l + 3 * src AS l, t + src AS t, r + 3 * src AS r, b + src AS b, (page * 31 + pos * 17 + src * 7) % 101 AS conf FROM words CROSS JOIN (VALUES (CAST(0 AS BIGINT)), (1), (2)) s(src) WHERE (pos + src) % (3 + src) <> 0",
    "scores": "SELECT CAST(user_id AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(CAST(floor(value * 100) AS BIGINT) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE) AS p, CAST(event_type IN ('error', 'signup') AS BIGINT) AS target FROM events",
    "pixels": "SELECT vec_id // 50 AS img, vec_id % 50 AS y, x, CAST(CASE WHEN embedding[x + 1] > 0 THEN 1 ELSE 0 END AS BIGINT) AS v FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS x FROM embeddings)",
    "boxes": "SELECT vec_id // 50 AS img, vec_id % 50 AS word, (vec_id % 50 * 7 + vec_id // 50) % 50 AS l, (vec_id % 50 * 13 + vec_id // 50) % 40 AS t, (vec_id % 50 * 7 + vec_id // 50) % 50 + 3 + vec_id % 50 % 5 AS r, (vec_id % 50 * 13 + vec_id // 50) % 40 + 2 + vec_id % 50 % 4 AS b, CAST(CASE WHEN vec_id % 50 % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS start_like, CASE WHEN vec_id % 50 % 11 = 0 THEN '(' WHEN vec_id % 50 % 11 = 5 THEN ')' WHEN vec_id % 50 % 3 = 0 THEN 'A' || (vec_id % 50) ELSE CAST(vec_id % 50 * 37 AS VARCHAR) END AS text FROM embeddings",
    "axis_scores": "SELECT *, CAST(CASE WHEN (at * 7 + img) % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS target FROM (SELECT vec_id // 50 AS img, 'row' AS axis, 40 + vec_id % 50 AS at, CAST(130 AS BIGINT) AS size, " + SCORE.format("CAST(embedding[2] AS DOUBLE)") + " AS p FROM embeddings UNION ALL SELECT vec_id // 50, 'col', 40 + x, 144, " + SCORE.format("CAST(embedding[x + 1] AS DOUBLE)") + " FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS x FROM embeddings WHERE vec_id % 50 = 0))",
    "table_words": "SELECT img, word AS pos, text, l + 40 AS l, t + 40 AS t, r + 40 AS r, b + 40 AS b FROM boxes",
}
NEEDS = {"words": ["tok"], "ocr": ["tok", "words"], "table_words": ["boxes"]}


def oracle(body: str, *fixtures: str) -> str:
    """A query with the fixtures' definitions before it. body: `SELECT ...` or `name AS (...), ... SELECT ...`."""
    order = list(dict.fromkeys(x for f in fixtures for x in [*NEEDS.get(f, []), f]))
    parts = [f"{f} AS ({SQL[f]})" for f in order]
    body = body.strip()
    head = f"WITH {', '.join(parts)}" if parts else "WITH"
    text = f"{head} {body}" if body.upper().startswith("SELECT") else f"{head}{',' if parts else ''} {body}"
    return re.sub(r"\bat\b(?!\")", '"at"', text)  # the oracle reserves the word
