"""Queries on page words: filters, flags, joins of boxes, lines of words, sources."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tabloom.functions import sequences as S
from tabloom.functions import text as X
from tabloom.operators import boxes as B
from tabloom.operators import lines as L
from tabloom.plans import fixtures as D
from tabloom.plans.fixtures import oracle
from tabloom.plans.registry import query
from tabloom.sources import readers as R
from tabloom.sources import synthetic as Y

K = 150 / 72


@query(oracle("SELECT page, src, pos, regexp_replace(text, '[^a-zA-Z0-9À-ÿ\\.\\(\\) ]', '', 'g') AS kept, r - l AS width, b - t AS height FROM ocr WHERE conf > 30 AND length(regexp_replace(text, '[^a-zA-Z0-9À-ÿ\\.\\(\\) ]', '', 'g')) >= 1", "ocr"))
def p_ocr_filter(spark, sf):
    kept = X.visible(F.col("text"))
    return D.ocr(spark, sf).where((F.col("conf") > 30) & (F.length(kept) >= 1)).select("page", "src", "pos", kept.alias("kept"), (F.col("r") - F.col("l")).alias("width"), (F.col("b") - F.col("t")).alias("height"))


@query(oracle("""SELECT page, pos, length(text) >= 2 OR text = '.' OR regexp_matches(text, '^[\\p{L}\\p{N}]+$') AS dense,
    regexp_matches(text, '^[\\p{Lu}\\p{Nd}]') OR regexp_matches(substring(text, 1, 5), '[.)\\-]') AS starts_row,
    regexp_matches(text, '^[\\p{Lu}\\p{Nd}]') OR (regexp_matches(text, '^[.()\\-]') AND length(text) > 1) AS starts_column,
    CAST(list_max(list_transform(string_split_regex(text, '[^\\p{Lu}]+'), lambda x: length(x))) AS BIGINT) AS capital_run,
    regexp_matches(replace(text, ',', ''), '^\\p{N}+$') AS numeric, replace(text, '.', '') AS dotless, nullif(nullif(text, ' '), '') AS filled FROM words""", "words"))
def p_text_flags(spark, sf):
    t = F.col("text")
    return D.words(spark, sf).select("page", "pos", X.dense_enough(t).alias("dense"), X.starts_row(t).alias("starts_row"), X.starts_column(t).alias("starts_column"), X.longest_capital_run(t).alias("capital_run"), X.is_numeric(t).alias("numeric"), X.without_dots(t).alias("dotless"), X.blank_to_null(t).alias("filled"))


@query(oracle(f"""SELECT page, pos, CAST(round_even((l - 100) * CAST({K!r} AS DOUBLE) + 40, 0) AS BIGINT) AS x0, CAST(round_even((t - 60) * CAST({K!r} AS DOUBLE) + 40, 0) AS BIGINT) AS y0,
    CAST(round_even((r - 100) * CAST({K!r} AS DOUBLE) + 40, 0) AS BIGINT) AS x1, CAST(round_even((b - 60) * CAST({K!r} AS DOUBLE) + 40, 0) AS BIGINT) AS y1
    FROM words WHERE t >= 60 AND l >= 100 AND b <= 4000 AND r <= 600""", "words"))
def p_words_in_table(spark, sf):
    """Containment in the table's rectangle, then points to padded model pixels."""
    c = F.col
    w = D.words(spark, sf).where(B.within(c("l"), c("t"), c("r"), c("b"), 100, 60, 600, 4000))
    at = lambda x, o: X.half_even((F.col(x) - o) * F.lit(K) + 40)
    return w.select("page", "pos", at("l", 100).alias("x0"), at("t", 60).alias("y0"), at("r", 100).alias("x1"), at("b", 60).alias("y1"))


@query(oracle("""r AS (SELECT page, tbl, 40 + 300 * tbl AS x0, 60 + page % 5 * 30 AS y0, 390 + 300 * tbl AS x1, 660 + page % 5 * 30 AS y1 FROM (SELECT DISTINCT page FROM words) CROSS JOIN (VALUES (CAST(0 AS BIGINT)), (1)) v(tbl))
    SELECT w.page, w.pos, r.tbl, w.l - r.x0 AS x, w.t - r.y0 AS y FROM words w JOIN r ON w.page = r.page AND w.t >= r.y0 AND w.l >= r.x0 AND w.b <= r.y1 AND w.r <= r.x1""", "words"))
def p_words_by_table(spark, sf):
    """Words of every table rectangle of their page, from its corner."""
    w = D.words(spark, sf)
    tables = w.select("page").distinct().withColumn("tbl", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    tables = tables.selectExpr("page", "tbl", "40 + 300 * tbl AS x0", "60 + page % 5 * 30 AS y0", "390 + 300 * tbl AS x1", "660 + page % 5 * 30 AS y1")
    return B.contained(w, tables, ["page"]).selectExpr("page", "pos", "tbl", "l - x0 AS x", "t - y0 AS y")


@query(oracle("SELECT page, CASE WHEN max(CASE WHEN src = 0 THEN 1 ELSE 0 END) = 0 THEN 'ocr-based' ELSE 'pdf-based' END AS source, count(*) AS n_words FROM ocr GROUP BY page", "ocr"))
def p_text_source(spark, sf):
    pdf = F.max((F.col("src") == 0).cast("int"))
    return D.ocr(spark, sf).groupBy("page").agg(F.when(pdf == 0, "ocr-based").otherwise("pdf-based").alias("source"), F.count("*").alias("n_words"))


@query(oracle("SELECT page, pos, least(greatest(l, 100), 500) AS l, CASE WHEN pos % 2 = 0 THEN CAST(round_even((1 - pos % 3 / CAST(2 AS DOUBLE)) * 240, 0) AS BIGINT) END AS lum, least(greatest(6 - least(pos % 9, pos % 7), 0), 5) / CAST(6 AS DOUBLE) AS caps, CASE WHEN pos % 10 < 5 THEN (pos % 10) / CAST(10 AS DOUBLE) / CAST(5 AS DOUBLE) ELSE (pos % 10) / CAST(10 AS DOUBLE) END AS squashed FROM words", "words"))
def p_scalar_expressions(spark, sf):
    p, pos = (F.col("pos") % 10) / F.lit(10.0), F.col("pos")
    return D.words(spark, sf).select("page", "pos", X.to_page(F.col("l"), 100, 500).alias("l"), F.when(pos % 2 == 0, X.luminosity(pos % 3 / F.lit(2.0))).alias("lum"), X.inverted_capital_run(pos % 9, pos % 7).alias("caps"), X.squashed(p, 0.5).alias("squashed"))


@query(oracle("SELECT page, pos, t, b FROM (SELECT *, avg(b - t) OVER (PARTITION BY page) AS m, stddev_samp(b - t) OVER (PARTITION BY page) AS s FROM words) WHERE s IS NULL OR b - t <= m + 2 * s", "words"))
def p_tall_words(spark, sf):
    return L.not_tall(D.words(spark, sf), ["page"]).select("page", "pos", "t", "b")


@query(oracle("""lines AS (SELECT page, block, line, min(t) AS top, max(b) AS bottom FROM words GROUP BY ALL),
    gaps AS (SELECT *, top > lag(bottom, 1, 0) OVER w AND bottom < lead(top, 1, 9999999) OVER w AS uniform FROM lines WINDOW w AS (PARTITION BY page ORDER BY block, line))
    SELECT page, pos, CASE WHEN uniform THEN top ELSE t END AS t, CASE WHEN uniform THEN bottom ELSE b END AS b, uniform FROM words JOIN gaps USING (page, block, line)""", "words"))
def g_uniform_heights(spark, sf):
    return L.harmonised(D.words(spark, sf)).select("page", "pos", "t", "b", "uniform")


@query(re.sub("^WITH ", "WITH RECURSIVE ", oracle("""s AS (SELECT page, pos, t, b, row_number() OVER (PARTITION BY page ORDER BY t, l, pos) AS k FROM words),
    opened AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS b FROM words
        UNION ALL SELECT o.page, o.n + 1, min(s.k), arg_min(s.b, s.k) FROM opened o JOIN s ON s.page = o.page AND s.k > o.k AND s.b - o.b > 5 AND s.t > o.b GROUP BY o.page, o.n)
    SELECT s.page, s.pos, o.n AS seq_line FROM s ASOF JOIN opened o ON s.page = o.page AND s.k >= o.k""", "words")))
def g_line_numbers(spark, sf):
    return L.numbered(D.words(spark, sf)).select("page", "pos", "seq_line")


@query(oracle("""f AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY block, line) AS seq, max(list_max(list_transform(string_split_regex(text, '[^\\p{Lu}]+'), lambda x: length(x)))) OVER (PARTITION BY page, block, line) AS caps, row_number() OVER (PARTITION BY page, block, line ORDER BY word, pos) AS n FROM words),
    g AS (SELECT *, CAST(regexp_matches(text, '^[\\p{Lu}\\p{Nd}]') OR regexp_matches(substring(text, 1, 5), '[.)\\-]') AS BIGINT) AS start_like FROM f WHERE n = 1),
    h AS (SELECT *, lead(start_like, 1, 1) OVER (PARTITION BY page ORDER BY block, line) AS next_start_like, lead(caps, 1, 0) OVER (PARTITION BY page ORDER BY block, line) AS next_caps, row_number() OVER (PARTITION BY page, t ORDER BY block, line) AS m FROM g)
    SELECT page, seq, t, start_like, CAST(caps AS BIGINT) AS caps, next_start_like, CAST(next_caps AS BIGINT) AS next_caps FROM h WHERE m = 1""", "words"))
def f_line_starts(spark, sf):
    return L.line_starts(D.words(spark, sf)).select("page", "seq", "t", "start_like", "caps", "next_start_like", F.col("next_caps").cast("long").alias("next_caps"))


@query(oracle("""w AS (SELECT * FROM ocr WHERE conf > 30),
    band AS (SELECT *, unnest(range(t // 64, b // 64 + 1)) AS band FROM w),
    hit2 AS (SELECT DISTINCT a.page, a.src, a.pos FROM band a JOIN band o USING (page, band) WHERE a.src = 2 AND o.src = 1 AND a.l < o.r AND a.r >= o.l AND a.t < o.b AND a.b >= o.t),
    rest AS (SELECT page, src, pos FROM w WHERE src = 1 UNION ALL SELECT page, src, pos FROM w WHERE src = 2 AND (page, src, pos) NOT IN (SELECT page, src, pos FROM hit2)),
    hit1 AS (SELECT DISTINCT a.page, a.src, a.pos FROM band a JOIN band o USING (page, band) WHERE a.src > 0 AND o.src = 0 AND a.l < o.r AND a.r >= o.l AND a.t < o.b AND a.b >= o.t)
    SELECT page, src, pos FROM w WHERE src = 0 UNION ALL SELECT page, src, pos FROM rest WHERE (page, src, pos) NOT IN (SELECT page, src, pos FROM hit1)""", "ocr"))
def j_source_precedence(spark, sf):
    w = D.ocr(spark, sf).where("conf > 30")
    return B.by_precedence(*[w.where(F.col("src") == i) for i in range(3)], ["page"], ["page", "src", "pos"]).select("page", "src", "pos")


@query(oracle("""lines AS (SELECT page, block * 5 + line AS seq, min(t) AS top FROM words GROUP BY ALL),
    axis AS (SELECT page, unnest(range(0, m + 1, 7)) AS y FROM (SELECT page, max(b) AS m FROM words GROUP BY page)),
    last AS (SELECT page, top, max(seq) AS seq FROM lines GROUP BY ALL)
    SELECT a.page, a.y, l.seq FROM axis a ASOF LEFT JOIN last l ON a.page = l.page AND a.y >= l.top""", "words"))
def j_as_of_lines(spark, sf):
    w = D.words(spark, sf)
    lines = w.groupBy("page", (F.col("block") * 5 + F.col("line")).alias("seq")).agg(F.min("t").alias("top"))
    axis = w.groupBy("page").agg(F.max("b").alias("m")).select("page", F.explode(F.sequence(F.lit(0).cast("long"), "m", F.lit(7).cast("long"))).alias("y"))
    return S.as_of(axis, lines, ["page"], "y", "top", ["seq"])


@query(oracle("""steps AS (SELECT page, t AS at, 1 AS d FROM words UNION ALL SELECT page, b + 1, -1 FROM words), s AS (SELECT page, at, sum(d) AS d FROM steps GROUP BY ALL)
    SELECT page, at, CAST(sum(d) OVER (PARTITION BY page ORDER BY at) AS BIGINT) AS n FROM s""", "words"))
def j_stabbing_counts(spark, sf):
    return S.stabbing_counts(D.words(spark, sf), ["page"], "t", "b")


@query(oracle("""parts AS (SELECT page, block, t // 15 AS y, l AS x, pos, text FROM words) SELECT page, block, string_agg(text, ' ' ORDER BY y, x, pos) AS text FROM parts GROUP BY ALL""", "words"))
def g_reading_order(spark, sf):
    return L.reading_order(D.words(spark, sf), ["page", "block"])


@query(oracle("""a AS (SELECT page, l // 30 AS angle, count(*) AS n FROM words GROUP BY ALL) SELECT page, angle, n FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, angle) AS k FROM a) WHERE k = 1""", "words"))
def s_most_frequent_angle(spark, sf):
    return R.most_frequent(D.words(spark, sf).withColumn("angle", F.expr("l div 30")), ["page"], "angle")


@query("""SELECT doc_id, CAST(doc_id % 3 AS BIGINT) AS cat, ((0.25 + doc_id % 7 / CAST(20 AS DOUBLE)) - (doc_id % 5 / CAST(10 AS DOUBLE)) / 2) * w AS x0, (0.5 - 0.25 / 2) * h AS y0, ((0.25 + doc_id % 7 / CAST(20 AS DOUBLE)) + (doc_id % 5 / CAST(10 AS DOUBLE)) / 2) * w AS x1, (0.5 + 0.25 / 2) * h AS y1, CAST(NULL AS DOUBLE) AS conf
    FROM (SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 2) THEN CAST(612 AS DOUBLE) ELSE CAST(792 AS DOUBLE) END AS w, CASE WHEN doc_id % 4 IN (0, 2) THEN CAST(792 AS DOUBLE) ELSE CAST(612 AS DOUBLE) END AS h FROM documents)""")
def s_detected_boxes(spark, sf):
    """Boxes from a detector's text lines, on pages of four rotations."""
    line = F.concat_ws(" ", F.expr("doc_id % 3").cast("string"), F.expr("0.25D + (doc_id % 7) / 20.0D").cast("string"), F.lit("0.5"), F.expr("(doc_id % 5) / 10.0D").cast("string"), F.lit("0.25"))
    rows = D.table(spark, sf, "documents").select("doc_id", line.alias("line"))
    out = R.detected_boxes(rows, "line", F.lit(612.0), F.lit(792.0), F.expr("(doc_id % 4) * 90"))
    return out


@query("SELECT doc_id, CAST(round_even((0.5 - 0.25 / CAST(2 AS DOUBLE)) * w, 0) AS BIGINT) AS x0, CAST(round_even((0.5 - s / 2) * w, 0) AS BIGINT) AS y0, CAST(round_even((0.5 + 0.25 / CAST(2 AS DOUBLE)) * w, 0) AS BIGINT) AS x1, CAST(round_even((0.5 + s / 2) * w, 0) AS BIGINT) AS y1 FROM (SELECT doc_id, CAST(600 + doc_id % 97 AS DOUBLE) AS w, doc_id % 5 / CAST(8 AS DOUBLE) AS s FROM documents)")
def s_whole_boxes(spark, sf):
    """Boxes in whole pixels from a detector's lines of six numbers."""
    rows = D.table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", F.lit("0 0.5 0.5 0.25"), F.expr("(doc_id % 5) / 8.0D").cast("string"), F.lit("0.9")).alias("line"))
    side = F.expr("CAST(600 + doc_id % 97 AS DOUBLE)")
    return R.whole_boxes(rows, "line", side, side)


@query("""WITH b AS (SELECT sample, axis, block, CAST(('0x' || substring(md5('7:' || sample || axis || block), 1, 12)) AS BIGINT) AS lot FROM range(20) s(sample), (VALUES ('row'), ('col')) a(axis), range(10) n(block)),
    k AS (SELECT *, CASE WHEN axis = 'row' THEN ['none', 'solid', 'dashed', 'fake'][lot % 4 + 1] ELSE ['none', 'solid', 'dashed'][lot % 3 + 1] END AS kind, unnest(range(CASE WHEN axis = 'row' THEN 60 ELSE 80 END)) AS o FROM b),
    i AS (SELECT *, CASE WHEN axis = 'row' THEN o BETWEEN 26 AND 32 ELSE o BETWEEN 66 AND 71 END AS inside FROM k)
    SELECT sample, axis, block * CASE WHEN axis = 'row' THEN 60 ELSE 80 END + o AS at_line, CASE WHEN inside AND kind IN ('solid', 'fake') THEN 'solid' WHEN inside AND kind = 'dashed' THEN 'dashed' ELSE 'none' END AS pattern, CAST(inside AND kind IN ('solid', 'dashed') AS BIGINT) AS target FROM i""")
def s_synthetic_lines(spark, sf):
    """Lines of twenty made-up table images."""
    return Y.lines(Y.blocks(spark, 20, 7)).withColumnRenamed("at", "at_line")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'a-p' || source ELSE source END AS pdf, list_sort(list(DISTINCT doc_id % 50)) AS pages, count(CASE WHEN doc_id % 3 = 0 THEN 1 END) AS n_tables FROM documents GROUP BY ALL")
def s_names_as_relation(spark, sf):
    name = F.expr("concat(CASE WHEN doc_id % 2 = 0 THEN concat('a-p', source) ELSE source END, '-p', doc_id % 50, CASE WHEN doc_id % 3 = 0 THEN concat('_t', doc_id % 9) ELSE '' END)")
    return R.pages_of(D.table(spark, sf, "documents").select(name.alias("name")), "name")


@query("SELECT c.c_custkey, coalesce(o.angle, CAST(0 AS DOUBLE)) AS angle FROM customer c LEFT JOIN (SELECT o_custkey, CAST(max(o_orderkey % 90) AS DOUBLE) AS angle FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey")
def s_angle_or_zero(spark, sf):
    angles = D.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderkey") % 90).cast("double").alias("angle"))
    return R.with_angle(D.table(spark, sf, "customer").select("c_custkey"), angles, ["c_custkey"])


@query("""SELECT 'kept' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'unlabelled', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
    UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL SELECT 'copied', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)""")
def j_membership(spark, sf):
    """Intersection, difference and union of id sets, and copying by membership."""
    a, b = D.table(spark, sf, "documents").select("doc_id"), D.table(spark, sf, "labels")
    ids = b.select("doc_id")
    parts = {"kept": a.intersect(ids), "unlabelled": a.subtract(ids), "either": a.union(ids).distinct(), "copied": a.join(b.where("toxic = 0"), "doc_id", "left_semi")}
    out = None
    for kind, rows in parts.items():
        n = rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.source, l.quality, p.n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) p ON d.source = p.source""")
def j_outer_and_left(spark, sf):
    d, l = D.table(spark, sf, "documents").select("doc_id", "source"), D.table(spark, sf, "labels").select("doc_id", "quality")  # noqa: E741
    n = d.groupBy("source").agg(F.count("*").alias("n"))
    return d.join(l, "doc_id", "full_outer").join(n, "source", "left").select("doc_id", "source", "quality", "n")
