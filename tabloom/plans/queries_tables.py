"""Queries on separators, cells and finished tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import sequences as S
from tabloom.functions import text as X
from tabloom.operators import boxes as B
from tabloom.operators import cells as C
from tabloom.operators import images as V
from tabloom.operators import ink as I
from tabloom.operators import lines as L
from tabloom.operators import scoring as G
from tabloom.operators import separators as P
from tabloom.plans import fixtures as D
from tabloom.plans.fixtures import oracle
from tabloom.plans.registry import query
from tabloom.sources import readers as R
from tabloom.sources import sinks as K

SEPS = """h AS (SELECT img, axis, at, p > 0.8 AS hit FROM axis_scores), c AS (SELECT *, CASE WHEN lag(hit) OVER (PARTITION BY img, axis ORDER BY at) IS DISTINCT FROM hit THEN 1 ELSE 0 END AS ch FROM h),
    u AS (SELECT *, sum(ch) OVER (PARTITION BY img, axis ORDER BY at) AS run FROM c), seps AS (SELECT img, axis, min(at) - 1 AS s, max(at) AS e FROM u WHERE hit GROUP BY img, axis, run),
    framed AS (SELECT img, axis, s, e FROM seps UNION ALL SELECT DISTINCT img, axis, 39, 40 FROM axis_scores UNION ALL SELECT DISTINCT img, axis, size - 40, size - 39 FROM axis_scores),
    spans AS (SELECT img, axis, n, low, high FROM (SELECT img, axis, row_number() OVER w - 1 AS n, e + 1 AS low, lead(s) OVER w AS high FROM framed WINDOW w AS (PARTITION BY img, axis ORDER BY s, e)) WHERE high IS NOT NULL)"""
CELLS = SEPS + """, cells AS (SELECT r.img, r.n AS "row", c.n AS col, c.low AS x0, r.low AS y0, c.high AS x1, r.high AS y1 FROM spans r JOIN spans c ON r.img = c.img AND r.axis = 'row' AND c.axis = 'col'),
    found AS (SELECT k.img, k."row", k.col, string_agg(w.text, ' ' ORDER BY w.pos, w.text) AS text FROM cells k JOIN table_words w ON k.img = w.img AND w.l < k.x1 AND w.r >= k.x0 AND w.t < k.y1 AND w.b >= k.y0 GROUP BY ALL),
    grid AS (SELECT cells.*, found.text FROM cells LEFT JOIN found USING (img, "row", col))"""
PACKED = CELLS + """, g1 AS (SELECT * FROM grid QUALIFY count(text) OVER (PARTITION BY img, col) > 0), g2 AS (SELECT * FROM g1 QUALIFY count(text) OVER (PARTITION BY img, "row") > 0),
    packed AS (SELECT img, dense_rank() OVER (PARTITION BY img ORDER BY "row") - 1 AS "row", col, text FROM g2)"""
CLEAN = PACKED + """, kinds AS (SELECT img, col, CASE WHEN list_sort(list(DISTINCT text) FILTER (text IS NOT NULL)) = ['('] THEN 'open' WHEN list_sort(list(DISTINCT text) FILTER (text IS NOT NULL)) = [')'] THEN 'close' ELSE 'text' END AS kind FROM packed GROUP BY img, col),
    near AS (SELECT *, lag(kind) OVER (PARTITION BY img ORDER BY col) AS bk, lead(kind) OVER (PARTITION BY img ORDER BY col) AS ak FROM kinds),
    side AS (SELECT p.*, kind, bk, ak, lag(text) OVER (PARTITION BY p.img, "row" ORDER BY p.col) AS bt, lead(text) OVER (PARTITION BY p.img, "row" ORDER BY p.col) AS at_ FROM packed p JOIN near USING (img, col)),
    merged AS (SELECT img, "row", col, nullif(CASE WHEN bk = 'open' THEN coalesce(bt, '') ELSE '' END || coalesce(text, '') || CASE WHEN ak = 'close' THEN coalesce(at_, '') ELSE '' END, '') AS text FROM side WHERE kind = 'text'),
    ruled AS (SELECT * FROM (SELECT *, max(col) OVER (PARTITION BY img) AS mc, min(CASE WHEN text IS NULL OR text IN ('1', '|') THEN 1 ELSE 0 END) OVER (PARTITION BY img, col) AS rl FROM merged) WHERE col < mc OR rl = 0),
    longest AS (SELECT img, col AS lc FROM (SELECT img, col, row_number() OVER (PARTITION BY img ORDER BY length(text) DESC, col, "row") AS k FROM ruled WHERE "row" >= 1 AND text IS NOT NULL) WHERE k = 1),
    lab AS (SELECT r.img, "row", col, CASE WHEN lc = 0 AND "row" = 0 AND col = 0 THEN 'Labels' ELSE text END AS text FROM ruled r LEFT JOIN longest USING (img)),
    hd AS (SELECT img, col, min_by(text, "row") FILTER ("row" < 5 AND text IS NOT NULL) AS h FROM lab GROUP BY ALL),
    hh AS (SELECT img, col, CASE WHEN h IS NULL THEN 'empty' WHEN regexp_matches(replace(h, ',', ''), '^\\p{N}+$') THEN 'numeric' ELSE h END AS h FROM hd),
    heads AS (SELECT img, col, CASE WHEN k > 1 THEN h || '_' || k ELSE h END AS header FROM (SELECT *, row_number() OVER (PARTITION BY img, h ORDER BY col) AS k FROM hh)),
    body AS (SELECT img, "row" - 1 AS "row", col, text, header FROM lab JOIN heads USING (img, col) WHERE "row" > 0)"""
AXIS = ["img", "axis"]


def axis_separators(spark, sf):
    return S.scores_to_intervals(D.axis_scores(spark, sf), AXIS, "at", "p", "size")


def axis_sizes(spark, sf):
    return D.axis_scores(spark, sf).select(*AXIS, "size").distinct()


def grid(spark, sf):
    framed = P.framed(axis_separators(spark, sf), axis_sizes(spark, sf), AXIS, "size")
    one = lambda a: framed.where(F.col("axis") == a).drop("axis")
    return C.with_text(C.grid(one("row"), one("col"), ["img"]), D.table_words(spark, sf), ["img"])


@query(oracle(f"{SEPS} SELECT img, axis, s AS start, e AS \"end\", (s + e) // 2 + 1 AS mid FROM framed", "axis_scores"))
def t_framed_separators(spark, sf):
    return P.framed(axis_separators(spark, sf), axis_sizes(spark, sf), AXIS, "size")


@query(oracle(f"{CELLS} SELECT * FROM grid", "axis_scores", "table_words"))
def c_cells_with_text(spark, sf):
    return grid(spark, sf)


@query(oracle(f"{PACKED} SELECT * FROM packed", "axis_scores", "table_words"))
def c_without_empty(spark, sf):
    return C.without_empty(grid(spark, sf), ["img"]).select("img", "row", "col", "text")


@query(oracle(f"{CLEAN} SELECT img, \"row\", col, text, header FROM body QUALIFY count(CASE WHEN NOT (header = 'Labels' OR starts_with(header, 'Codes')) THEN text END) OVER (PARTITION BY img, \"row\") > 0", "axis_scores", "table_words"))
def c_clean_table(spark, sf):
    """The flagship: scored lines to separators, frame, cells, words, and the cleaned table."""
    return C.cleaned(grid(spark, sf).select("img", "row", "col", "text"), ["img"]).select("img", "row", "col", "text", "header")


@query(oracle(f"{PACKED} SELECT \"row\", max(CASE WHEN col = 0 THEN text END) AS \"0\", max(CASE WHEN col = 1 THEN text END) AS \"1\", max(CASE WHEN col = 2 THEN text END) AS \"2\" FROM packed WHERE img = 0 AND col <= 2 GROUP BY \"row\"", "axis_scores", "table_words"))
def c_wide_table(spark, sf):
    """One table in its wide form: the columns of its first three spans."""
    long = C.without_empty(grid(spark, sf), ["img"]).where("img = 0 AND col <= 2")
    return C.wide(long.select("row", "col", "text"), [0, 1, 2])


EDGES = "b AS (SELECT img, t AS s, b AS e, lead(t) OVER (PARTITION BY img ORDER BY t, b) AS n FROM boxes)"


@query(oracle(f"{EDGES} SELECT img, CAST(floor(least(e, n)) AS BIGINT) AS start, CAST(floor(greatest(e, n)) AS BIGINT) AS \"end\" FROM b WHERE n IS NOT NULL", "boxes"))
def t_edges_to_separators(spark, sf):
    rows = D.boxes(spark, sf).selectExpr("img", "t AS start", "b AS end")
    return P.from_edges(rows, ["img"])


@query(oracle("g AS (SELECT DISTINCT img, unnest(range(50)) AS at FROM boxes) SELECT g.img, g.at, CAST(max(CASE WHEN b.word IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS \"on\" FROM g LEFT JOIN boxes b ON g.img = b.img AND g.at BETWEEN b.t AND b.b GROUP BY ALL", "boxes"))
def t_intervals_to_vector(spark, sf):
    seps = D.boxes(spark, sf).selectExpr("img", "t AS start", "b AS end")
    return P.to_vector(seps, D.sizes(spark, sf), ["img"], "h")


@query(oracle(f"{SEPS} SELECT s.img, s.axis, s.s AS start, s.e AS \"end\", min(a.p) AS p_min, max(a.p) AS p_max FROM seps s LEFT JOIN axis_scores a ON s.img = a.img AND s.axis = a.axis AND a.at BETWEEN s.s AND s.e GROUP BY ALL", "axis_scores"))
def t_segment_features(spark, sf):
    return P.segment_features(axis_separators(spark, sf), D.axis_scores(spark, sf), AXIS, ["p"])


@query(oracle(f"""{SEPS}, m AS (SELECT DISTINCT img, s, e, (s + e) // 2 + 1 AS mid FROM framed WHERE axis = 'row'), n AS (SELECT m.*, coalesce((SELECT min(o.mid) FROM m o WHERE o.img = m.img AND o.mid > m.mid), edge) AS nx FROM m LEFT JOIN (SELECT img, max(b) AS edge FROM table_words GROUP BY img) USING (img))
    SELECT n.img, n.s AS start, n.e AS "end", n.mid, count(w.pos) AS n_words, CAST(count(w.pos) > 0 AS BIGINT) AS has_text FROM n LEFT JOIN table_words w ON n.img = w.img AND w.t > n.mid AND w.b <= n.nx GROUP BY ALL""", "axis_scores", "table_words"))
def t_words_between(spark, sf):
    framed = P.framed(axis_separators(spark, sf), axis_sizes(spark, sf), AXIS, "size").where("axis = 'row'").drop("axis").distinct()
    return P.words_between(framed, D.table_words(spark, sf), ["img"], "t", "b").select("img", "start", "end", "mid", "n_words", "has_text")


@query(oracle(f"""{SEPS}, tr AS (SELECT *, target - lag(target) OVER (PARTITION BY img, axis ORDER BY at) AS d FROM axis_scores),
    x AS (SELECT s.img, s.axis, s.s, s.e, max(t.target) AS a, min(CASE WHEN d = -1 AND at > s.s THEN at END) AS f, max(CASE WHEN d = 1 AND at > s.s THEN at END) AS r FROM seps s LEFT JOIN tr t ON s.img = t.img AND s.axis = t.axis AND t.at >= s.s AND t.at < s.e GROUP BY ALL)
    SELECT img, axis, s AS start, e AS "end", CAST(coalesce(a, 0) = 1 AND NOT coalesce(f < r, false) AS BIGINT) AS target FROM x""", "axis_scores"))
def t_separator_targets(spark, sf):
    truth = D.axis_scores(spark, sf).select(*AXIS, "at", F.col("target").alias("on"))
    return P.targets(axis_separators(spark, sf), truth, AXIS)


@query(oracle("SELECT img, round(2 * avg(m), 9) AS confidence FROM (SELECT img, axis, quantile_cont(abs(p - 0.5), 0.5) AS m FROM axis_scores GROUP BY ALL) GROUP BY img", "axis_scores"))
def t_confidence(spark, sf):
    return P.confidence(D.axis_scores(spark, sf), ["img"]).select("img", F.round("confidence", 9).alias("confidence"))


@query(oracle("SELECT img, axis, at, p FROM axis_scores WHERE p >= 0.5", "axis_scores"))
def t_kept(spark, sf):
    return P.kept(D.axis_scores(spark, sf)).select(*AXIS, "at", "p")


@query(oracle("""i AS (SELECT img, axis, min(at) AS i0, max(at) AS i1 FROM axis_scores WHERE p > 0.1 GROUP BY ALL), x AS (SELECT img, axis, min(at) AS t0, max(at) AS t1 FROM axis_scores WHERE p > 0.9 GROUP BY ALL), j AS (SELECT * FROM i JOIN x USING (img, axis))
    SELECT img, axis, 'low' AS side, i0 AS start, t0 - 1 AS "end" FROM j WHERE t0 - i0 > 2 UNION ALL SELECT img, axis, 'high', t1 + 1, i1 FROM j WHERE i1 - t1 > 2""", "axis_scores"))
def t_edge_separators(spark, sf):
    a = D.axis_scores(spark, sf)
    return P.edge_separators(a.where("p > 0.1"), a.where("p > 0.9"), AXIS)


MEASURES = "x AS (SELECT *, CAST((at * 13 + img) % 7 AS DOUBLE) AS w FROM axis_scores)"


@query(oracle(f"""{SEPS}, {MEASURES}, ends AS (SELECT img, axis, min(at) AS a0, max(at) AS a1 FROM x GROUP BY ALL), n AS (SELECT s.*, x.at AS g, x.p, x.w FROM seps s JOIN x ON s.img = x.img AND s.axis = x.axis AND x.at BETWEEN s.s - 5 AND s.e + 5 AND NOT x.at BETWEEN s.s AND s.e),
    d AS (SELECT n.img, n.axis, n.s, n.e, n.g, min(abs(n.p - o.p)) AS dp, min(abs(n.w - o.w)) AS dw FROM n LEFT JOIN x o ON n.img = o.img AND n.axis = o.axis AND o.at BETWEEN n.s AND n.e GROUP BY ALL),
    z AS (SELECT img, axis, s, e, max(CASE WHEN g < s AND (dp > 0.2 OR dw > 2) THEN g END) AS lo, min(CASE WHEN g > e AND (dp > 0.2 OR dw > 2) THEN g END) AS hi FROM d GROUP BY ALL)
    SELECT t.img, t.axis, t.s AS start, t.e AS "end", greatest(least(coalesce(lo + 1, t.s - 5), t.s), least(a0, t.s)) AS wide_start, least(greatest(coalesce(hi - 1, t.e + 5), t.e), greatest(a1, t.e)) AS wide_end FROM seps t JOIN ends USING (img, axis) LEFT JOIN z ON z.img = t.img AND z.axis = t.axis AND z.s = t.s AND z.e = t.e""", "axis_scores"))
def t_widened_separators(spark, sf):
    lines = D.axis_scores(spark, sf).withColumn("w", F.expr("CAST((at * 13 + img) % 7 AS DOUBLE)"))
    return P.widened(axis_separators(spark, sf), lines, AXIS, {"p": 0.2, "w": 2.0}, 5)


SNAP = "b AS (SELECT img, word * 5 AS bs, word * 5 + 2 AS be FROM boxes), a AS (SELECT img, word, l * 3 AS s, l * 3 + word % 4 AS e FROM boxes)"


@query(oracle(f"""{SNAP}, f AS (SELECT a.img, a.word, a.s, a.e, min(b.be) AS be FROM a LEFT JOIN b ON a.img = b.img AND b.be >= a.s GROUP BY ALL)
    SELECT f.img, f.word, s AS start, e AS "end", CASE WHEN e >= be - 2 THEN be - 2 ELSE s END AS new_start, CASE WHEN e >= be - 2 THEN be ELSE e END AS new_end FROM f""", "boxes"))
def j_interval_snap(spark, sf):
    b = D.boxes(spark, sf)
    better = b.selectExpr("img", "word * 5 AS start", "word * 5 + 2 AS end")
    return B.snapped(b.selectExpr("img", "word", "l * 3 AS start", "l * 3 + word % 4 AS end"), better, ["img"])


@query(oracle("""n AS (SELECT a.img, a.word, a.l, b.r AS s, row_number() OVER (PARTITION BY a.img, a.word ORDER BY abs(b.r - a.l), b.r) AS k FROM boxes a JOIN (SELECT DISTINCT img, r FROM boxes) b ON a.img = b.img)
    SELECT img, word, l, s AS nearest, l - s AS delta, CASE WHEN abs(l - s) <= 6 THEN s ELSE l END AS snapped FROM n WHERE k = 1""", "boxes"))
def j_nearest_separator(spark, sf):
    b = D.boxes(spark, sf)
    seps = b.selectExpr("img", "r AS at").distinct()
    return B.spanning_edges(b.select("img", "word", "l"), seps, ["img"], "l", "at", 6)


@query(oracle("""s AS (SELECT DISTINCT img, t AS s, t + 1 AS e FROM boxes), c AS (SELECT img, word, t AS low, b AS high FROM boxes), i AS (SELECT c.*, coalesce((SELECT e FROM s WHERE s.img = c.img AND s.s <= c.low AND s.e >= c.low ORDER BY s, e LIMIT 1) + 1, low) AS inner_low, coalesce((SELECT s FROM s WHERE s.img = c.img AND s.s <= c.high AND s.e >= c.high ORDER BY s, e LIMIT 1) - 1, high) AS inner_high FROM c)
    SELECT *, inner_high <= inner_low AS bad FROM i""", "boxes"))
def j_cell_interior(spark, sf):
    b = D.boxes(spark, sf)
    seps = b.selectExpr("img", "t AS start", "t + 1 AS end")
    return B.interior(b.selectExpr("img", "word", "t AS low", "b AS high"), seps, ["img"], "low", "high")


@query(oracle("SELECT img, count(*) AS n, count(DISTINCT (l // 20, t // 20)) AS n_distinct FROM boxes GROUP BY img HAVING count(*) <> count(DISTINCT (l // 20, t // 20))", "boxes"))
def t_faulty_annotations(spark, sf):
    b = D.boxes(spark, sf).selectExpr("img", "l div 20 AS x", "t div 20 AS y")
    return P.faulty(b, ["img"], ["x", "y"])


@query(oracle(f"""{SEPS}, r AS (SELECT * FROM spans WHERE axis = 'row'), k AS (SELECT * FROM spans WHERE axis = 'col'), f AS (SELECT * FROM (SELECT img, min(low) AS y0, max(high) AS y1 FROM r GROUP BY img) JOIN (SELECT img, min(low) AS x0, max(high) AS x1 FROM k GROUP BY img) USING (img))
    SELECT img, 'table row' AS name, n, x0 AS xmin, low AS ymin, x1 AS xmax, high AS ymax FROM r JOIN f USING (img) UNION ALL SELECT img, 'table column', n, low, y0, high, y1 FROM k JOIN f USING (img) UNION ALL SELECT img, 'table', 0, x0, y0, x1, y1 FROM f""", "axis_scores"))
def k_annotation_round_trip(spark, sf):
    """Rows, columns and table as annotation XML, read back."""
    framed = P.framed(axis_separators(spark, sf), axis_sizes(spark, sf), AXIS, "size")
    one = lambda a: framed.where(F.col("axis") == a).drop("axis")
    xml = K.as_annotation(K.span_boxes(one("row"), one("col"), ["img"]), ["img"], ["name", "n"])
    out = None
    for name in ("table row", "table column", "table"):
        part = R.annotation_boxes(xml, "xml", ["img"], name).withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("img", "name", "n", *[F.col(c).cast("long").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query(oracle("SELECT img, word, CAST(CASE WHEN start_like = 1 THEN 0 ELSE 1 END AS BIGINT) AS cat, round((l + r) / CAST(2 AS DOUBLE) / 64, 9) AS xc, round((t + b) / CAST(2 AS DOUBLE) / 50, 9) AS yc, round((r - l) / CAST(64 AS DOUBLE), 9) AS w, round((b - t) / CAST(50 AS DOUBLE), 9) AS h FROM boxes", "boxes"))
def k_detector_lines(spark, sf):
    b = D.boxes(spark, sf).selectExpr("img", "word", "CASE WHEN start_like = 1 THEN 'table row' ELSE 'table column' END AS name", "l AS xmin", "t AS ymin", "r AS xmax", "b AS ymax")
    out = K.as_detector_lines(b, {"table row": 0, "table column": 1}, F.lit(64), F.lit(50))
    return out.select("img", "word", "cat", *[F.round(c, 9).alias(c) for c in ("xc", "yc", "w", "h")])


@query(oracle("SELECT img, axis, at, p FROM axis_scores", "axis_scores"))
def k_features_json_round_trip(spark, sf):
    """Vectors of each axis as JSON, read back into rows."""
    docs = K.as_json(D.axis_scores(spark, sf), AXIS, ["at", "p"])
    parsed = docs.select(*AXIS, F.from_json("json", "at array<long>, p array<double>").alias("_j")).select(*AXIS, "_j.*")
    return parsed.select(*AXIS, F.explode(F.arrays_zip("at", "p")).alias("_z")).select(*AXIS, F.col("_z.at").alias("at"), F.col("_z.p").alias("p"))


@query(oracle(f"{SEPS} SELECT img, axis, row_number() OVER (PARTITION BY img, axis ORDER BY s, e) - 1 AS n, s AS start, e AS \"end\" FROM seps", "axis_scores"))
def s_proposals_json(spark, sf):
    """Proposals as their JSON document, read back by axis."""
    s = axis_separators(spark, sf)
    pair = F.array_sort(F.collect_list(F.array("start", "end")))
    both = s.groupBy("img").pivot("axis", ["row", "col"]).agg(pair)
    js = both.select("img", F.to_json(F.struct(F.col("row").alias("row_separator_predictions"), F.col("col").alias("col_separator_predictions"))).alias("json"))
    return R.proposals(js, "json", ["img"])


@query(oracle("""m AS (SELECT *, avg(v) OVER (PARTITION BY img, y) AS mean FROM pixels), b AS (SELECT img, y, x, CAST(v > mean AS INT) AS bit FROM m)
    SELECT a.img, a.y, round(1 - sum(CASE WHEN a.bit <> c.bit THEN 1 ELSE 0 END) / CAST(64 AS DOUBLE), 9) AS similarity FROM b a JOIN b c ON a.img = c.img AND c.y = a.y + 1 AND c.x = a.x GROUP BY ALL""", "pixels"))
def p_similarity_gate(spark, sf):
    """Similarity of neighbouring image lines by their average hashes."""
    px = D.pixels(spark, sf).groupBy("img", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda s: s["v"].cast("double")).alias("a"))
    bits = px.select("img", "y", X.average_hash_bits(F.col("a")).alias("bits"))
    nxt = bits.select("img", (F.col("y") - 1).alias("y"), F.col("bits").alias("other"))
    return bits.join(nxt, ["img", "y"]).select("img", "y", F.round(X.hash_similarity(F.col("bits"), F.col("other"), F.lit(0)), 9).alias("similarity"))


@query(oracle("""m AS (SELECT img, y, avg(v) AS mean FROM pixels GROUP BY ALL), b AS (SELECT p.img, p.y, list(CASE WHEN v > mean THEN 1 ELSE 0 END ORDER BY x) AS bits FROM pixels p JOIN m USING (img, y) GROUP BY ALL),
    s AS (SELECT w.img, w.y, (c.y + 1) % 50 AS c, CASE WHEN abs(w.y % 4 - c.y % 4) * 15 > 20 THEN 0 ELSE 1 - list_sum(list_transform(list_zip(w.bits, c.bits), lambda z: CAST(z[1] <> z[2] AS BIGINT))) / CAST(64 AS DOUBLE) END AS s FROM b w JOIN b c ON w.img = c.img),
    g AS (SELECT img, y, max(CASE WHEN c = y THEN s END) AS own, max(s) AS similarity, min_by(c, (-s, c)) AS best FROM s GROUP BY ALL)
    SELECT img, y, CASE WHEN own >= 0.85 THEN y WHEN similarity >= 0.85 THEN best END AS found, round(similarity, 9) AS similarity, round(own, 9) AS own FROM g""", "pixels"))
def p_image_matches(spark, sf):
    """Image lines against those of their image, numbered one further: which one each shows."""
    px = D.pixels(spark, sf).groupBy("img", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda s: s["v"].cast("double")).alias("a"))
    hashed = px.select("img", "y", X.average_hash_bits(F.col("a")).alias("bits"), F.lit(64).alias("w"), F.expr("y % 4 * 15").alias("h"))
    out = V.matched(hashed, hashed.withColumn("y", F.expr("(y + 1) % 50")), ["img"], "y")
    return out.select("img", "y", "found", F.round("similarity", 9).alias("similarity"), F.round("own", 9).alias("own"))


@query(oracle("""r AS (SELECT img, word, b AS e, lead(t) OVER (PARTITION BY img ORDER BY t, b) AS n FROM boxes), k AS (SELECT img, word, r AS e, lead(l) OVER (PARTITION BY img ORDER BY l, r) AS n FROM boxes)
    SELECT img, 'row separator' AS name, 0 AS xmin, least(e, n) AS ymin, 64 AS xmax, greatest(e, n) AS ymax, 64 AS width, 50 AS height FROM r WHERE n IS NOT NULL
    UNION ALL SELECT img, 'column separator', least(e, n) - 1, 0, greatest(e, n) + 1, 50, 64, 50 FROM k WHERE n IS NOT NULL UNION ALL SELECT img, 'spanning cell interior', l + 1, t + 1, r - 1, b - 1, 64, 50 FROM boxes""", "boxes"))
def k_separator_annotations(spark, sf):
    """Separators and interiors as annotation XML with the image's size, read back."""
    b, zero = D.boxes(spark, sf), F.lit(0).cast("long")
    rows = P.from_edges(b.selectExpr("img", "t AS start", "b AS end"), ["img"]).select("img", F.lit("row separator").alias("name"), zero.alias("xmin"), F.col("start").alias("ymin"), (zero + 64).alias("xmax"), F.col("end").alias("ymax"))
    cols = P.from_edges(b.selectExpr("img", "l AS start", "r AS end"), ["img"], widen=True).select("img", F.lit("column separator").alias("name"), F.col("start").alias("xmin"), zero.alias("ymin"), F.col("end").alias("xmax"), (zero + 50).alias("ymax"))
    inner = b.selectExpr("img", "'spanning cell interior' AS name", "l + 1 AS xmin", "t + 1 AS ymin", "r - 1 AS xmax", "b - 1 AS ymax")
    boxes = rows.unionByName(cols).unionByName(inner).withColumn("width", F.lit(64)).withColumn("height", F.lit(50))
    xml = K.as_annotation(boxes, ["img"], ["name", "ymin", "xmin", "ymax", "xmax"])
    size = lambda n: F.expr(f"xpath_long(xml, '/annotation/size/{n}')").alias(n)
    sizes, out = xml.select("img", size("width"), size("height")), None
    for name in ("row separator", "column separator", "spanning cell interior"):
        part = R.annotation_boxes(xml, "xml", ["img"], name).withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("img", "name", *[F.col(c).cast("long").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]).join(sizes, "img")


@query()
def g_tight_boxes(spark, sf):
    ink = D.pixels(spark, sf).where("v = 1").select("img", "y", "x")
    return I.tightened(D.boxes(spark, sf).selectExpr("img", "word AS pos", "l", "t", "r", "b"), ink, "img")


FEATURES = ["avg", "abs_diff", "spell_mean", "spell_sd", "n", "relative", "in_text"]


def model_lines(spark, sf):
    """Images by axis, and the seven features that the lines of both axes share."""
    px, boxes, sizes = D.pixels(spark, sf), D.boxes(spark, sf), D.sizes(spark, sf)
    px = px.selectExpr("img", "'row' AS axis", "y AS line", "x AS at", "v").unionByName(px.selectExpr("img", "'col' AS axis", "x AS line", "y AS at", "v"))
    of_words = None
    for axis, low, high, size in (("row", "t", "b", "h"), ("col", "l", "r", "w")):
        one = L.in_text_rectangle(L.crossed(boxes, sizes, ["img"], low, high, size), boxes, ["img"], "at", low, high).withColumn("axis", F.lit(axis))
        of_words = one if of_words is None else of_words.unionByName(one)
    lines = L.line_statistics(px, AXIS).withColumnRenamed("line", "at").join(of_words, [*AXIS, "at"])
    return G.images(px, AXIS), lines.select(*AXIS, "at", *FEATURES)


@query()
def m_line_scores(spark, sf):
    """Scores of all lines under fixed made-up weights (none are published); the three features that
    each axis has of its own are made up too."""
    images, lines = model_lines(spark, sf)
    own = [F.expr(f"CAST((at * {k} + img) % 3 = 0 AS DOUBLE)").alias(f"own_{k}") for k in (5, 7, 11)]
    globals_ = L.percentiles(lines, AXIS, "avg")
    tables = G.assembled(lines.select("*", *own), globals_, AXIS, [*FEATURES, "own_5", "own_7", "own_11"], ["p0", "p5", "p10"])
    return G.scored(tables.join(images, AXIS), AXIS, G.made_up_weights())


@query(oracle(f"{CLEAN} SELECT img, \"row\", col, text FROM merged", "axis_scores", "table_words"))
def c_parentheses_merged(spark, sf):
    packed = C.without_empty(grid(spark, sf).select("img", "row", "col", "text"), ["img"])
    return C.parentheses_merged(packed, ["img"]).select("img", "row", "col", "text")


@query(oracle(f"{CLEAN} SELECT img, col, header FROM heads", "axis_scores", "table_words"))
def c_headers(spark, sf):
    packed = C.without_empty(grid(spark, sf).select("img", "row", "col", "text"), ["img"])
    kept = C.without_ruled_last(C.parentheses_merged(packed, ["img"]), ["img"])
    return C.headers(C.labelled(kept, ["img"]), ["img"]).select("img", "col", "header")


@query(oracle("SELECT img, word, CAST(round_even(l * CAST(2.5 AS DOUBLE), 0) AS BIGINT) AS x0, CAST(round_even(r * CAST(2.5 AS DOUBLE), 0) AS BIGINT) AS x1 FROM boxes", "boxes"))
def p_cell_scaling(spark, sf):
    b = D.boxes(spark, sf)
    return b.select("img", "word", X.half_even(F.col("l"), 2.5).alias("x0"), X.half_even(F.col("r"), 2.5).alias("x1"))


@query()
def m_separator_scores(spark, sf):
    """Scores of proposals (runs of lines with little ink) under fixed made-up weights."""
    images, lines = model_lines(spark, sf)
    found = S.intervals_where(lines, AXIS, "at", F.col("avg") < 0.5).withColumn("start", F.greatest("start", F.lit(0).cast("long"))).withColumn("mid", F.expr("(start + end) div 2 + 1"))
    told = P.segment_features(found, lines, AXIS, FEATURES).join(L.percentiles(lines, AXIS, "avg"), AXIS)
    ends = [f"{f}_{m}" for f in FEATURES for m in ("min", "max")]
    row = F.array(*[F.col(c).cast("double") for c in [*ends, "text_between", "p0", "p5", "p10"]])
    texts = D.boxes(spark, sf)
    counts = None
    for axis, low, high in (("row", "t", "b"), ("col", "l", "r")):
        one = P.words_between(found.where(F.col("axis") == axis).drop("axis"), texts, ["img"], low, high).withColumn("axis", F.lit(axis))
        counts = one if counts is None else counts.unionByName(one)
    told = told.join(counts.select(*AXIS, "start", "end", F.col("n_words").alias("text_between")), [*AXIS, "start", "end"])
    spans = told.groupBy(*AXIS).agg(F.array_sort(F.collect_list(F.struct("start", "end", row.alias("features")))).alias("spans"))
    return G.scored_separators(spans.join(images, AXIS), AXIS, G.made_up_weights(separators=True))
