"""Queries on pixel lines and score sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import sequences as S
from tabloom.operators import lines as L
from tabloom.operators import metrics as M
from tabloom.operators import sampling as N
from tabloom.plans import fixtures as D
from tabloom.plans.fixtures import oracle
from tabloom.plans.registry import query
from tabloom.sources import readers as R

ISLANDS = "c AS (SELECT *, CASE WHEN lag(hit) OVER w IS DISTINCT FROM hit THEN 1 ELSE 0 END AS ch FROM h WINDOW w AS (PARTITION BY k ORDER BY i)), r AS (SELECT *, sum(ch) OVER (PARTITION BY k ORDER BY i) AS run FROM c)"


def r9(c, name):
    return F.round(c, 9).alias(name)


@query(oracle(f"h AS (SELECT k, i, CASE WHEN i >= 2 AND i < n - 2 THEN p ELSE 0 END > 0.8 AS hit FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM scores)), {ISLANDS} SELECT k, min(i) - 1 AS start, max(i) AS \"end\" FROM r WHERE hit GROUP BY k, run", "scores"))
def t_scores_to_intervals(spark, sf):
    s = D.scores(spark, sf).withColumn("n", F.count("*").over(S.W.partitionBy("k")))
    return S.scores_to_intervals(s, ["k"], "i", "p", "n", 0.8, 2)


@query(oracle("SELECT k, CAST(sum(CASE WHEN target = 1 AND before = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_separators FROM (SELECT *, lag(target) OVER (PARTITION BY k ORDER BY i) AS before FROM scores) GROUP BY k", "scores"))
def t_separator_count(spark, sf):
    return S.starts_count(D.scores(spark, sf), ["k"], "i", "target")


@query(oracle("""z AS (SELECT k, i, CAST(p > 0.3 AS BIGINT) AS m FROM scores), f AS (SELECT *, min(CASE WHEN m = 0 THEN i END) OVER (PARTITION BY k) AS z0, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS isl FROM z)
    SELECT k, i, m, CAST(sum(m) OVER (PARTITION BY k, isl ORDER BY i) AS BIGINT) AS total, CAST(CASE WHEN i >= z0 THEN m ELSE 0 END AS BIGINT) AS started FROM f""", "scores"))
def f_reset_cumsum(spark, sf):
    m = D.scores(spark, sf).select("k", "i", (F.col("p") > 0.3).cast("long").alias("m"))
    out = S.zero_start(S.reset_cumsum(m, ["k"], "i", "m", "total"), ["k"], "i", "m", "started")
    return out.withColumn("started", F.col("started").cast("long"))


@query(oracle("SELECT k, i, round(quantile_cont(p, 0.5) OVER w, 9) AS median FROM scores WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) QUALIFY count(*) OVER w = 6", "scores"))
def g_rolling_median(spark, sf):
    return S.rolling_median(D.scores(spark, sf), ["k"], "i", "p", 6).select("k", "i", r9(F.col("median"), "median"))


@query(oracle("SELECT k, i, last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS filled FROM (SELECT k, i, CASE WHEN p < 0.4 THEN target END AS v FROM scores)", "scores"))
def f_forward_fill(spark, sf):
    s = D.scores(spark, sf).select("k", "i", F.when(F.col("p") < 0.4, F.col("target")).alias("v"))
    return S.carried(s, ["k"], "i", "v", "filled").select("k", "i", "filled")


@query(oracle("SELECT a.k, a.i, b.p AS p_roll_2, c.p AS p_roll_m1 FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM scores) a JOIN scores b ON a.k = b.k AND b.i = (a.i - 2 + 2 * a.n) % a.n JOIN scores c ON a.k = c.k AND c.i = (a.i + 1) % a.n", "scores"))
def m_circular_neighbours(spark, sf):
    return S.rolled(D.scores(spark, sf).select("k", "i", "p"), ["k"], "i", "p", [2, -1]).select("k", "i", "p_roll_2", "p_roll_m1")


@query(oracle("SELECT k, i, i / CAST(n AS DOUBLE) AS position, list_slice(list_reverse_sort(tops), 1, 5) AS top5 FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n, list(p) OVER (PARTITION BY k) AS tops FROM scores)", "scores"))
def l_top_values(spark, sf):
    """Relative position of every line, and the five largest of its sequence."""
    s = D.scores(spark, sf)
    tops = s.groupBy("k").agg(F.count("*").alias("n"), N.top_k(F.collect_list("p"), 5).alias("top5"))
    return s.join(tops, "k").select("k", "i", (F.col("i") / F.col("n")).alias("position"), "top5")


@query(oracle("""d AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY img, y ORDER BY x)) AS dv, CASE WHEN lag(v) OVER (PARTITION BY img, y ORDER BY x) <> v THEN 1 ELSE 0 END AS ch FROM pixels),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY img, y ORDER BY x) AS run FROM d), n AS (SELECT img, y, run, count(*) / CAST(64 AS DOUBLE) AS len FROM r GROUP BY ALL)
    SELECT img, y AS line, round(a.m, 9) AS avg, round(a.dm, 9) AS abs_diff, round(b.sm, 9) AS spell_mean, round(b.sd, 9) AS spell_sd FROM (SELECT img, y, avg(v) AS m, avg(dv) AS dm FROM d GROUP BY ALL) a JOIN (SELECT img, y, avg(len) AS sm, stddev_pop(len) AS sd FROM n GROUP BY ALL) b USING (img, y)""", "pixels"))
def f_line_statistics(spark, sf):
    px = D.pixels(spark, sf).select("img", F.col("y").alias("line"), F.col("x").alias("at"), "v")
    return L.line_statistics(px, ["img"]).select("img", "line", *[r9(F.col(c), c) for c in ("avg", "abs_diff", "spell_mean", "spell_sd")])


@query(oracle("SELECT img, axis, round(quantile_cont(m, 0.0), 9) AS p0, round(quantile_cont(m, 0.05), 9) AS p5, round(quantile_cont(m, 0.1), 9) AS p10 FROM (SELECT img, 'row' AS axis, y AS line, avg(v) AS m FROM pixels GROUP BY ALL UNION ALL SELECT img, 'col', x, avg(v) FROM pixels GROUP BY img, x) GROUP BY img, axis", "pixels"))
def f_global_percentiles(spark, sf):
    px = D.pixels(spark, sf)
    both = px.select("img", F.lit("row").alias("axis"), F.col("y").alias("line"), "v").unionByName(px.select("img", F.lit("col").alias("axis"), F.col("x").alias("line"), "v"))
    out = L.percentiles(both.groupBy("img", "axis", "line").agg(F.avg("v").alias("m")), ["img", "axis"], "m")
    return out.select("img", "axis", *[r9(F.col(c), c) for c in ("p0", "p5", "p10")])


@query(oracle("""h AS (SELECT img, v + x % 4 AS g, count(*) AS n FROM pixels GROUP BY ALL), c AS (SELECT *, CAST(sum(n) OVER u AS DOUBLE) AS w0, CAST(sum(g * n) OVER u AS DOUBLE) AS s0, CAST(sum(n) OVER a AS DOUBLE) AS w, CAST(sum(g * n) OVER a AS DOUBLE) AS s FROM h WINDOW u AS (PARTITION BY img ORDER BY g), a AS (PARTITION BY img)),
    v AS (SELECT img, g, w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) AS var FROM c WHERE w0 < w) SELECT img, g AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY var DESC, g) AS k FROM v) WHERE k = 1""", "pixels"))
def s_otsu(spark, sf):
    return R.otsu(D.pixels(spark, sf).withColumn("g", F.expr("v + x % 4")), ["img"], "g")


LINES = "lines AS (SELECT img, word AS seq, t AS top, b AS bottom, start_like AS next_start_like, word % 4 AS caps, word % 3 AS next_caps FROM boxes)"


@query(oracle(f"""{LINES}, ends AS (SELECT img, max(seq) AS last, max(bottom) AS e FROM lines GROUP BY img), axis AS (SELECT DISTINCT img, unnest(range(50)) AS y FROM boxes),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY img, top ORDER BY seq DESC) AS k FROM lines) WHERE k = 1),
    j AS (SELECT a.img, a.y, l.seq, l.bottom, l.next_start_like, l.caps, l.next_caps FROM axis a ASOF LEFT JOIN best l ON a.img = l.img AND a.y >= l.top),
    b AS (SELECT j.*, last, e, CAST(coalesce(y > bottom, false) AND NOT y > e AS BIGINT) AS between_ FROM j JOIN ends USING (img))
    SELECT img, y, CASE WHEN y > e THEN last + 1 ELSE coalesce(seq, 0) END AS text_line, between_ AS "between", CASE WHEN between_ = 1 THEN coalesce(next_start_like, 0) ELSE 0 END AS like_row_start, CASE WHEN between_ = 1 THEN least(greatest(6 - least(caps, next_caps), 0), 5) / CAST(6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS caps_inverted FROM b""", "boxes"))
def f_between_lines(spark, sf):
    b = D.boxes(spark, sf)
    lines = b.selectExpr("img", "word AS seq", "t AS top", "b AS bottom", "start_like AS next_start_like", "word % 4 AS caps", "word % 3 AS next_caps")
    axis = b.select("img").distinct().select("img", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("y"))
    return L.between_lines(axis, lines, ["img"])


RASTER = "g AS (SELECT img, y, unnest(range(64)) AS x FROM (SELECT DISTINCT img, unnest(range(50)) AS y FROM boxes)), raster AS (SELECT g.img, g.y, g.x, CAST(coalesce(max_by(CASE WHEN start_like = 1 THEN 255 ELSE 128 END, word), 0) AS BIGINT) AS v FROM g LEFT JOIN boxes b ON g.img = b.img AND g.x BETWEEN b.l AND b.r AND g.y BETWEEN b.t AND b.b GROUP BY ALL)"


@query(oracle(f"{RASTER}, n AS (SELECT *, first_value(CASE WHEN v > 0 THEN v END IGNORE NULLS) OVER (PARTITION BY img, y ORDER BY x ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM raster) SELECT img, x, round(sum(CASE WHEN nx = 255 THEN 1 ELSE 0 END) / CAST(greatest(count(nx), 1) AS DOUBLE), 9) AS startlike_share FROM n GROUP BY ALL", "boxes"))
def f_nearest_right_share(spark, sf):
    raster = L.painted(D.boxes(spark, sf), D.sizes(spark, sf), ["img"])
    return L.nearest_right_share(raster, ["img"]).select("img", "x", r9(F.col("startlike_share"), "startlike_share"))


@query(oracle("""g AS (SELECT DISTINCT img, unnest(range(50)) AS at FROM boxes), c AS (SELECT g.img, g.at, count(b.word) AS n FROM g LEFT JOIN boxes b ON g.img = b.img AND g.at BETWEEN b.t AND b.b GROUP BY ALL)
    SELECT img, at, n, round(CASE WHEN max(n) OVER (PARTITION BY img) = 0 THEN 0 ELSE n / CAST(max(n) OVER (PARTITION BY img) AS DOUBLE) END, 9) AS relative FROM c""", "boxes"))
def f_words_crossed(spark, sf):
    return L.crossed(D.boxes(spark, sf), D.sizes(spark, sf), ["img"], "t", "b", "h").select("img", "at", "n", r9(F.col("relative"), "relative"))


DISTANCES = f"""{RASTER}, m AS (SELECT *, CAST(v = 0 AS BIGINT) AS free, last_value(CASE WHEN v > 0 THEN x END IGNORE NULLS) OVER (PARTITION BY img, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS lw, first_value(CASE WHEN v > 0 THEN x END IGNORE NULLS) OVER (PARTITION BY img, y ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rw FROM raster),
    dist AS (SELECT img, y, x, CASE WHEN x - lw > 0 THEN (x - lw) / CAST(64 AS DOUBLE) END AS "left", CASE WHEN rw - x > 0 THEN (rw - x) / CAST(64 AS DOUBLE) END AS "right" FROM m)"""


@query(oracle(f"""{DISTANCES} SELECT img, x, round(coalesce(quantile_cont("left", 0.4) / quantile_cont("left", 0.6), 0), 9) AS ratio_left, round(coalesce(quantile_cont("right", 0.4) / quantile_cont("right", 0.6), 0), 9) AS ratio_right FROM dist GROUP BY ALL""", "boxes"))
def f_text_distance_ratio(spark, sf):
    d = L.text_distances(L.painted(D.boxes(spark, sf), D.sizes(spark, sf), ["img"]), ["img"])
    a, b = (L.distance_ratio(d, ["img"], c).select("img", "x", r9(F.col("ratio"), f"ratio_{c}")) for c in ("left", "right"))
    return a.join(b, ["img", "x"])


@query(oracle("g AS (SELECT DISTINCT img, unnest(range(64)) AS x FROM boxes), s AS (SELECT img, min(l) AS a, max(r) AS z FROM boxes GROUP BY img) SELECT g.img, g.x, CAST(coalesce(g.x BETWEEN a AND z, true) AS BIGINT) AS in_text FROM g LEFT JOIN s ON g.img = s.img", "boxes"))
def f_in_text_rectangle(spark, sf):
    b = D.boxes(spark, sf)
    axis = b.select("img").distinct().select("img", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("x"))
    return L.in_text_rectangle(axis, b, ["img"], "x", "l", "r")


# ---------------------------------------------------------------- metrics
BCE = "-avg({} * (1 - target) * ln(1 - q) + {} * target * ln(q))"
CLAMP = "least(greatest(p, 1e-7), 1 - 1e-7)"


@query(oracle(f"SELECT k, round(avg(CAST(target AS DOUBLE)), 9) AS w0, round(1 - avg(CAST(target AS DOUBLE)), 9) AS w1, round({BCE.format(1, 1)}, 6) AS loss FROM (SELECT *, {CLAMP} AS q FROM scores) GROUP BY k", "scores"))
def a_class_weights(spark, sf):
    s = D.scores(spark, sf)
    loss = s.groupBy("k").agg(F.round(M.cross_entropy(F.col("p"), F.col("target")), 6).alias("loss"))
    return M.class_weights(s, ["k"]).select("k", r9(F.col("w0"), "w0"), r9(F.col("w1"), "w1")).join(loss, "k")


@query(oracle(f"SELECT k, round({BCE.format('s', '(1 - s)')}, 6) AS loss, count(*) AS n FROM (SELECT *, {CLAMP} AS q, avg(CAST(target AS DOUBLE)) OVER (PARTITION BY k) AS s FROM scores) GROUP BY k", "scores"))
def a_weighted_loss(spark, sf):
    return M.line_losses(D.scores(spark, sf), ["k"]).select("k", F.round("loss", 6).alias("loss"), "n")


@query(oracle("SELECT round(avg(l), 9) AS loss FROM (SELECT k % 10 AS b, avg(2 * 0.5 / (1 + exp(-abs(predicted - wanted) / 2)) - 0.5) AS l FROM (SELECT k, CAST(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS predicted, CAST(sum(target) AS DOUBLE) AS wanted FROM scores GROUP BY k) GROUP BY b)", "scores"))
def a_count_loss(spark, sf):
    """Logistic loss of predicted against true counts, averaged over batches of sequences."""
    s = D.scores(spark, sf).groupBy("k").agg(F.sum((F.col("p") >= 0.5).cast("double")).alias("predicted"), F.sum("target").cast("double").alias("wanted"))
    out = M.mean_of_means(s.withColumn("b", F.col("k") % 10), "b", M.count_loss(F.col("predicted"), F.col("wanted")))
    return out.select(r9(F.col("loss"), "loss"))


@query(oracle("SELECT k, round(avg(CASE WHEN CAST(p >= 0.5 AS BIGINT) = target THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS accuracy, CAST(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_predicted, CAST(sum(target) AS BIGINT) AS n_target, count(*) AS n FROM scores GROUP BY k", "scores"))
def a_accuracy(spark, sf):
    out = M.accuracy(D.scores(spark, sf), ["k"])
    return out.withColumn("accuracy", F.round("accuracy", 9))


@query(oracle("SELECT k, round(avg(CASE WHEN target = 1 THEN CAST(p > 0.5 AS INT) END), 9) AS true_positive, round(avg(CASE WHEN target = 0 THEN CAST(p <= 0.5 AS INT) END), 9) AS true_negative, round(avg(CAST((p > 0.5) <> (target = 1) AS INT)), 9) AS wrong, count(*) FILTER ((p > 0.5) <> (target = 1)) AS n_wrong FROM scores GROUP BY k", "scores"))
def a_confusion(spark, sf):
    out = M.confusion(D.scores(spark, sf), ["k"])
    return out.select("k", *[r9(F.col(c), c) for c in ("true_positive", "true_negative", "wrong")], "n_wrong")


@query(oracle("SELECT CASE WHEN p > 0.5 AND target = 1 THEN 'correct keep' WHEN p <= 0.5 AND target = 0 THEN 'correct drop' WHEN p <= 0.5 THEN 'wrong drop' ELSE 'wrong keep' END AS verdict, count(*) AS n FROM scores GROUP BY 1", "scores"))
def a_verdicts(spark, sf):
    return D.scores(spark, sf).groupBy(M.verdict(F.col("p"), F.col("target")).alias("verdict")).agg(F.count("*").alias("n"))


SWEEP = "taus AS (SELECT k, k / CAST(99 AS DOUBLE) AS tau FROM (SELECT unnest(range(100)) AS k)), u AS (SELECT p, sum(target) AS ones, count(*) - sum(target) AS zeros FROM scores GROUP BY p), sweep AS (SELECT t.k, t.tau, CAST(sum(CASE WHEN u.p > t.tau THEN zeros ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN u.p <= t.tau THEN ones ELSE 0 END) AS BIGINT) AS fn FROM taus t CROSS JOIN u GROUP BY ALL)"


@query(oracle(f"{SWEEP}, c AS (SELECT *, ln(fp + 4 * fn + 1) AS w, ln(fp + fn + 1) AS n FROM sweep) SELECT k, round(tau, 9) AS tau, fp, fn, round(w / max(w) OVER (), 9) AS weighted, round(n / max(n) OVER (), 9) AS neutral FROM c", "scores"))
def a_threshold_costs(spark, sf):
    out = M.cost_curves(M.threshold_curve(D.scores(spark, sf)))
    return out.select("k", r9(F.col("tau"), "tau"), "fp", "fn", r9(F.col("weighted"), "weighted"), r9(F.col("neutral"), "neutral"))


@query(oracle(f"{SWEEP}, c AS (SELECT *, fp + 4 * fn AS w, fp + fn AS n FROM sweep) SELECT round((SELECT tau FROM c ORDER BY w, tau LIMIT 1), 9) AS weighted, round((SELECT tau FROM c ORDER BY n, tau LIMIT 1), 9) AS neutral, CAST(4 AS DOUBLE) AS cost_ratio_fn_over_fp", "scores"))
def a_best_thresholds(spark, sf):
    out = M.best_thresholds(M.cost_curves(M.threshold_curve(D.scores(spark, sf))))
    return out.select(r9(F.col("weighted"), "weighted"), r9(F.col("neutral"), "neutral"), "cost_ratio_fn_over_fp")


FINE = SWEEP.replace("(99 AS", "(1023 AS").replace("range(100)", "range(1024)")


@query(oracle(f"{FINE}, o AS (SELECT sum(target) AS ones FROM scores) SELECT k, round(tau, 9) AS tau, round(CASE WHEN ones - fn + fp > 0 THEN (ones - fn) / CAST(ones - fn + fp AS DOUBLE) END, 9) AS precision, round((ones - fn) / CAST(ones AS DOUBLE), 9) AS recall FROM sweep, o", "scores"))
def a_precision_recall(spark, sf):
    s = D.scores(spark, sf)
    out = M.precision_recall(M.threshold_curve(s, 1024), s.agg(F.sum("target").alias("ones")))
    return out.select("k", *[r9(F.col(c), c) for c in ("tau", "precision", "recall")])


# ---------------------------------------------------------------- samples and batches
ORDERED = "CAST(('0x' || substring(md5('7:' || doc_id), 1, 12)) AS BIGINT)"


@query(f"SELECT doc_id, n // 100 AS chunk FROM (SELECT doc_id, row_number() OVER (ORDER BY {ORDERED}, doc_id) - 1 AS n FROM documents)")
def l_random_chunks(spark, sf):
    return N.chunks(D.table(spark, sf, "documents").select("doc_id"), "doc_id", 100, 7)


@query(f"SELECT doc_id FROM documents ORDER BY {ORDERED}, doc_id LIMIT 150")
def l_random_sample(spark, sf):
    return N.sample(D.table(spark, sf, "documents").select("doc_id"), "doc_id", 150, 7)


@query(f"SELECT doc_id, CASE WHEN n < floor(c * 0.8) THEN 'train' WHEN n < floor(c * 0.9) THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY {ORDERED}, doc_id) - 1 AS n, count(*) OVER () AS c FROM documents)")
def l_split(spark, sf):
    return N.split(D.table(spark, sf, "documents").select("doc_id"), "doc_id", {"train": 0.8, "val": 0.1, "test": 0.1}, 7)


@query(f"""WITH o AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'test' WHEN quality = 1 THEN 'train' ELSE 'val' END AS split FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)),
    b AS (SELECT doc_id, arg_min(split, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) AS split FROM o GROUP BY doc_id),
    need AS (SELECT greatest(0, least(round_even(0.1 * n, 0), 10000) - t) AS nt, greatest(0, least(round_even(0.2 * n, 0), 10000) - v) AS nv FROM (SELECT count(*) AS n FROM documents), (SELECT count(*) FILTER (split = 'test') AS t, count(*) FILTER (split = 'val') AS v FROM b)),
    f AS (SELECT doc_id, row_number() OVER (ORDER BY {ORDERED}, doc_id) - 1 AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM b))
    SELECT doc_id, split FROM b UNION ALL SELECT doc_id, CASE WHEN k < nt THEN 'test' WHEN k < nt + nv THEN 'val' ELSE 'train' END AS split FROM f, need""")
def l_split_keeping(spark, sf):
    old = D.table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "test").when(F.col("quality") == 1, "train").otherwise("val").alias("split"))
    docs = D.table(spark, sf, "documents").select("doc_id")
    return N.split_keeping(docs, "doc_id", old.join(docs, "doc_id", "left_semi"), {"val": 0.2, "test": 0.1}, {"val": 10_000, "test": 10_000}, 7)


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 50000")
def l_until_enough(spark, sf):
    return N.until_enough(D.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 50_000)


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 5 AS batch FROM documents")
def l_naive_batches(spark, sf):
    return N.naive_batches(D.table(spark, sf, "documents").select("doc_id"), "doc_id", 5)


def _bucket_sql() -> str:
    """Three rounds of cells (16, 8 and 4 of them), then the rest in order."""
    parts = ["r0 AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS x, CAST(doc_id * 37 % 501 AS DOUBLE) AS y FROM documents)"]
    cell = "CASE WHEN {b} > {a} THEN least(CAST(floor(({c} - {a}) * {n} / greatest({b} - {a}, 1e-12)) AS BIGINT), {n} - 1) ELSE 0 END"
    for k, n in enumerate((4, 3, 2)):
        both = f"({cell.format(a='lx', b='hx', c='x', n=n)}) * {n} + {cell.format(a='ly', b='hy', c='y', n=n)}"
        parts += [
            f"c{k} AS (SELECT doc_id, x, y, {both} AS cell FROM r{k}, (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM r{k}))",
            f"n{k} AS (SELECT *, (row_number() OVER (PARTITION BY cell ORDER BY x, y, doc_id) - 1) // 5 AS b, count(*) OVER (PARTITION BY cell) // 5 AS whole FROM c{k})",
            f"r{k + 1} AS (SELECT doc_id, x, y FROM n{k} WHERE b >= whole)",
        ]
    found = " UNION ALL ".join(f"SELECT doc_id, x, y, '0{k}-' || cell || '-' || b AS batch FROM n{k} WHERE b < whole" for k in range(3))
    parts += [f"d AS ({found} UNION ALL SELECT doc_id, x, y, 'rest-' || ((row_number() OVER (ORDER BY x, y, doc_id) - 1) // 5) FROM r3)"]
    parts += [f"o AS (SELECT batch, row_number() OVER (ORDER BY {ORDERED.replace('doc_id', 'batch')}, batch) - 1 AS batch_order FROM (SELECT DISTINCT batch FROM d))"]
    return f"WITH {', '.join(parts)} SELECT doc_id, x, y, d.batch, batch_order FROM d JOIN o USING (batch)"


@query(_bucket_sql())
def l_bucket_batches(spark, sf):
    rows = D.table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x"), F.expr("CAST(doc_id * 37 % 501 AS DOUBLE)").alias("y"))
    return N.shuffled_batches(N.bucket_batches(rows, "doc_id", "x", "y", 5, 16), "batch", 7)


@query(oracle("""s AS (SELECT k, k // 4 AS batch, list(p ORDER BY i) AS v FROM scores GROUP BY k), m AS (SELECT *, max(len(v)) OVER (PARTITION BY batch) AS n FROM s) SELECT k, batch, list_concat(v, list_transform(range(n - len(v)), lambda j: v[-1])) AS v FROM m""", "scores"))
def l_padded_batches(spark, sf):
    s = D.scores(spark, sf).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("v")).withColumn("batch", F.expr("k div 4"))
    return N.padded(s, "batch", "v").select("k", "batch", "v")


@query(oracle("""s AS (SELECT k, k // 4 AS batch, count(*) AS n, list(struct_pack("start" := i, "end" := i + 1) ORDER BY i) FILTER (target = 1) AS v FROM scores GROUP BY k), f AS (SELECT * REPLACE (coalesce(v, []) AS v) FROM s),
    m AS (SELECT *, max(len(v)) OVER (PARTITION BY batch) AS most, max(n) OVER (PARTITION BY batch) AS z FROM f) SELECT k, batch, list_transform(list_concat(v, list_transform(range(most - len(v)), lambda j: struct_pack("start" := z - 2, "end" := z - 1))), lambda x: x."start" * 100000 + x."end") AS v FROM m""", "scores"))
def l_padded_proposals(spark, sf):
    """Proposals padded to the batch's most, as start and end in one number."""
    found = F.array_sort(F.collect_list(F.when(F.col("target") == 1, F.struct(F.col("i").alias("start"), (F.col("i") + 1).alias("end")))))
    s = D.scores(spark, sf).groupBy("k").agg(F.count("*").alias("n"), found.alias("v")).withColumn("batch", F.expr("k div 4"))
    return N.padded_proposals(s, "batch", "v", "n").select("k", "batch", F.transform("v", lambda x: x["start"].cast("long") * 100000 + x["end"].cast("long")).alias("v"))


@query(oracle(f"""c AS (SELECT *, k // 4 AS batch, {CLAMP} AS q, lag(p >= 0.5) OVER w AS before, lag(target) OVER w AS earlier FROM scores WINDOW w AS (PARTITION BY k ORDER BY i))
    SELECT batch, round(-avg((1 - target) * ln(1 - q) + target * ln(q)), 8) AS loss, count(*) FILTER (CAST(p >= 0.5 AS BIGINT) = target) AS n_right, count(*) AS n, count(*) FILTER (p >= 0.5 AND NOT before) AS n_predicted, count(*) FILTER (target = 1 AND earlier = 0) AS n_target FROM c GROUP BY batch""", "scores"))
def a_batch_losses(spark, sf):
    """Losses of padded batches: padding is taken off before anything is counted."""
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda x: x[c]).alias(c)
    s = D.scores(spark, sf).groupBy("k").agg(of("p"), of("target"), F.count("*").alias("n")).withColumn("batch", F.expr("k div 4"))
    lines = N.unpadded(N.padded(N.padded(s, "batch", "p"), "batch", "target"), ["batch", "k"], ["p", "target"], "n")
    return M.batch_losses(lines, ["batch"], "k").withColumn("loss", F.round("loss", 8))


@query(oracle("SELECT k, count(*) AS n, list_sort(list(target)) AS ids, dense_rank() OVER (ORDER BY k) - 1 AS group_no FROM scores GROUP BY k", "scores"))
def a_groups_as_lists(spark, sf):
    """Groups as lists, numbered in order without a window over all of them."""
    g = D.scores(spark, sf).groupBy("k").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("target")).alias("ids"))
    return N.numbered(g, ["k"], "group_no")


@query(oracle(f"""{LINES}, ends AS (SELECT img, max(seq) AS last, max(bottom) AS e FROM lines GROUP BY img), axis AS (SELECT DISTINCT img, unnest(range(50)) AS y FROM boxes),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY img, top ORDER BY seq DESC) AS k FROM lines) WHERE k = 1),
    j AS (SELECT a.img, a.y, CASE WHEN a.y > e THEN last + 1 ELSE coalesce(l.seq, 0) END AS tl, CAST(coalesce(a.y > l.bottom, false) AND NOT a.y > e AS BIGINT) AS bt FROM axis a ASOF LEFT JOIN best l ON a.img = l.img AND a.y >= l.top JOIN ends ON a.img = ends.img),
    k AS (SELECT j.*, max(tl) OVER (PARTITION BY img) AS m, EXISTS (SELECT 1 FROM boxes b WHERE b.img = j.img AND b.t = j.y) AS ink FROM j),
    z AS (SELECT *, max(CASE WHEN tl = 0 THEN y END) OVER w AS h1, min(CASE WHEN tl = 0 AND ink THEN y END) OVER w AS hi, min(CASE WHEN tl = m AND tl > 0 THEN y END) OVER w AS t0, max(CASE WHEN tl = m AND tl > 0 THEN y END) OVER w AS t1, max(CASE WHEN tl = m AND tl > 0 AND ink THEN y END) OVER w AS ti FROM k WINDOW w AS (PARTITION BY img)),
    q AS (SELECT *, CASE WHEN hi < h1 THEN hi ELSE h1 // 5 * 4 END AS s, coalesce(ti + 1, t1 + 1 - (t1 - t0 + 1) // 5) AS e FROM z),
    f AS (SELECT img, y, CAST(CASE WHEN tl = 0 AND y >= s + (h1 - s) // 2 THEN 1 WHEN tl = m AND tl > 0 AND y <= t0 + (least(e, t1) - t0 + 1) // 2 THEN m - 1 ELSE tl END AS BIGINT) AS text_line,
    CAST(CASE WHEN tl = 0 AND y >= s THEN 1 WHEN tl = m AND tl > 0 AND y <= e THEN 1 WHEN tl = 0 OR tl = m THEN 0 ELSE bt END AS BIGINT) AS "between" FROM q)
    SELECT f.*, CASE WHEN "between" = 1 THEN coalesce(l.next_start_like, 0) ELSE 0 END AS like_row_start, CASE WHEN "between" = 1 AND l.seq IS NOT NULL THEN least(greatest(6 - least(caps, next_caps), 0), 5) / CAST(6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS caps_inverted FROM f LEFT JOIN lines l ON f.img = l.img AND f.text_line = l.seq""", "boxes"))
def f_table_ends(spark, sf):
    b = D.boxes(spark, sf)
    lines = b.selectExpr("img", "word AS seq", "t AS top", "b AS bottom", "start_like AS next_start_like", "word % 4 AS caps", "word % 3 AS next_caps")
    axis = b.select("img").distinct().select("img", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("y"))
    ink = b.selectExpr("img", "t AS y")
    return L.with_table_ends(L.between_lines(axis, lines, ["img"]), ink, lines, ["img"])


@query(oracle("h AS (SELECT k, i, target = 1 AS hit FROM scores), " + ISLANDS + " SELECT k, min(i) AS start, max(i) AS \"end\", count(*) AS length FROM r WHERE hit GROUP BY k, run", "scores"))
def t_text_boundaries(spark, sf):
    """Runs of ones in a 0/1 vector."""
    return S.runs(D.scores(spark, sf), ["k"], "i", "target").where("target = 1").select("k", "start", "end", "length")


@query("SELECT source, count(*) AS n, count(*) FILTER (lang <> 'en') AS n_other, round(100 * avg(CASE WHEN lang <> 'en' THEN 1.0 ELSE 0.0 END), 6) AS percent, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY source")
def a_counts_and_rates(spark, sf):
    other = F.col("lang") != "en"
    return D.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(other).alias("n_other"), F.round(100 * F.avg(F.when(other, 1.0).otherwise(0.0)), 6).alias("percent"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query(oracle("SELECT img, word % 5 AS bucket, min(l) AS x0, min(t) AS y0, max(r) AS x1, max(b) AS y1, count(DISTINCT (l, t)) AS places FROM boxes GROUP BY ALL", "boxes"))
def a_bucket_rectangles(spark, sf):
    return D.boxes(spark, sf).groupBy("img", (F.col("word") % 5).alias("bucket")).agg(F.min("l").alias("x0"), F.min("t").alias("y0"), F.max("r").alias("x1"), F.max("b").alias("y1"), F.count_distinct("l", "t").alias("places"))
