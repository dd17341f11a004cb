"""Small tables worked out by hand, and operators that SQL has no twin for."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions import sequences as S
from tabloom.functions import text as X
from tabloom.operators import boxes as B
from tabloom.operators import cells as C
from tabloom.operators import ink, lines, metrics, sampling, scoring, separators
from tabloom.sources import readers, sinks, synthetic
from tabloom.streaming import ingest


def seq(spark, values, name="v"):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], f"k long, i long, {name} {'long' if isinstance(values[0], int) else 'double'}")


def col(df, order, *names):
    return [tuple(r) if len(names) > 1 else r[0] for r in df.orderBy(order).select(*names).collect()]


def test_interval_starts_one_before(spark):
    out = S.intervals_where(seq(spark, [0, 0, 1, 1, 0]), ["k"], "i", F.col("v") > 0)
    assert [tuple(r) for r in out.select("start", "end").collect()] == [(1, 3)]


def test_reset_cumsum_and_zero_start(spark):
    assert col(S.reset_cumsum(seq(spark, [1, 1, 0, 1, 1, 1]), ["k"], "i", "v", "o"), "i", "o") == [1, 2, 0, 1, 2, 3]
    assert col(S.zero_start(seq(spark, [1, 1, 0, 1]), ["k"], "i", "v", "o"), "i", "o") == [0, 0, 0, 1]
    assert col(S.zero_start(seq(spark, [1, 1]), ["k"], "i", "v", "o"), "i", "o") == [0, 0]


def test_as_of(spark):
    axis = spark.range(6).select(F.lit(1).alias("k"), F.col("id").alias("i"))
    events = spark.createDataFrame([(1, 1, "a"), (1, 4, "b")], "k int, e long, x string")
    assert col(S.as_of(axis, events, ["k"], "i", "e", ["x"]), "i", "x") == [None, "a", "a", "a", "b", "b"]


def test_half_even_and_capital_runs(spark):
    df = spark.createDataFrame([(2.5, "aBCdEFGh"), (-0.5, "abc"), (3.5, "")], "x double, s string")
    assert [r[0] for r in df.select(X.half_even(F.col("x"))).collect()] == [2, 0, 4]
    assert [r[0] for r in df.select(X.longest_capital_run(F.col("s"))).collect()] == [3, 0, 0]


def test_snap_leaves_what_does_not_overlap(spark):
    better = spark.createDataFrame([(1, 1, 5), (1, 20, 30)], "k int, start long, end long")
    rows = spark.createDataFrame([(1, 100, 110), (1, 4, 7), (1, 6, 25)], "k int, start long, end long")
    got = {(r["start"], r["end"]): (r["new_start"], r["new_end"]) for r in B.snapped(rows, better, ["k"]).collect()}
    assert got == {(100, 110): (100, 110), (4, 7): (1, 5), (6, 25): (20, 30)}


def test_box_join_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    a = [(int(p), i, *(int(x) for x in (l, t, l + w, t + h))) for i, (p, l, t, w, h) in enumerate(rng.integers(0, [2, 300, 500, 60, 200], (80, 5)))]
    df = spark.createDataFrame(a, "k long, id long, l long, t long, r long, b long")
    got = {(r["id"], r["other"]) for r in B.touching(df, B.as_targets(df.withColumn("x", F.lit(0)), ["k"]).join(df.select("k", F.col("id").alias("other"), F.col("l").alias("tl"), F.col("t").alias("tt"), F.col("r").alias("tr"), F.col("b").alias("tb")), ["k", "tl", "tt", "tr", "tb"]).distinct(), ["k"]).collect()}
    want = {(x[1], y[1]) for x in a for y in a if x[0] == y[0] and x[2] < y[4] and x[4] >= y[2] and x[3] < y[5] and x[5] >= y[3]}
    assert got == want
    targets = B.as_targets(df.where("id % 3 = 0"), ["k"])
    free = {r["id"] for r in B.untouched(df, targets, ["k"], ["k", "id"]).collect()}
    assert free == {x[1] for x in a} - {i for i, j in want if j % 3 == 0}


def test_line_numbers(spark):
    rows = [(1, 0, "a", 0, 10, 5, 20), (1, 1, "b", 6, 11, 9, 22), (1, 2, "c", 0, 30, 5, 40), (1, 3, "d", 6, 31, 9, 37)]
    words = spark.createDataFrame(rows, "page long, pos long, text string, l long, t long, r long, b long")
    assert col(lines.numbered(words), "pos", "seq_line") == [1, 1, 2, 2]


def test_runs_sum_to_the_line(spark):
    out = S.runs(seq(spark, [1, 1, 0, 0, 0, 1]), ["k"], "i", "v")
    assert col(out, "run", "length") == [2, 3, 1]


def test_intervals_to_vector_and_back(spark):
    seps = spark.createDataFrame([(1, 2, 3), (1, 6, 6)], "k int, start long, end long")
    size = spark.createDataFrame([(1, 9)], "k int, n long")
    vector = separators.to_vector(seps, size, ["k"], "n")
    assert col(vector, "at", "on") == [0, 0, 1, 1, 0, 0, 1, 0, 0]
    back = S.intervals_where(vector, ["k"], "at", F.col("on") == 1)
    assert sorted((r["start"] + 1, r["end"]) for r in back.collect()) == [(2, 3), (6, 6)]


def test_clean_table(spark):
    cells = [(0, 0, "Item"), (0, 1, None), (0, 2, "("), (0, 3, "1,000"), (0, 4, ")"), (1, 0, "Assets in total"), (1, 1, None), (1, 2, "("), (1, 3, "12"), (1, 4, ")"), (2, 0, "Note"), (2, 1, None), (2, 2, None), (2, 3, None), (2, 4, None)]
    grid = spark.createDataFrame([(1, *c) for c in cells], "k int, row long, col long, text string")
    got = sorted((r["row"], r["header"], r["text"]) for r in C.cleaned(grid, ["k"]).collect())
    assert got == [(0, "(1,000)", "(12)"), (0, "Labels", "Assets in total")]


def test_threshold_curve_is_monotone(spark):
    rng = np.random.default_rng(0)
    p = [0.0, 1.0, *np.round(rng.random(300), 3), *(k / 99 for k in range(100))]
    t = rng.integers(0, 2, len(p))
    df = spark.createDataFrame([(float(x), int(y)) for x, y in zip(p, t)], "p double, target long")
    rows = metrics.threshold_curve(df).orderBy("k").collect()
    for r in rows:
        assert r["fp"] == sum(x > r["tau"] and y == 0 for x, y in zip(p, t))
        assert r["fn"] == sum(x <= r["tau"] and y == 1 for x, y in zip(p, t))


def test_samples_lose_nothing(spark):
    df = spark.createDataFrame([(i, float(i % 17), float(i % 5)) for i in range(203)], "id long, x double, y double")
    b = sampling.bucket_batches(df, "id", "x", "y", 5)
    assert b.count() == 203 and b.groupBy("batch").count().agg(F.max("count")).first()[0] == 5
    prior = spark.createDataFrame([(1, "test"), (1, "train"), (2, "val")], "id long, split string")
    s = sampling.split_keeping(df.select("id"), "id", prior, {"val": 0.1, "test": 0.1}, {"val": 15, "test": 100}, 1)
    got = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert got == {"test": 20, "val": 15, "train": 168}
    assert {r["id"]: r["split"] for r in s.where("id in (1, 2)").collect()} == {1: "train", 2: "val"}


def test_tight_boxes(spark):
    page = np.zeros((20, 20), bool)
    page[6:9, 5:11] = True
    assert ink.tight(page, 3, 4, 14, 12) == (5, 6, 10, 8)
    assert ink.tight(page, 0, 0, 3, 3) is None


def test_tight_boxes_leave_ruled_lines_and_stray_rows():
    page = np.zeros((60, 60), bool)
    page[24:30, 22:46] = True  # the word
    page[20, :] = page[38, :] = True  # ruled through the context
    page[:, 20] = True
    assert ink.tight(page, 20, 20, 47, 39) == (22, 24, 45, 29)
    page[:, 20] = False
    page[30, 24] = page[32, 24:26] = True  # two pixels or fewer
    assert ink.tight(page, 20, 20, 47, 39) == (22, 24, 45, 29)
    page[33, 24:27] = True  # three, but under a fifth of the mean inked row
    assert ink.tight(page, 20, 20, 47, 36) == (22, 24, 45, 29)
    dots = np.zeros((9, 9), bool)
    dots[4, 2:7] = True
    dots[6, 2] = True
    assert ink.tight(dots, 0, 0, 8, 8) == (2, 4, 6, 4)
    assert ink.tight(dots, 0, 5, 8, 8) is None
    assert ink.ruled_ends(np.ones(8, bool)) == (0, 0)
    # windows of six rows: the medians of the last ones are nothing, of the first ones not
    assert ink.sparse_rows(np.array([5] * 6 + [0] * 6)).tolist() == [False] * 9 + [True] * 3
    assert not ink.sparse_rows(np.array([0] * 5 + [9] + [0] * 5)).any()


def test_line_numbers_against_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(int(p), i, int(l), int(t), int(t + h)) for i, (p, l, t, h) in enumerate(rng.integers(0, [3, 90, 300, 30], (400, 4)))]
    want = {}
    for p in range(3):
        number, bottom = 0, 0
        for _, i, _, t, b in sorted((r for r in rows if r[0] == p), key=lambda r: (r[3], r[2], r[1])):
            if b - bottom > 5 and t > bottom:
                number, bottom = number + 1, b
            want[i] = number
    words = spark.createDataFrame(rows, "page long, pos long, l long, t long, b long")
    out = lines.numbered(words)
    assert out.columns == [*words.columns, "seq_line"]
    assert {r["pos"]: r["seq_line"] for r in out.collect()} == want
    assert lines.numbered(words.where("false")).count() == 0


def test_scoring_parts():
    x = np.arange(12.0).reshape(6, 2)
    assert scoring.pooled(x, 3).shape == (3, 2) and scoring.top(x, 8).shape == (8, 2)
    assert np.allclose(scoring.convolved(x, np.eye(2)[None]), x)
    assert np.allclose(scoring.convolved(x[:, :1], np.ones((4, 1, 1)))[[0, 5], 0], [0 + 0 + 2 + 4, 8 + 10 + 10 + 10])
    assert (scoring.gathered(x, np.array([-3, 99])) == x[[0, 5]]).all()
    assert scoring.masked_top(x, 1, 2, 3).tolist() == [5, 4, 3] and np.isneginf(scoring.masked_top(x, 0, 0, 3)[2])


def plain_areas(image, kernel):
    """Every window by itself, edges repeated."""
    c, high, wide = kernel.shape
    out = np.zeros((c, *image.shape))
    for y in range(image.shape[0]):
        for x in range(image.shape[1]):
            ys = np.clip(np.arange(high) + y - (high - 1) // 2, 0, image.shape[0] - 1)
            xs = np.clip(np.arange(wide) + x - (wide - 1) // 2, 0, image.shape[1] - 1)
            out[:, y, x] = (kernel * image[np.ix_(ys, xs)]).sum(axis=(1, 2))
    return np.maximum(out, 0)


def test_image_convolution_and_scanner_against_windows():
    rng = np.random.default_rng(2)
    image, kernel = rng.random((13, 27)), rng.standard_normal((3, 4, 8))
    part = {"kernel": kernel, "scale": np.ones(3), "shift": np.zeros(3)}
    got = scoring.areas(image, part, lambda v: v.transpose(1, 0, 2), block=5)
    assert np.allclose(got.transpose(1, 0, 2), plain_areas(image, kernel))
    scan = {"kernel": rng.standard_normal((2, 10)), "scale": np.array([1.0, 2.0]), "shift": np.array([0.0, 0.5])}
    want = [[max(max(0, image[y, k : k + 10] @ scan["kernel"][c] * scan["scale"][c] + scan["shift"][c]) for k in (0, 10)) for c in range(2)] for y in range(13)]
    assert np.allclose(scoring.scanned(image, scan), want)
    assert not scoring.scanned(image[:, :9], scan).any()


def test_networks_have_the_published_shapes():
    rng, w = np.random.default_rng(5), scoring.made_up_weights()
    assert [m.shape for m, _ in w["row"]["layers"]] == [(976, 48), (48, 16), (16, 1)] and [m.shape for m, _ in w["row"]["last"]] == [(7, 6), (6, 1)]
    image, x = rng.random((50, 64)), rng.random((50, 14))
    p = scoring.line_scores(image, x, w["row"])
    assert p.shape == (50,) and ((p > 0) & (p < 1)).all()
    # the whole image turned over, with columns' kernels, sees the same areas
    turned = scoring.areas(image.T, w["col"]["image"], lambda v: v.transpose(1, 0, 2))
    assert np.allclose(turned.transpose(1, 2, 0), plain_areas(image, w["row"]["image"]["kernel"]))
    s = scoring.made_up_weights(separators=True)
    assert [m.shape for m, _ in s["col"]["layers"]] == [(50, 36), (36, 16), (16, 1)]
    spans, y = np.array([[0, 1], [20, 30], [49, 49]]), rng.random((3, 18))
    q = scoring.separator_scores(image, spans, y, s["row"])
    assert q.shape == (3,) and ((q > 0) & (q < 1)).all()
    # by hand for the second one: ten lines around it, eight largest each
    best = -np.sort(-plain_areas(image, s["row"]["area"]["kernel"]).transpose(1, 0, 2).reshape(50, -1), axis=1)[:, :8]
    scans = scoring.scanned(image, s["row"]["scanner"])
    largest = lambda v: -np.sort(-v.ravel())[:8]
    inputs = np.concatenate([y[1], largest(best[[15, 7, 0, 0, 0]]), largest(best[[35, 43, 49, 49, 49]]), largest(scans[20:31]), largest(scans)])
    assert np.isclose(q[1], scoring.sigmoid(scoring.mlp(inputs[None], s["row"]["layers"]))[0, 0])
    assert scoring.described(w["row"])["total"] == sum(v for k, v in scoring.described(w["row"]).items() if k != "total")


def test_annotation_files(spark, tmp_path):
    boxes = spark.createDataFrame([(1, "table row", 0, 1, 2, 3, 4), (1, "a<b", 1, 5, 6, 7, 8)], "k int, name string, n int, xmin long, ymin long, xmax long, ymax long")
    xml = sinks.as_annotation(boxes, ["k"], ["n"])
    (tmp_path / "a.xml").write_text(xml.first()["xml"])
    got = readers.read_annotations(spark, str(tmp_path / "a.xml"), "a<b").collect()
    assert [tuple(r) for r in got] == [("a<b", 5.0, 6.0, 7.0, 8.0)]


def test_sinks_and_policies(spark, tmp_path):
    df = spark.createDataFrame([("d", 1, "x")], "pdf string, page int, text string")
    path = str(tmp_path / "w")
    sinks.write_words(df, path)
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_words(df, path)
    sinks.write_words(df, path, policy="overwrite")
    assert spark.read.parquet(path).count() == 2
    sinks.write_words(df, path, policy="replace")
    assert readers.read_words(spark, path).count() == 1
    sinks.write_rejects(df, str(tmp_path / "r"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "r")).count() == 1


def test_word_quads(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [5.0, 2.0], [5.0, 9.0], [1.0, 9.0]], "x", 0.5)], "quad array<array<double>>, text string, conf double")
    r = readers.word_quads(df).first()
    assert (r["left"], r["right"], r["top"], r["bottom"], r["conf"]) == (1.0, 5.0, 2.0, 9.0, 50.0)


def test_streamed_line_numbers_continue(spark, tmp_path):
    rows = [(1, 0, "a", 0, 10, 5, 20), (1, 1, "b", 6, 11, 9, 22), (1, 2, "c", 0, 30, 5, 40)]
    src = str(tmp_path / "in")
    frame = lambda r: spark.createDataFrame(r, ingest.WORDS)
    frame(rows[:2]).coalesce(1).write.parquet(src)
    out = []
    for k in range(2):
        if k:
            frame(rows[2:]).coalesce(1).write.mode("append").parquet(src)
        q = ingest.numbered_stream(ingest.new_words(spark, src)).writeStream.foreachBatch(lambda d, _: out.extend(tuple(r) for r in d.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(out) == [(1, 0, 1), (1, 1, 1), (1, 2, 2)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "k int, i long, v long")
    assert S.runs(none, ["k"], "i", "v").count() == 0
    assert pd.DataFrame(S.reset_cumsum(none, ["k"], "i", "v", "o").collect()).empty


def test_separators_widen_to_the_first_line_unlike_in_any_measure(spark):
    """Lines 0 to 11; the separator is 5 to 6. A line counts as like if it is like one of its lines, in both measures."""
    p = [0.0, 0.9, 0.1, 0.2, 0.15, 0.1, 0.6, 0.55, 0.5, 0.6, 0.6, 0.6]
    w = [1.0] * 9 + [9.0, 1.0, 1.0]
    rows = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(zip(p, w))], "k long, at long, p double, w double")
    sep = spark.createDataFrame([(1, 5, 6)], "k long, start long, end long")
    wide = lambda reach, most: tuple(separators.widened(sep, rows, ["k"], most, reach).first())
    assert wide(50, {"p": 0.2, "w": 2.0}) == (1, 5, 6, 2, 8)
    assert wide(50, {"p": 0.2}) == (1, 5, 6, 2, 11)  # not beyond the image
    assert wide(2, {"p": 0.2}) == (1, 5, 6, 3, 8)
    assert wide(50, {"p": 5.0}) == (1, 5, 6, 0, 11)


def test_table_ends_by_hand(spark):
    """Text lines at 10 to 14 and 20 to 24 of 40 rows."""
    axis = spark.range(40).select(F.lit(1).alias("k"), F.col("id").alias("y"))
    found = spark.createDataFrame([(1, 1, 10, 14, 1, 2, 0), (1, 2, 20, 24, 1, 0, 3)], "k int, seq long, top long, bottom long, next_start_like long, caps long, next_caps long")
    base = lines.between_lines(axis, found, ["k"])
    ends = lambda ink: {r["y"]: r for r in lines.with_table_ends(base, spark.createDataFrame([(1, y) for y in ink], "k int, y long"), found, ["k"]).orderBy("y").collect()}
    got = ends([4, 12, 30])
    assert [y for y in got if got[y]["between"] == 1] == [*range(4, 10), *range(15, 20), *range(25, 32)]
    assert [got[y]["text_line"] for y in (3, 5, 6, 9, 10, 25, 28, 29, 39)] == [0, 0, 1, 1, 1, 2, 2, 3, 3]
    assert (got[6]["like_row_start"], got[6]["caps_inverted"]) == (1, 5 / 6) and (got[5]["like_row_start"], got[5]["caps_inverted"]) == (0, 0.0)
    got = ends([12])  # no ink: the last fifth before, four fifths after
    assert [y for y in got if got[y]["between"] == 1 and not 10 <= y < 25] == [4, 5, 6, 7, 8, 9, *range(25, 38)]


def test_running_total_of_many_parts(spark):
    rng = np.random.default_rng(8)
    rows = [(int(a), i, int(b)) for i, (a, b) in enumerate(rng.integers(0, [50, 9], (3000, 2)))] + [(None, 5000, 3), (None, 5001, 4)]
    df = spark.createDataFrame(rows, "a long, i long, n long")
    got = {r["i"]: r["before"] for r in sampling.running_total(df, ["a", "i"], F.col("n"), "before", 100).collect()}
    total, want = 0, {}
    for _, i, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want[i], total = total, total + n
    assert got == want


def test_rolled_is_circular(spark):
    out = S.rolled(seq(spark, [10, 11, 12, 13]), ["k"], "i", "v", [1, -1, 5])
    assert col(out, "i", "v_roll_1", "v_roll_m1", "v_roll_5") == [(13, 11, 13), (10, 12, 10), (11, 13, 11), (12, 10, 12)]


def test_words_of_tables(spark):
    words = spark.createDataFrame([(1, 0, 5, 5, 9, 9), (1, 1, 5, 5, 21, 9), (2, 2, 5, 5, 9, 9)], "page long, pos long, l long, t long, r long, b long")
    rects = spark.createDataFrame([(1, 7, 0, 0, 20, 20), (1, 8, 5, 5, 9, 9), (3, 9, 0, 0, 99, 99)], "page long, tbl long, x0 long, y0 long, x1 long, y1 long")
    assert {(r["pos"], r["tbl"]) for r in B.contained(words, rects, ["page"]).collect()} == {(0, 7), (0, 8)}


def test_a_warned_write_is_never_left_out(spark, tmp_path):
    df = spark.range(2).withColumn("at", F.col("id"))
    sinks.write_long(df, str(tmp_path / "x"), "warn")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_long(df, str(tmp_path / "x"), "warn")


def test_synthetic_images_show_their_separators(spark):
    made = synthetic.blocks(spark, 1, 3).cache()
    rows = {r["at"]: r for r in synthetic.lines(made).where("axis = 'row'").collect()}
    assert len(rows) == 600
    dark = {r["y"]: r["n"] for r in synthetic.pixels(synthetic.lines(made)).where("v = 0").groupBy("y").agg(F.count("*").alias("n")).collect()}
    for y, r in rows.items():
        assert dark.get(y, 0) >= {"solid": 800, "dashed": 720, "none": 0}[r["pattern"]]
    begins = [r["start_like"] for r in synthetic.text_boxes(made).orderBy("block").collect()]
    assert begins == [rows[60 * k + 26]["target"] for k in range(10)]


def test_whole_boxes_take_six_numbers_only(spark):
    df = spark.createDataFrame([("0 0.5 0.5 0.5 0.25 0.9",)], "line string")
    r = readers.whole_boxes(df, "line", F.lit(10), F.lit(20)).first()
    assert (r["x0"], r["y0"], r["x1"], r["y1"]) == (2, 8, 8, 12)
    with pytest.raises(Exception, match="six numbers"):
        readers.whole_boxes(spark.createDataFrame([("0 0.5 0.5 0.5 0.25",)], "line string"), "line", F.lit(10), F.lit(20)).collect()
