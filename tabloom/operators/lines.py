"""Words to text lines, and features of pixel lines. One code path serves rows and columns:
a pixel table is (key, line, at, v), rows having line = y and at = x, columns the reverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions import sequences as S
from tabloom.functions import text as X


def not_tall(words: DataFrame, keys: list[str], deviations: float = 2.0) -> DataFrame:
    """Words no taller than mean plus two sample deviations of their page; alone on a page, kept."""
    page = W.partitionBy(*keys)
    h = F.col("b") - F.col("t")
    out = words.withColumn("_m", F.avg(h).over(page)).withColumn("_s", F.stddev_samp(h).over(page))
    return out.where(F.col("_s").isNull() | (h <= F.col("_m") + deviations * F.col("_s"))).drop("_m", "_s")


def harmonised(words: DataFrame, page: str = "page") -> DataFrame:
    """Words of a line given the line's extent where lines stay apart with it."""
    lines = words.groupBy(page, "block", "line").agg(F.min("t").alias("top"), F.max("b").alias("bottom"))
    order = W.partitionBy(page).orderBy("block", "line")
    lines = lines.withColumn("_prev", F.lag("bottom", 1, 0).over(order)).withColumn("_next", F.lead("top", 1, 9999999).over(order))
    lines = lines.select(page, "block", "line", "top", "bottom", ((F.col("top") > F.col("_prev")) & (F.col("bottom") < F.col("_next"))).alias("uniform"))
    out = words.join(lines, [page, "block", "line"])
    return out.withColumn("t", F.when(F.col("uniform"), F.col("top")).otherwise(F.col("t"))).withColumn("b", F.when(F.col("uniform"), F.col("bottom")).otherwise(F.col("b"))).drop("top", "bottom")


def numbered(words: DataFrame, page: str = "page", gap: int = 5) -> DataFrame:
    """Line numbers in reading order: a word opens a line if its bottom exceeds that of the word
    that opened the last one by more than the gap and its top lies below it. The state is the
    opening word, so a page's words are folded in order: one array a page, one shuffle. The fold keeps
    only where lines open; the lines are then slices of the array. Words without a top come first."""
    order = ["t", "l", "pos"]
    rest = [c for c in words.columns if c not in (page, *order)]
    pages = words.groupBy(page).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("_w"))
    state = lambda opens, bottom, i: F.struct(opens.alias("opens"), bottom.cast("double").alias("bottom"), i.alias("i"))

    def step(s: Column, w: Column) -> Column:
        i = s["i"] + 1
        opens = (w["b"] - s["bottom"] > gap) & (w["t"] > s["bottom"])
        return F.when(opens, state(F.concat(s["opens"], F.array(i)), w["b"], i)).otherwise(state(s["opens"], s["bottom"], i))

    # the first slice, number 0, is of the words before any line
    opens = F.aggregate("_w", state(F.array(F.lit(1)), F.lit(0), F.lit(0)), step, lambda s: s["opens"])
    pages = pages.withColumn("_o", opens).withColumn("_o", F.concat("_o", F.array(F.size("_w") + 1)))
    cut = lambda a, k: F.slice("_w", a, F.get("_o", k + 1) - a)
    lines = F.transform(F.slice("_o", 1, F.size("_o") - 1), cut)
    one = pages.select(page, F.posexplode(lines).alias("seq_line", "_line")).select(page, "seq_line", F.explode("_line").alias("_w"))
    return one.select(*[F.col(c) if c == page else F.col(f"_w.{c}").alias(c) for c in words.columns], F.col("seq_line").cast("long").alias("seq_line"))


def line_starts(words: DataFrame, page: str = "page") -> DataFrame:
    """First word of each line, then first line of each top, with what the next line begins with."""
    order = W.partitionBy(page, "block", "line").orderBy("word", "pos")
    seq = F.dense_rank().over(W.partitionBy(page).orderBy("block", "line"))
    caps = F.max(X.longest_capital_run(F.col("text"))).over(W.partitionBy(page, "block", "line"))
    first = words.withColumn("seq", seq.cast("long")).withColumn("caps", caps).withColumn("_k", F.row_number().over(order)).where("_k = 1")
    first = first.withColumn("start_like", X.starts_row(F.col("text")).cast("long"))
    by_line = W.partitionBy(page).orderBy("block", "line")
    first = first.withColumn("next_start_like", F.lead("start_like", 1, 1).over(by_line)).withColumn("next_caps", F.lead("caps", 1, 0).over(by_line))
    top = W.partitionBy(page, "t").orderBy("block", "line")
    return first.withColumn("_k", F.row_number().over(top)).where("_k = 1").drop("_k")


def line_statistics(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, mean absolute difference of neighbours, and mean and population deviation of run
    lengths as shares of the line."""
    one = W.partitionBy(*keys, "line").orderBy("at")
    base = pixels.withColumn("_d", F.abs(F.col("v") - F.lag("v").over(one))).groupBy(*keys, "line").agg(F.avg("v").alias("avg"), F.avg("_d").alias("abs_diff"), F.count("*").alias("_n"))
    lengths = S.runs(pixels, [*keys, "line"], "at", "v").join(base.select(*keys, "line", "_n"), [*keys, "line"])
    share = F.col("length") / F.col("_n")
    spells = lengths.groupBy(*keys, "line").agg(F.avg(share).alias("spell_mean"), F.stddev_pop(share).alias("spell_sd"))
    return base.drop("_n").join(spells, [*keys, "line"])


def percentiles(lines: DataFrame, keys: list[str], value: str, shares: tuple[float, ...] = (0.0, 0.05, 0.1)) -> DataFrame:
    return lines.groupBy(*keys).agg(*[F.expr(f"percentile({value}, {s}D)").alias(f"p{round(100 * s)}") for s in shares])


def between_lines(axis: DataFrame, lines: DataFrame, keys: list[str], at: str = "y") -> DataFrame:
    """Pixel rows with the text line above them and whether they lie between lines. Before the
    first line the number is 0; after the last one's bottom it is that of a line more, never between."""
    out = S.as_of(axis, lines, keys, at, "top", ["seq", "bottom", "next_start_like", "next_caps", "caps"])
    last = lines.groupBy(*keys).agg(F.max("seq").alias("_last"), F.max("bottom").alias("_end"))
    out = out.join(last, keys, "left")
    after = F.col(at) > F.col("_end")
    out = out.withColumn("between", (~after & F.coalesce(F.col(at) > F.col("bottom"), F.lit(False))).cast("long"))
    out = out.withColumn("like_row_start", F.when(F.col("between") == 1, F.coalesce("next_start_like", F.lit(0))).otherwise(F.lit(0)))
    out = out.withColumn("caps_inverted", F.when(F.col("between") == 1, X.inverted_capital_run(F.col("caps"), F.col("next_caps"))).otherwise(F.lit(0.0)))
    out = out.withColumn("text_line", F.when(after, F.col("_last") + 1).otherwise(F.coalesce("seq", F.lit(0))))
    return out.select(*axis.columns, "text_line", "between", "like_row_start", "caps_inverted")


def painted(boxes: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Raster of word boxes: y, x, value (255 start-like, 128 other, later words on top), as the
    dense rows of each key's size (w, h)."""
    fill = F.when(F.col("start_like") == 1, F.lit(255)).otherwise(F.lit(128))
    cells = boxes.withColumn("y", F.explode(F.sequence("t", "b"))).withColumn("x", F.explode(F.sequence("l", "r")))
    cells = cells.groupBy(*keys, "y", "x").agg(F.max_by(fill, "word").alias("v"))
    grid = sizes.select(*keys, "w", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)))
    return grid.join(cells, [*keys, "y", "x"], "left").select(*keys, "y", "x", F.coalesce("v", F.lit(0)).cast("long").alias("v"))


def nearest_right_share(raster: DataFrame, keys: list[str]) -> DataFrame:
    """Per column: of the rows with a word to the right, the share whose next one is start-like."""
    right = W.partitionBy(*keys, "y").orderBy("x").rowsBetween(1, W.unboundedFollowing)
    seen = raster.withColumn("_next", F.first(F.when(F.col("v") > 0, F.col("v")), ignorenulls=True).over(right))
    counted = seen.groupBy(*keys, "x").agg(F.sum((F.col("_next") == 255).cast("long")).alias("s"), F.count("_next").alias("n"))
    return counted.select(*keys, "x", (F.coalesce("s", F.lit(0)) / F.greatest("n", F.lit(1))).alias("startlike_share"))


def crossed(boxes: DataFrame, sizes: DataFrame, keys: list[str], low: str, high: str, size: str) -> DataFrame:
    """Words crossed by every pixel line of the axis, and relative to the table's most."""
    dense = S.on_dense_axis(S.stabbing_counts(boxes, keys, low, high), sizes, keys, size)
    most = F.max("n").over(W.partitionBy(*keys))
    return dense.withColumn("n", F.col("n").cast("long")).withColumn("relative", F.when(most == 0, F.lit(0.0)).otherwise(F.col("n") / most))


def text_distances(raster: DataFrame, keys: list[str]) -> DataFrame:
    """Distance to the nearest word on the left and on the right as shares of the width, null
    where there is none or on a word."""
    rows = [*keys, "y"]
    free = raster.withColumn("m", (F.col("v") == 0).cast("long")).withColumn("_w", F.count("*").over(W.partitionBy(*rows)))
    out = S.zero_start(free, rows, "x", "m", "_z")
    out = S.reset_cumsum(out, rows, "x", "_z", "_left")
    out = out.withColumn("_back", -F.col("x"))
    out = S.zero_start(out, rows, "_back", "m", "_z")
    out = S.reset_cumsum(out, rows, "_back", "_z", "_right")
    share = lambda c: F.when(F.col(c) != 0, F.col(c) / F.col("_w"))
    return out.select(*rows, "x", share("_left").alias("left"), share("_right").alias("right"))


def distance_ratio(distances: DataFrame, keys: list[str], value: str) -> DataFrame:
    p = F.expr(f"percentile({value}, 0.4D)") / F.expr(f"percentile({value}, 0.6D)")
    return distances.groupBy(*keys, "x").agg(F.coalesce(p, F.lit(0.0)).alias("ratio"))


def in_text_rectangle(axis: DataFrame, boxes: DataFrame, keys: list[str], at: str, low: str, high: str) -> DataFrame:
    span = boxes.groupBy(*keys).agg(F.min(low).alias("_a"), F.max(high).alias("_b"))
    inside = F.col(at).between(F.col("_a"), F.col("_b"))
    return axis.join(span, keys, "left").withColumn("in_text", F.coalesce(inside, F.lit(True)).cast("long")).drop("_a", "_b")


def reading_order(words: DataFrame, keys: list[str], band: int = 15) -> DataFrame:
    """Fragments joined by bands of height, then from the left."""
    parts = F.array_sort(F.collect_list(F.struct(F.floor(F.col("t") / band).alias("y"), F.col("l").alias("x"), F.col("pos"), F.col("text"))))
    return words.groupBy(*keys).agg(F.concat_ws(" ", F.transform(parts, lambda p: p["text"])).alias("text"))


def with_table_ends(axis: DataFrame, ink: DataFrame, lines: DataFrame, keys: list[str], at: str = "y") -> DataFrame:
    """between_lines' rows with the stretches before the first and after the last text line judged:
    from the first inked row on, and up to the row after the last one, they separate; without ink,
    the last fifth of the first stretch and the first four fifths of the last one do. The half of each
    that touches the text counts to the text's line, and what follows from the lines is told anew.
    ink(keys, at): rows that are not white; lines(keys, seq, next_start_like, caps, next_caps)."""
    last = F.max("text_line").over(W.partitionBy(*keys))
    rows = axis.withColumn("_last", last).join(ink.select(*keys, at).distinct().withColumn("_ink", F.lit(1)), [*keys, at], "left")
    head, tail = F.col("text_line") == 0, (F.col("text_line") == F.col("_last")) & (F.col("text_line") > 0)
    one = W.partitionBy(*keys)
    pick = lambda f, where: f(F.when(where, F.col(at))).over(one)
    inked = F.col("_ink").isNotNull()
    rows = rows.withColumn("_h1", pick(F.max, head)).withColumn("_hi", pick(F.min, head & inked)).withColumn("_t0", pick(F.min, tail)).withColumn("_t1", pick(F.max, tail)).withColumn("_ti", pick(F.max, tail & inked))
    start = F.when(F.col("_hi") < F.col("_h1"), F.col("_hi")).otherwise(F.floor(F.col("_h1") / 5) * 4)
    end = F.coalesce(F.col("_ti") + 1, F.col("_t1") + 1 - F.floor((F.col("_t1") - F.col("_t0") + 1) / 5))
    rows = rows.withColumn("_s", start).withColumn("_e", end)
    between = F.when(head & (F.col(at) >= F.col("_s")), 1).when(tail & (F.col(at) <= F.col("_e")), 1).when(head | tail, 0).otherwise(F.col("between"))
    near_head = head & (F.col(at) >= F.col("_s") + F.floor((F.col("_h1") - F.col("_s")) / 2))
    near_tail = tail & (F.col(at) <= F.col("_t0") + F.floor((F.least("_e", "_t1") - F.col("_t0") + 1) / 2))
    line = F.when(near_head, 1).when(near_tail, F.col("_last") - 1).otherwise(F.col("text_line"))
    rows = rows.select(*keys, at, line.cast("long").alias("text_line"), between.cast("long").alias("between"))
    told = lines.select(*keys, F.col("seq").alias("text_line"), "next_start_like", "caps", "next_caps")
    rows, here = rows.join(told, [*keys, "text_line"], "left"), F.col("between") == 1
    like = F.when(here, F.coalesce("next_start_like", F.lit(0))).otherwise(F.lit(0))
    caps = F.when(here & F.col("caps").isNotNull(), X.inverted_capital_run(F.col("caps"), F.col("next_caps"))).otherwise(F.lit(0.0))
    return rows.select(*keys, at, "text_line", "between", like.alias("like_row_start"), caps.alias("caps_inverted"))
