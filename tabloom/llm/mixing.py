"""Mixing sources to target weights by Pareto order sampling.

Targets in words: the mixture's size is shared among the sources by weight; a target stops at
`most` times its source's size and what is above is shared again by weight among the others.
A source that needs r times its words gives floor(r) certain whole copies of every document. What
is left, `want` words, is a sample without replacement of unequal probabilities: a document's
inclusion probability is p = min(1, c x), x being its relative weight (a weight column, else its
size to the power `LEAN`: longer texts are likelier) and c such that the expected words, the
sum of p times size, are those wanted. Weights are held in classes of 1/`OCTAVE` of a doubling, so
that a source has a bounded number of them and c comes from their sums. Documents whose p is 1 are
certain. Each gets a uniform number u from its id and the rank variable odds(u) / odds(p);
those with the smallest are taken while they stay within the wanted words: a Pareto order
sample of fixed size in words. The gap, less than the next document, is closed by at most `FILLS`
documents a source, each that whose size is nearest to the gap, the first in rank if several are.

No task orders a source: rank variables are added up in `CELLS` cells, and only the cell in which
the wanted words are reached is put in order, about one in `CELLS` of a source's documents. Of the
sources themselves one row each is put in order. Nothing is collected, texts are not moved.

Defined results: source null -> a source of its own, last; text null or blank -> size 0, no copy,
taken 0; weight null, zero or below -> the certain copies only; a source without words -> target 0;
repeated rows -> numbered, each with a random number of its own; empty table -> empty result;
doc_id null -> an id like any other; extra columns are ignored here, kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.llm._shared import WORD_PATTERN, read_table, stored, unit_hash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
LEAN = 0.5
OCTAVE = 16
CELLS = 1 << 14
FILLS = 3
SEED = 4242
#: Equal rows that are numbered at a time.
RUN = 1 << 16


def n_words(col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_key(col: str) -> Column:
    """A source's name as a key without nulls."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sizes(src, source_size) -> src, source_size, target: words wanted of each source. Weights go
    round over the sources by code point, null last. Sources in order of what a unit of weight may
    bring at most; the first that need not stop there tells what a unit brings to all after it."""
    named = sizes.withColumn("_nth", F.row_number().over(W.orderBy(F.col("src") == "", "src")) - 1)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    named = named.withColumn("_w", F.get(listed, F.col("_nth") % len(weights))).withColumn("_cap", F.lit(most) * F.col("source_size"))
    before = W.orderBy(F.col("_cap") / F.col("_w"), "src").rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    budget = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    named = named.withColumn("_unit", budget / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    open_ = F.when(F.col("_unit") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("src"), F.col("_unit").alias("unit")))
    unit = F.min(open_).over(whole)["unit"]
    return named.select("src", "source_size", F.coalesce(F.least(unit * F.col("_w"), F.col("_cap")), F.col("_cap")).alias("target"))


def weight_class(x: Column) -> Column:
    return F.floor(F.log2(x) * OCTAVE).cast("int")


def inclusion(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs(src, size, class), plan(src, _want) -> src, _c: the factor that makes weights
    inclusion probabilities. A row for each source and class is put in order, `OCTAVE` a doubling."""
    x = F.pow(F.lit(2.0), F.col("class") / OCTAVE)
    sums = docs.where("class IS NOT NULL").groupBy("src", "class").agg(F.sum("size").cast("double").alias("_s"))
    down = W.partitionBy("src").orderBy(F.desc("class"))
    above = F.coalesce(F.sum("_s").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(x * F.col("_s")).over(down.rowsBetween(0, W.unboundedFollowing))
    found = sums.join(plan.select("src", "_want"), "src").withColumn("_c", (F.col("_want") - above) / rest)
    # classes above the first whose probability is 1 at most are certain
    return found.where(F.col("_c") * x <= 1).groupBy("src").agg(F.max(F.struct("class", "_c"))["_c"].alias("_c"))


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys plus nth (from 0): equal rows, counted before they are shuffled, told apart."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    runs = groups.select(*keys, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))).alias("_run"))
    return runs.select(*keys, F.explode(F.sequence(F.col("_run") * RUN, F.least(F.col("_n"), (F.col("_run") + 1) * RUN) - 1)).alias("nth"))


def pareto_copies(rows: DataFrame, id_col: str, size_col: str, source_col: str, weight_col: str | None = None, seed: int = SEED, fills: int = FILLS) -> DataFrame:
    """id, source, size, nth, source_size long, target double and copies long of every row."""
    weight = F.col(weight_col).cast("double") if weight_col else F.pow(F.col(size_col).cast("double"), F.lit(LEAN))
    slim = rows.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), source_key(source_col).alias("src"), F.col(size_col).cast("long").alias("size"), F.when((F.col(size_col) > 0) & (weight > 0), weight_class(weight)).alias("class"))
    docs = stored(numbered(slim, ["id", "source", "src", "size", "class"]), "mixing")
    sizes = docs.groupBy("src").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("_whole", F.floor(ratio + 1e-12).cast("long"))
    plan = stored(plan.withColumn("_want", F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0))), "targets")
    plan = stored(plan.join(inclusion(docs, plan), "src", "left"), "targets")
    # without a factor more words are wanted than there are: all are certain
    x = F.coalesce("_c", F.lit(float("inf"))) * F.pow(F.lit(2.0), F.col("class") / OCTAVE)
    p = F.when(F.col("class").isNotNull(), F.least(x, F.lit(1.0))).otherwise(F.lit(0.0))
    u = unit_hash(F.col("id"), F.col("source"), F.col("size"), F.col("nth"), seed=seed)
    # odds(u) / odds(p) as q / (1 + q), which lies between 0 (certain) and 1 (never)
    at = u * (1 - p) / (u * (1 - p) + (1 - u) * p)
    ranked = docs.join(plan, "src").withColumn("_p", p).withColumn("_at", F.when(F.col("_p") > 0, at))
    ranked = ranked.withColumn("_cell", F.least(F.floor(F.col("_at") * CELLS), F.lit(CELLS - 1)).cast("int")).withColumn("_tie", F.xxhash64("id", "size", "nth"))
    ranked = stored(ranked.drop("class", "_c", "_p"), "mixing")

    # the cell in which a source's words are reached, and the words before it
    cells = ranked.where("_cell IS NOT NULL").groupBy("src", "_cell", "_want").agg(F.sum("size").alias("_s"))
    cells = cells.withColumn("_end", F.sum("_s").over(W.partitionBy("src").orderBy("_cell")))
    last = cells.where(F.col("_end") > F.col("_want")).groupBy("src").agg(F.min(F.struct(F.col("_cell"), (F.col("_end") - F.col("_s")).alias("before"))).alias("_l"))
    last = stored(last.select("src", F.col("_l._cell").alias("_last"), F.col("_l.before").alias("_before")), "cells")
    cut = ranked.join(last, "src", "left")
    inside = cut.where(F.col("_cell") == F.col("_last"))
    inside = inside.withColumn("_end", F.col("_before") + F.sum("size").over(W.partitionBy("src").orderBy("_at", "_tie", "id", "nth").rowsBetween(W.unboundedPreceding, 0)))
    # of that cell only what follows the last document within the words is told apart
    edge = inside.where(F.col("_end") > F.col("_want")).groupBy("src").agg(F.min(F.struct("_at", "_tie", "nth")).alias("_edge"))
    edge = stored(edge, "cells")
    own = F.struct("_at", "_tie", "nth")
    out = ranked.join(edge, "src", "left").withColumn("_take", F.col("_cell").isNotNull() & (F.col("_edge").isNull() | (own < F.col("_edge"))))
    out = stored(out.drop("_edge", "_cell"), "mixing")

    # one document at a time, of the size nearest to the gap
    taken = out.where("_take").groupBy("src").agg(F.sum("size").alias("_got"))
    gaps = stored(plan.select("src", "_want").join(taken, "src", "left").select("src", (F.col("_want") - F.coalesce("_got", F.lit(0))).alias("_gap")), "gaps")
    picks: DataFrame | None = None
    for _ in range(fills):
        free = out.where("NOT _take AND _at IS NOT NULL AND size > 0")
        if picks is not None:
            free = free.join(picks.select("src", "_tie", "nth"), ["src", "_tie", "nth"], "left_anti")
        off = F.abs(F.col("size") - F.col("_gap"))
        best = free.join(gaps, "src").where(off < F.col("_gap")).groupBy("src").agg(F.min(F.struct(off.alias("off"), F.col("_at"), F.col("_tie"), F.col("id"), F.col("nth"), F.col("size"))).alias("_b"))
        best = stored(best.select("src", "_b._tie", "_b.id", "_b.nth", "_b.size"), "picks")
        gaps = stored(gaps.join(best.select("src", "size"), "src", "left").select("src", (F.col("_gap") - F.coalesce("size", F.lit(0))).alias("_gap")), "gaps")
        picks = best.drop("size") if picks is None else stored(picks.unionByName(best.drop("size")), "picks")
    if picks is not None:
        # ids may be null, which no equality finds
        marks = picks.select("src", "_tie", F.col("id").alias("_id"), "nth", F.lit(True).alias("_pick"))
        on = [out[c] == marks[c] for c in ("src", "_tie", "nth")] + [out["id"].eqNullSafe(marks["_id"])]
        cond = on[0] & on[1] & on[2] & on[3]
        out = out.join(marks, cond, "left").select(*[out[c] for c in out.columns if c != "_take"], (out["_take"] | F.coalesce("_pick", F.lit(False))).alias("_take"))
    copies = F.when(F.col("size") > 0, F.col("_whole") + F.col("_take").cast("long")).otherwise(F.lit(0).cast("long"))
    return out.select("id", "source", "size", "nth", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mixture takes it. Texts are shuffled once; rows equal in
    every column are one there, and come out as often as they are taken together."""
    key = F.xxhash64(*docs.columns)
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("_key")).dropDuplicates(["_key"])
    slim = docs.select(key.alias("_key"), F.col(source_col).cast("string").alias("_source"), n_words(text_col).alias("_size"))
    copies = pareto_copies(slim, "_key", "_size", "_source", seed=seed).where("copies > 0").groupBy(F.col("id").alias("_key")).agg(F.sum("copies").alias("_copies"))
    runs = rows.join(copies, "_key").select("row", "_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / RUN))).alias("_run"))
    return runs.select("row", F.explode(F.sequence(F.col("_run") * RUN, F.least(F.col("_copies"), (F.col("_run") + 1) * RUN) - 1)).alias("_nth")).select("row.*")


def op9_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = pareto_copies(docs.select("doc_id", "source", n_words("text").alias("size")), "doc_id", "size", "source")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
