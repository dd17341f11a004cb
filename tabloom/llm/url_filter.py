"""URL filtering by a path-template tree learned per host.

Hosts' paths become nodes of a tree down to their last segment, however deep. What all paths of a node
begin with is taken in one step; where they part, under each template so far,

* a segment is generalised to the wildcard `*` if it is numeric or holds digits, or if its siblings
  are so many and so rarely repeated that the position is variable;
* the siblings left fall into thirds by the share of blocked among their labelled pages, and those of
  a third whose share differs from that of the others in it by less than the Hoeffding bound of both
  counts merge into one branch, `~` and the third: branches that look alike statistically become one
  template. Segments that begin with one of these signs or `=` get a `=` before them.

Labels are the verdicts of the stated rules on the pages that a rule covers. A template's purity
is its blocked share smoothed by its parent's (`STRENGTH` pseudo-pages), a root's by that of the
same template over all hosts, that by the overall share (nodes at which no paths part are one). A page without rule is blocked if its
deepest template's purity exceeds `REJECT`. The tables of a level have a row per host, template
and segment, added up before the shuffle; pages meet them by joins that skew handling can split.

Defined results: url null or without `://` -> host and path empty, no rule, judged by the overall
share; empty path -> the root; repeated rows -> one result each; empty table -> empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm._shared import read_table, stored

#: (verdict, host, path): a rule fits its host and its subdomains; the longest wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A position is variable from so many different segments on, if so few pages share one on average.
VARIABLE_VALUES, VARIABLE_SHARE = 12, 4.0
#: Chance that branches with one true share are told apart.
ALPHA = 0.05
STRENGTH = 4.0
REJECT = 0.5


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    return rows.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("verdict"))


def _plain(seg: Column) -> Column:
    return F.when(seg.contains("#"), F.lit("*")).otherwise(F.regexp_replace(seg, "^([*~=])", "=$1"))


def template_tree(rows: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """Paths of rows(host, path, verdict) -> (host, shape, template, m labelled, b blocked, own, rest): the
    purity of a shape is own + rest * that of its template over all hosts.

    Works on distinct (host, path) shapes with their counts, whose digits are already one sign,
    so that a host's numbered pages are one row. Each round takes all nodes to where their paths part.
    """
    shape = F.regexp_replace("path", "[0-9]+", "#")
    shapes = rows.groupBy("host", shape.alias("shape")).agg(F.count("*").alias("n"), F.count("verdict").alias("m"), F.coalesce(F.sum((F.col("verdict") == "block").cast("long")), F.lit(0)).alias("b"))
    parts = F.split(F.regexp_replace("shape", "^/", ""), "/")
    columns = ["host", "shape", "parts", "template", "n", "m", "b", "own", "rest"]
    left = stored(shapes.withColumn("parts", parts).withColumn("template", F.lit("")).withColumn("own", F.lit(0.0)).withColumn("rest", F.lit(1.0)).select(columns), "shapes")
    done: list[DataFrame] = []
    while not done or not left.isEmpty():
        # the smallest and the largest of a node's paths part where all do
        node = left.groupBy("host", "template").agg(F.min("parts").alias("lo"), F.max("parts").alias("hi"), F.sum("m").alias("tm"), F.sum("b").alias("tb"))
        parted = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), F.lit(False))
        node = node.select("host", "template", "tm", "tb", F.when(parted == 0, F.size("lo")).otherwise(parted - 1).cast("int").alias("k"))
        met = left.join(node, ["host", "template"]).withColumn("own", (F.col("tb") + strength * F.col("own")) / (F.col("tm") + strength)).withColumn("rest", strength * F.col("rest") / (F.col("tm") + strength))
        begin = F.transform(F.slice("parts", F.lit(1), F.col("k")), lambda x: F.concat(F.lit("/"), _plain(x)))
        met = met.withColumn("template", F.concat("template", F.array_join(begin, ""))).withColumn("parts", F.slice("parts", F.col("k") + 1, F.size("parts")))
        met = stored(met.select(columns), "shapes")
        done.append(met.where(F.size("parts") == 0).drop("parts"))
        seg = F.get("parts", F.lit(0))
        further = met.where(F.size("parts") > 0).withColumn("seg", seg)
        by = further.groupBy("host", "template", "seg").agg(*[F.sum(c).alias(c) for c in "nmb"]).withColumn("third", F.when(F.col("m") > 0, F.least(F.floor(3 * F.col("b") / F.col("m")), F.lit(2))))
        # totals of the siblings come by joins: a window would bring a hot host into one task
        of_all = by.groupBy("host", "template").agg(F.count("*").alias("values"), F.sum("n").alias("all_n"))
        of_third = by.where("third IS NOT NULL").groupBy("host", "template", "third").agg(F.count("*").alias("alike"), F.sum("m").alias("all_m"), F.sum("b").alias("all_b"))
        by = by.join(of_all, ["host", "template"]).join(of_third, ["host", "template", "third"], "left")
        variable = F.col("seg").contains("#") | ((F.col("values") >= VARIABLE_VALUES) & (F.col("all_n") < VARIABLE_SHARE * F.col("values")))
        own, others = F.col("m"), F.col("all_m") - F.col("m")
        apart = F.abs(F.col("b") / own - (F.col("all_b") - F.col("b")) / others)
        bound = F.lit(math.sqrt(math.log(2 / ALPHA) / 2)) * (1 / F.sqrt(own) + 1 / F.sqrt(others))
        alike = (F.col("alike") > 1) & (own > 0) & (others > 0) & (apart < bound)
        wild = by.select("host", "template", "seg", F.when(variable, "*").when(alike, F.concat(F.lit("~"), F.col("third").cast("string"))).otherwise(_plain(F.col("seg"))).alias("to"))
        further = further.join(wild, ["host", "template", "seg"])
        further = further.withColumn("template", F.concat_ws("/", "template", "to")).withColumn("parts", F.slice("parts", F.lit(2), F.size("parts")))
        left = stored(further.select(columns), "shapes")
    out = done[0]
    for table in done[1:]:
        out = out.unionByName(table)
    return out.drop("n")


def purity(shapes: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """(host, shape, template, purity): the blocked share of each template, smoothed by its
    parent's, the root's by the template's share over all hosts."""
    whole = shapes.agg(((F.coalesce(F.sum("b"), F.lit(0)) + 1) / (F.coalesce(F.sum("m"), F.lit(0)) + 2)).alias("overall"))
    shared = shapes.groupBy("template").agg(F.sum("m").alias("gm"), F.sum("b").alias("gb")).crossJoin(F.broadcast(whole))
    shared = shared.select("template", ((F.col("gb") + strength * F.col("overall")) / (F.col("gm") + strength)).alias("p"))
    return shapes.join(shared, "template").select("host", "shape", "template", (F.col("own") + F.col("rest") * F.col("p")).alias("purity"))


def judged(rows: DataFrame) -> DataFrame:
    """rows(page_id, host, path, rule, verdict) with verdict complete, plus template and purity."""
    known = purity(template_tree(rows))
    out = rows.withColumn("shape", F.regexp_replace("path", "[0-9]+", "#")).join(known, ["host", "shape"])
    verdict = F.coalesce("verdict", F.when(F.col("purity") > REJECT, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(parsed(read_table(spark, sf_dir, "pages")))
