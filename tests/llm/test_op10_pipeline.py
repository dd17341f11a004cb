import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as P
from tabloom.llm import language_id as L
from tabloom.llm import registry
from tabloom.llm._shared import stored
from tests.check_oracle import differences, tables

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = registry.QUERIES["op10_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_cases(spark, messy, no_docs):
    model = L.fit(messy)
    got = L.identify(messy, model)
    assert got.columns == [c for c in messy.columns if c != "score"] + ["lang_pred", "score", "rejected"]
    by = {r["doc_id"]: r for r in got.collect()}
    for i in (3, 4, 5, 6):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert by[7]["lang_pred"] == "de" and by[1]["lang_pred"] == "en" and got.count() == messy.count()
    assert L.fit(no_docs) == {} and L.identify(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in L.identify(messy, {}).collect()} == {"und"}


def test_narrow_margins_are_rejected():
    c = L.Classifier({"a": b" the house is red the door is green ", "b": b" the house is red the door is green "})
    assert c.judge("the house")[1] == 0.0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    seen = {}
    for name, stage in P.STAGES:
        after = stored(stage(spark, before, SF), name)
        seen[name] = (before, after)
        if name != P.STAGES[-1][0]:
            assert after.columns == columns
        before = after
    kept = {r["doc_id"] for r in seen["language_id"][1].select("doc_id").collect()}
    assert len(kept) >= 0.98 * docs.count()
    a, b = seen["simhash_near_dedup"]
    assert b.select("text").distinct().count() == b.count()  # no exact copies are left
    assert a.select("text").distinct().join(b.select("text"), "text", "left_anti").count() < 0.15 * a.count()
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = seen["decontamination"][1].select("text").collect()
    assert not any(i in r["text"] for r in clean for i in items if len(i.split()) >= 5)
    lost = seen["decontamination"][0].join(seen["decontamination"][1].select("doc_id"), "doc_id", "left_anti").collect()
    assert all(any(i.split()[3:6] == r["text"].split()[k : k + 3] for i in items for k in range(len(r["text"].split()))) for r in lost[:5])
    a, b = seen["pareto_mixing"]
    assert b.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
    a, b = seen["sharding"]
    n = [r["count"] for r in b.groupBy("shard").count().collect()]
    assert b.count() == a.count() and max(n) - min(n) <= 1 and b.columns == [*columns, "shard", "slot"]


def test_pipeline_cases(spark, messy):
    from tabloom.llm import decontaminate, mixing, sharding, simhash

    docs = messy
    for stage in (simhash.deduplicated, lambda d: decontaminate.decontaminated(d, spark.createDataFrame([(1, "nothing of this is in them")], "item_id long, text string")), mixing.mixed):
        docs = stored(stage(docs), "case")
        assert docs.columns == messy.columns
    assert sharding.sharded(docs).count() == docs.count()


def test_decontamination_is_fitted_on_every_passage(spark, tmp_path, monkeypatch):
    """The stage's own space: A'A of its normalised passages has their number, beyond any sample, as its trace."""
    from tabloom.llm import decontaminate as D

    spaces, fit = [], D.latent_space
    monkeypatch.setattr(D, "latent_space", lambda table, weight, n: spaces.append((fit(table, weight, n), weight, n)) or spaces[0][0])
    spark.createDataFrame([(1, "nothing of this is in them")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = F.transform(F.sequence(F.lit(1), F.lit(1280)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(40)).cast("string")))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    assert P.benchmark(spark, docs, str(tmp_path)).count() == 4000
    (space, weight, passages), some = spaces[0], np.unique(D.terms(" ".join(f"w{i}" for i in range(40))))
    u = (space[some] / weight[some, None]).astype(float)
    assert passages == 160_000 and abs((1 / np.linalg.eigvalsh(u @ u.T)).sum() - passages) < 0.002 * passages


@pytest.mark.parametrize("name", list(registry.SQL))
def test_sql(spark, name):
    assert differences(spark, tables(SF), registry.QUERIES[name], registry.SQL[name], SF) == ""
