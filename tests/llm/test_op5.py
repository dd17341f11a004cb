import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import decontaminate as D


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_against_dynamic_programme():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(90))] for _ in range(2))
        assert D.lcs_length(a, b) == lcs(a, b)


def corpus(spark):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in ("a", "e", "io", "u") for c in ("n", "rt", "ls", "m")]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.randrange(15, 60))) for i in range(20)] + [(20, None), (21, "nowhere found here"), (22, text(700))]
    docs = [(i, text(rng.randrange(1, 400))) for i in range(300)]
    want = set()
    for i in range(0, 46, 2):
        item = items[(i // 2) % 20] if i < 40 else items[22]
        w = item[1].split()
        if i % 4:  # a paraphrase: one word in eight replaced, some left out
            w = [rng.choice(words) if k % 8 == 3 else x for k, x in enumerate(w) if k % 15 != 14]
        docs[i] = (i, f"{text(rng.randrange(80))} {' '.join(w).upper()}, {text(rng.randrange(80))}")
        want.add((i, item[0]))
    docs += [(400, None), (401, ""), (402, docs[0][1]), (402, docs[0][1]), (None, docs[0][1])]
    want |= {(402, 0), (None, 0)}
    d = spark.createDataFrame([(*x, "extra", 1.0) for x in docs], "doc_id long, text string, ids string, cosine double")
    return d, spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, key string"), want


def test_finds_copies_and_paraphrases_and_nothing_else(spark):
    docs, items, want = corpus(spark)
    got = {(r["id"], r["item_id"]) for r in D.find(docs, items).collect()}
    assert got == want
    left = D.decontaminated(docs, items)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}


def test_short_items_are_found_word_by_word(spark):
    docs = [(1, "so Too, short!"), (2, "too long and short"), (3, "w " * 30 + "too short " + "v " * 30), (4, "too"), (5, None)]
    items = [(1, "too short"), (2, "short"), (3, ""), (4, "!"), (5, None), (6, "w w w w")]
    df, of = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["id"], r["item_id"], r["leak"]) for r in D.find(df, of).collect()} == {(1, 1, True), (1, 2, True), (2, 2, True), (3, 1, False), (3, 2, False), (3, 6, False)}
    assert {r["doc_id"] for r in D.decontaminated(df, of).collect()} == {3, 4, 5}


def test_very_long_texts(spark):
    item = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, "x y z " * 100_000 + item + " a b c" * 100_000), (2, "x y z " * 100_000)], "doc_id long, text string")
    assert [r["id"] for r in D.find(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [1]


def test_query_against_all_windows(spark):
    """Brute force: every window of every document is checked, without a search for candidates."""
    docs, items, _ = corpus(spark)
    got = {(r["id"], r["item_id"]) for r in D.find(docs, items).collect()}
    want = set()
    for r in docs.collect():
        d = D.terms(r["text"]).tolist()
        for x in items.collect():
            t = D.terms(x["text"]).tolist()
            if 5 <= len(t) <= D.LONGEST:
                w, margin = D.window_of(len(t)), len(t) // 2 + D.STEP
                for a in range(0, len(d), D.STEP):
                    part = d[max(0, a - margin) : a + w + margin]
                    if lcs(t, part) >= D.LCS_SHARE * len(t) and lcs(t[-D.ANSWER_WORDS :], part) >= D.ANSWER_SHARE * min(len(t), D.ANSWER_WORDS):
                        want.add((r["doc_id"], x["item_id"]))
                        break
    missed, more = want - got, {g for g in got if g[1] < 21} - want
    assert len(missed) <= 0.05 * len(want) and not more


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items, want = corpus(spark)
    monkeypatch.setattr(D, "ITEM_BLOCK", 7)
    assert {(r["id"], r["item_id"]) for r in D.find(docs, items).collect()} == want


def test_empty(spark):
    docs, items, _ = corpus(spark)
    assert D.find(docs.limit(0), items).count() == 0 and D.find(docs, items.limit(0)).count() == 0


def fitted(spark, texts):
    """The latent space of texts (column text), the weights and the number of passages, as find() makes them."""
    table = D.stored(D.read_terms(texts.withColumn("doc_id", F.lit(1)), "doc_id", "text"), "terms")
    df = np.zeros(D.TERMS + 1)
    for r in table.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weight = np.log((1 + df[D.TERMS]) / (1 + df[: D.TERMS]))
    return D.latent_space(table, weight, int(df[D.TERMS])), weight, int(df[D.TERMS])


def dense(texts, weight):
    """A'A of the normalised passages among the terms that weigh something, one passage after another."""
    known = {int(t) for x in texts for t in D.terms(x) if weight[t] > 0}
    at, out = {t: i for i, t in enumerate(sorted(known))}, np.zeros((len(known), len(known)))
    for ids in map(D.terms, texts):
        for k in range(0, len(ids), D.PASSAGE):
            a = np.zeros(len(at))
            for t in ids[k : k + D.PASSAGE].tolist():
                if t in at:
                    a[at[t]] += weight[t]
            out += np.outer(a, a) / max(a @ a, 1e-24)
    return sorted(at), out


@pytest.mark.parametrize("block", [1 << 15, 7])
def test_space_against_dense_matrix(spark, monkeypatch, block):
    """Repeats within a passage, short last passages, a text of several blocks, a term in more places than one product holds."""
    monkeypatch.setattr(D, "FIT_BLOCK", block, raising=False)
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(30)], [1 / (i + 1) for i in range(30)], k=rng.randrange(1, 200))) for _ in range(150)]
    texts += [" ".join(["w3 w3 w5"] * 3000), "rare " * 9000, "w1", "", None]
    space, weight, _ = fitted(spark, spark.createDataFrame([(x,) for x in texts], "text string"))
    some, gram = dense(texts, weight)
    # fewer terms than dimensions: space space' is the weighted inverse of A'A
    got = (space[some] / weight[some, None]) @ (space[some] / weight[some, None]).T
    assert np.allclose(got @ gram, np.eye(len(some)), atol=2e-3)


def test_space_is_fitted_on_every_passage(spark):
    """A'A of normalised passages has their number as its trace; there are more here than a sample of 120,000."""
    words = F.transform(F.sequence(F.lit(1), F.lit(1280)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(40)).cast("string")))
    space, weight, passages = fitted(spark, spark.range(4000).select(F.array_join(words, " ").alias("text")))
    some = np.flatnonzero((weight > 0) & np.isin(np.arange(D.TERMS), D.terms(" ".join(f"w{i}" for i in range(40)))))
    u = (space[some] / weight[some, None]).astype(float)
    trace = (1 / np.linalg.eigvalsh(u @ u.T)).sum()
    assert passages == 160_000 and abs(trace - passages) < 0.002 * passages


def test_windows_do_not_depend_on_the_documents_beside_them():
    rng = np.random.default_rng(7)
    space = rng.standard_normal((D.TERMS, D.RANK)).astype(np.float32)
    items = [(i, x, x[-8:]) for i, x in enumerate(rng.integers(0, D.TERMS, n).tolist() for n in (20, 60, 250, *[30] * 70))]
    # a fifth of the words put in, so that hits depend on where windows begin
    docs = [np.r_[rng.integers(0, D.TERMS, 13 * i % 90), np.insert(x, range(4, len(x), 5), 1), rng.integers(0, D.TERMS, 50)].astype(np.uint16) for i, x, _ in items]
    search = D.Searcher(space, items, D.COSINE)
    alone = {(i, *x[1:]) for i, d in enumerate(docs) for x in search.hits([d])}
    assert {x[:2] for x in alone} == {(i, i) for i in range(len(items))}
    together = {x[:2]: x for x in search.hits(docs)}
    assert together.keys() == {x[:2] for x in alone} and all(np.isclose(together[x[:2]][2], x[2], atol=1e-5) and together[x[:2]][3:] == x[3:] for x in alone)


def test_driver_holds_few_matrices_of_the_terms(spark):
    """The fit's own memory on the driver: a matrix of terms x RANK, what a partition of it takes to arrive, no copies in double precision."""
    tracemalloc.start()
    try:
        fitted(spark, spark.createDataFrame([(f"some words w{i} of v{i} text",) for i in range(300)], "text string"))
        assert tracemalloc.get_traced_memory()[1] < 3 * 4 * D.TERMS * D.RANK
    finally:
        tracemalloc.stop()
