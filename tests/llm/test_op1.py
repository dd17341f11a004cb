import numpy as np
from pyspark.sql import functions as F

from tabloom.llm import permutation_index as P

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(ids, x, queries, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = u @ u[q]
        order = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != ids[q])
        out[ids[q]] = [i for _, i in order[:k]]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    x[500:1500] = x[500] + 0.05 * rng.standard_normal((1000, 32))  # a crowd of a third
    df = spark.createDataFrame([(i, v.tolist(), "r") for i, v in enumerate(x)], SCHEMA)
    got = P.search(df, df.where("vec_id % 50 = 0"), block=1000).collect()
    want = brute(list(range(3000)), x.astype(float), range(0, 3000, 50))
    hits = sum(r["vec_id"] in want[r["query_id"]] for r in got)
    assert hits >= 0.9 * 5 * len(want) and len(got) == 5 * len(want)
    for r in got:
        a, b = x[r["query_id"]].astype(float), x[r["vec_id"]].astype(float)
        assert abs(r["score"] - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_cases(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [0.0, 1.0], "a"), (3, [0.0, 1.0], "a"), (4, None, "a"), (5, [0.0, 0.0], "a"), (6, [float("nan"), 1.0], "a"), (7, [None, 1.0], "a"), (8, [], "a"), (None, [1.0, 0.0], "a"), (9, [float("inf"), 0.0], "a"), (50, [1.0, 0.0, 0.0], "a"), (100, [-1.0, 0.0], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = P.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 2), (0, 3), (0, 100), (100, 3), (100, 0), (100, 1), (100, 2)]
    more = df.unionByName(spark.createDataFrame([(150, [1.0, 2.0, 3.0], "b"), (151, [3.0, 2.0, 1.0], "b"), (100, [5.0, 0.0], "b")], SCHEMA))
    got = P.search(more, more.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 50] == [151, 150]  # lengths do not meet
    assert [r["vec_id"] for r in got if r["query_id"] == 100] == [3, 0, 1, 2]  # asks by the smaller of its vectors
    assert P.search(df.where("vec_id IS NULL"), df).count() == 0
    assert P.search(df, df.where(F.lit(False))).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    """Equal vectors have equal scores wherever they stand: copies over several sizes of table."""
    for n in (38, 61, 700):
        rng = np.random.default_rng(n)
        x = rng.standard_normal((n, 24))
        copies = np.sort(rng.choice(np.arange(1, n), 11, replace=False))
        x[copies] = x[0] + 0.01 * x[copies[0]]
        df = spark.createDataFrame([(int(i), v.tolist(), "r") for i, v in enumerate(x)], "vec_id long, embedding array<double>, rank string")
        got = [r["vec_id"] for r in P.search(df, df.where("vec_id = 0"), block=100).orderBy("rank").collect()]
        assert got == [int(i) for i in copies[:5]], n


def test_results_do_not_depend_on_layout(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist(), "r") for i, v in enumerate(rng.standard_normal((1500, 16)))], SCHEMA)
    a, b = (sorted(map(tuple, P.search(d, d.where("vec_id % 50 = 0"), block=400).collect())) for d in (df, df.orderBy(F.desc("vec_id")).repartition(3)))
    assert a == b
