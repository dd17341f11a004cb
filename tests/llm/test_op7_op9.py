import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabloom.llm import mixing as M
from tabloom.llm import sharding as S
from tabloom.llm._shared import unit_hash


def test_shards_are_even_and_mixed(spark):
    rows = [(i, f"text {i}", "hot" if i % 3 else f"s{i % 7}", 1) for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard long")
    got = S.interleave(df, ["doc_id"]).collect()
    sizes = Counter(r["shard"] for r in got)
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k]))
    for s, n in Counter(r["source"] for r in got).items():
        per = Counter(r["shard"] for r in got if r["source"] == s)
        assert all(n / 8 - 2 <= per[k] <= n / 8 + 2 for k in range(8))
    assert sorted(map(tuple, got)) == sorted(map(tuple, S.interleave(df.repartition(5), ["doc_id"]).collect()))


def test_shards_against_a_plain_ranking(spark):
    """Brute force: each source in order of its random numbers, all sources merged by fractional rank, cut evenly."""
    rows = [(i, "hot" if i % 3 else f"s{i % 7}" if i % 5 else None) for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    named = df.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    told = named.select("doc_id", "src", unit_hash(F.col("doc_id"), F.col("src"), seed=S.SEED).alias("u"), F.xxhash64("src").alias("h")).collect()
    order = []
    for s in {r["src"] for r in told}:
        own = sorted((r for r in told if r["src"] == s), key=lambda r: r["u"])
        order += [((k + 0.5) / len(own), r["h"], s, r["u"], r["doc_id"]) for k, r in enumerate(own)]
    want = {}
    for pos, x in enumerate(sorted(order)):
        shard = next(k for k in range(8) if pos < -(-(k + 1) * len(rows) // 8))
        want[x[4]] = (shard, pos - -(-shard * len(rows) // 8))
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in S.interleave(df, ["doc_id"], buckets=16).collect()} == want


def test_sharding_cases(spark, messy, monkeypatch):
    monkeypatch.setattr(S, "read_table", lambda *a: messy)
    got = S.op7_sharding(spark, "").collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in messy.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    whole = S.sharded(messy)
    assert whole.columns == [*messy.columns, "shard", "slot"] and whole.count() == messy.count()
    assert len({(r["shard"], r["slot"]) for r in whole.collect()}) == messy.count()
    assert S.sharded(messy.limit(0)).count() == 0


def plain_targets(sizes):
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    free, out, left = set(order), {}, 1.5 * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, None: 100}, {"a": 0, "b": 10}, {None: 5}, {f"s{i:02}": (i * 37) % 50 for i in range(40)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(None if s is None else "=" + s, n) for s, n in sizes.items()], "src string, source_size long").na.fill("", ["src"])
    got = {r["src"][1:] or None: r["target"] for r in M.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))
    assert M.targets(df.where("false")).count() == 0


def plain_mix(spark, rows):
    """Brute force of the whole query: {(id, source, size, nth): copies}. Only the random numbers are Spark's."""
    seen, named = Counter(), []
    for i, source, size in rows:
        named.append((i, source, size, seen[i, source, size]))
        seen[i, source, size] += 1
    df = spark.createDataFrame(named, "id long, source string, size long, nth long")
    u = {tuple(r)[:4]: r["u"] for r in df.withColumn("u", unit_hash(*[F.col(c) for c in df.columns], seed=M.SEED)).collect()}
    sizes = Counter()
    for _, source, size, _ in named:
        sizes[source] += size
    out = {}
    for source, target in plain_targets(sizes).items():
        own = [x for x in named if x[1] == source]
        whole = math.floor(target / sizes[source] + 1e-12) if sizes[source] else 0
        want = max(0.0, target - whole * sizes[source])
        x = {d: 2 ** (math.floor(math.log2(d[2] ** M.LEAN) * M.OCTAVE) / M.OCTAVE) for d in own if d[2]}
        p, certain = {}, set()
        while x and want and len(certain) < len(x):
            rest = [d for d in x if d not in certain]
            c = (want - sum(d[2] for d in certain)) / sum(x[d] * d[2] for d in rest)
            p = {d: 1.0 if d in certain else c * x[d] for d in x}
            more = {d for d in rest if p[d] > 1}
            if not more:
                break
            certain |= {d for d in rest if x[d] == max(x[e] for e in more)}
        odds = {d: u[d] / (1 - u[d]) / (q / (1 - q)) if q < 1 else 0.0 for d, q in p.items() if q > 0}
        taken, left = set(), want
        for d in sorted(odds, key=odds.get):
            if d[2] > left:
                break
            taken.add(d)
            left -= d[2]
        for _ in range(M.FILLS):
            best = min((d for d in odds if d not in taken and abs(d[2] - left) < left), key=lambda d: (abs(d[2] - left), odds[d]), default=None)
            if best:
                taken.add(best)
                left -= best[2]
        out |= {d: (whole + (d in taken) if d[2] else 0) for d in own}
    return out


def test_mix_against_brute_force(spark):
    rows = [(i, f"s{i % 5}" if i % 9 else None, 1 + i * i % 97 if i % 50 else 3000) for i in range(1500)]
    rows += [(7000, "r", 11)] * 40 + [(7001, "r", 0)] * 3 + [(None, "r", 5), (None, "r", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = M.pareto_copies(df, "doc_id", "size", "source").collect()
    want = plain_mix(spark, rows)
    assert {(r["id"], r["source"], r["size"], r["nth"]): r["copies"] for r in got} == want and len(got) == len(rows)
    for s, t in plain_targets({s: sum(r[2] for r in rows if r[1] == s) for s in {r[1] for r in rows}}).items():
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(t) and abs(sum(r["size"] * r["copies"] for r in own) - t) <= 0.02 * t
    again = M.pareto_copies(df.repartition(3), "doc_id", "size", "source").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_of_equal_rows_only_some_are_taken(spark):
    df = spark.createDataFrame([(1, "a", 100)] * 100 + [(2, "b", 50), (3, "c", 70)] * 9, "doc_id long, source string, size long")
    got = M.pareto_copies(df, "doc_id", "size", "source").where("source = 'a'").collect()
    assert abs(sum(r["size"] * r["copies"] for r in got) - got[0]["target"]) < 100 and {r["copies"] for r in got} == {1, 2}


def test_longer_texts_are_likelier(spark):
    rows = [(i, "many", 400 if i % 2 else 4) for i in range(4000)] + [(i, s, 2000) for i in range(40_000, 40_400) for s in ("bulk", "rest")]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = M.pareto_copies(df, "doc_id", "size", "source").where("source = 'many'").collect()
    n = Counter((r["size"], r["copies"]) for r in got)
    assert got[0]["target"] < got[0]["source_size"] and n[400, 1] > 5 * n[4, 1] > 0


def test_weights_raise_inclusion(spark):
    df = spark.createDataFrame([(i, "s", 1, 1.9 if i % 2 else 0.1) for i in range(2000)], "doc_id long, source string, size long, w double")
    got = M.pareto_copies(df, "doc_id", "size", "source", "w")
    n = Counter((r["w"], r["copies"]) for r in got.join(df.select(F.col("doc_id").alias("id"), "w"), "id").collect())
    assert n[1.9, 2] > 5 * n[0.1, 2] and n[1.9, 2] + n[0.1, 2] == 1000


def test_mixing_cases(spark, messy):
    out = M.mixed(messy)
    assert out.columns == messy.columns
    assert max(Counter(map(str, out.collect())).values()) <= 4  # two equal rows, twice each
    assert M.mixed(messy.limit(0)).count() == 0
