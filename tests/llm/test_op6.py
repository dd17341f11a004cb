import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tabloom.llm import simhash as S
from tabloom.llm._shared import components


def plain_fingerprint(text, k=4):
    w = [] if text is None else text.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, most=4):
    lab = np.arange(len(fps))
    u = np.array(fps, np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None]) <= most
    while True:
        new = np.where(near, lab[None], len(fps)).min(1)
        if (new == lab).all():
            return lab
        lab = new


def test_code_is_perfect():
    _, count, near = S.golay_tables()
    weights = [int(x).bit_count() for x in near[:, 0]]
    assert sorted(set(weights)) == [0, 1, 2, 3] and [int(count[i]) for i in range(2048) if weights[i] == 3] == [6] * 1771


@pytest.mark.parametrize("run", [4096, 3])
def test_links_against_all_pairs(spark, run):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2**64, 300, dtype=np.uint64)]
    for _ in range(700):  # every distance, chains, a crowd
        x = fps[int(rng.integers(0, len(fps)))] if rng.random() < 0.7 else fps[0]
        for b in rng.choice(64, int(rng.integers(1, 9)), replace=False):
            x ^= 1 << int(b)
        fps.append(x)
    fps = sorted(set(fps), key=fps.index)
    df = spark.createDataFrame([(int(v),) for v in S.signed(fps)], "fp long")
    comp = {r["node"]: r["root"] for r in components(S.link_exact(df, run)).collect()}
    got = [comp.get(int(v), int(v)) for v in S.signed(fps)]
    want = plain_components(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_query_against_brute_force(spark, messy, monkeypatch):
    monkeypatch.setattr(S, "read_table", lambda *a: messy)
    rows = S.op6_simhash_golay(spark, "").collect()
    texts = [(r["doc_id"], r["text"]) for r in messy.collect()]
    fps = [plain_fingerprint(t) for _, t in texts]
    lab = plain_components(fps)
    name = {x: min((i for (i, _), y in zip(texts, lab) if y == x and i is not None), default=None) for x in set(lab)}
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, rows)) == sorted(key((i, f"{f:016x}", name[x])) for (i, _), f, x in zip(texts, fps, lab))


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(str(i * i) for i in range(5000))
    monkeypatch.setattr(S, "BLOCK", 700)
    assert S.fingerprint(text) == plain_fingerprint(text)


def test_near_duplicates_stage(spark):
    rng = np.random.default_rng(9)
    base = [[f"w{int(x)}" for x in rng.integers(0, 3000, 200)] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(30):  # near copies: two words of 200 changed, five-word similarity about 0.9
        w = list(base[i])
        for at in (30 + i, 150):
            w[at] = "changed"
        rows += [(100 + i, " ".join(w)), (200 + i, " ".join(base[i]).upper())]
    rows += [(300, None), (301, ""), (302, "!"), (303, "!"), (None, "alone"), (None, "alone"), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, h string, node long")
    left = S.deduplicated(df)
    assert left.columns == df.columns
    assert sorted((str(r["doc_id"]) for r in left.collect()), key=str) == sorted([*map(str, range(60)), "300", "302", "None"], key=str)
    assert S.deduplicated(df.where(F.lit(False))).count() == 0
    named = df.where("doc_id < 210 OR doc_id IS NULL").withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id").cast("string")))
    assert S.deduplicated(named).count() == 61


def test_similar_groups_against_exact_similarity(spark):
    """Copies on both sides of the threshold: groups are those of the exact Jaccard similarity."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(60):
        base = [f"w{int(x)}" for x in rng.integers(0, 2000, int(rng.integers(40, 400)))]
        rows.append(" ".join(base))
        for changes in (1, 2, 3, 5, 8):
            w = list(base)
            for at in rng.integers(0, len(w), changes):
                w[int(at)] = f"n{int(at)}"
            rows.append(" ".join(w))
    sets = []
    for t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    lab = list(range(len(rows)))
    for _ in rows:
        new = [min(lab[j] for j in range(i // 6 * 6, i // 6 * 6 + 6) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(len(rows))]
        if new == lab:
            break
        lab = new
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in S.similar_components(df).collect()}
    assert len(set(lab)) > 100 and sum(got[i] != lab[i] for i in range(len(rows))) <= 3


def test_large_groups_are_linked_without_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = [f"w{int(x)}" for x in rng.integers(0, 3000, 300)]
    rows = []
    for i in range(400):
        w = list(base)
        w[int(rng.integers(0, 300))] = f"new{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = S.similar_components(df, run=50)
    assert {r["component_id"] for r in groups.collect()} == {0} and groups.count() == 400


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(4)
    names = rng.permutation(400)
    edges = [(int(names[i]), int(names[i + 1])) for i in range(200)] + [(int(names[250]), int(names[j])) for j in range(251, 380)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[int(names[i])] for i in range(201)} == {int(min(names[:201]))}
    assert {got[int(names[i])] for i in range(250, 380)} == {int(min(names[250:380]))}


def left_groups(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in S.similar_components(df).collect()}
    return [got[i] for i in range(len(texts))]


def test_crowd_similar_to_one_base_only(spark):
    """A star: every copy is at 0.8 or more to the base, most pairs of copies are not."""
    rng = np.random.default_rng(31)
    base = [f"w{int(x)}" for x in rng.integers(0, 100000, 200)]
    rows = [" ".join(base)]
    for i in range(2000):
        w = list(base)
        for j, at in enumerate(rng.choice(np.arange(5, 195, 6), 4, replace=False)):
            w[int(at)] = f"new{i}x{j}"
        rows.append(" ".join(w))
    rng.shuffle(rows)
    assert len(set(left_groups(spark, rows))) == 1


def test_repeated_lines_do_not_join(spark):
    rng = np.random.default_rng(33)
    line = [f"l{i}" for i in range(12)]
    unlike = [" ".join([f"w{int(x)}" for x in rng.integers(0, 100000, 60)] + line * 40) for _ in range(60)]
    assert len(set(left_groups(spark, unlike))) == 60


def test_appended_cut_and_short_texts_are_found(spark):
    rng = np.random.default_rng(32)
    rows = []
    for words, more in ((200, 48), (200, 40), (200, 30), (30, 6), (30, 3), (9, -1), (40, -7)):
        for _ in range(100):
            w = [f"w{int(x)}" for x in rng.integers(0, 100000, words)]
            rows += [" ".join(w), " ".join(w[:more] if more < 0 else w + [f"m{int(x)}" for x in rng.integers(0, 100000, more)])]
    got = left_groups(spark, rows)
    assert sum(got[i] != got[i + 1] for i in range(0, len(rows), 2)) == 0 and len(set(got)) == len(rows) // 2


def test_repeated_lines_do_not_part(spark):
    rng = np.random.default_rng(34)
    rows = []
    for _ in range(60):
        w = [f"w{int(x)}" for x in rng.integers(0, 100000, 150)]
        rows += [" ".join(w), " ".join(w + w[-12:] * 11)]
    got = left_groups(spark, rows)
    assert sum(got[i] != got[i + 1] for i in range(0, 120, 2)) == 0 and len(set(got)) == 60


def test_no_candidate_is_left_unchecked():
    """Many pairs just below the similarity, whatever their number: the second round ties all their roots."""
    rng = np.random.default_rng(35)
    key = np.repeat(np.arange(3), (10, 64, 300))
    node, root, much = np.arange(len(key)), rng.integers(1000, 1200, len(key)), rng.integers(90, 120, len(key))
    words = rng.integers(0, 2**64, (30, 4), dtype=np.uint64)[root % 30] ^ (rng.integers(0, 2**64, (len(key), 4), dtype=np.uint64) & rng.integers(0, 2**64, (len(key), 4), dtype=np.uint64) & rng.integers(0, 2**64, (len(key), 4), dtype=np.uint64))
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (key, node, root, much, *words.view(np.int64).T)], names=["key", "node", "root", "much", "w0", "w1", "w2", "w3"])
    got = [p for b in S._candidates(True, 56, 64)(iter([rows.slice(0, 50), rows.slice(50)])) for p in zip(*b.to_pydict().values(), strict=True)]
    near = (S.differing(words[:, None], words[None]) <= 56) & (key[:, None] == key) & (root[:, None] != root) & (np.minimum(much[:, None], much) >= 0.8 * np.maximum(much[:, None], much) - 1e-9)
    x, y = np.nonzero(near)
    names = np.arange(2000)
    want, lab = S._rooted(2000, root[x], root[y]), S._rooted(2000, *(np.array(c) for c in zip(*got)))
    assert (want == lab).all() and len(got) == len(set(root)) - len(set(lab[root])) > 50 and len(names) == 2000


def jaccard_groups(sets, lab):
    """Brute force: groups after links of similarity 0.8 between all pairs."""
    lab = np.array(lab)
    while True:
        new = np.array([min(lab[j] for j in range(len(sets)) if i == j or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(len(sets))])
        new = np.minimum(new, [min(new[lab == x]) for x in lab])
        if (new == lab).all():
            return lab
        lab = new


@pytest.mark.parametrize("size", [1 << 20, 200])
def test_blocks_against_all_pairs(spark, size):
    """The second round, in one block and in many: links join what brute force joins."""
    rng = np.random.default_rng(41)
    base, texts = [f"w{int(x)}" for x in rng.integers(0, 5000, 60)], []
    for i in range(90):
        w = list(base)
        for at in rng.choice(60, int(rng.integers(1, 4)), replace=False):
            w[int(at)] = f"n{i}x{int(at)}"
        texts.append(" ".join(w))
    sets = [S.shingle_set(S.words_of(t), 5) for t in texts]
    node = [int(x) for x in S.signed(xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets)]
    root = [node[i - i % 3] if i < 30 else node[i] for i in range(90)]
    lanes = [[int(x) for x in S.signed(S.set_fingerprint(s, 4))] for s in sets]
    of_node = spark.createDataFrame([(n, r, len(s), *w) for n, r, s, w in zip(node, root, sets, lanes)], "node long, root long, much long, w0 long, w1 long, w2 long, w3 long")
    prints = spark.createDataFrame([(i, i, n) for i, n in enumerate(node)], "id long, h long, node long")
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id long, text string, h long")
    ties = spark.createDataFrame([(node[0], n) for n in set(root) - {node[0]}], "a long, b long")
    links = S.linked_in_blocks(docs, prints, of_node, ties, 5, 256, size).collect()
    at = {n: i for i, n in enumerate(node)}
    plain = [set(s.tolist()) for s in sets]
    assert all(len(plain[at[r["a"]]] & plain[at[r["b"]]]) >= 0.8 * len(plain[at[r["a"]]] | plain[at[r["b"]]]) for r in links)
    start = [at[r] for r in root]
    got = S._rooted(90, np.array([at[r["a"]] for r in links] + list(range(90))), np.array([at[r["b"]] for r in links] + start))
    want = jaccard_groups(plain, start)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want)) > 1
