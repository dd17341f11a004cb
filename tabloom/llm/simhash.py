"""SimHash near-duplicates found by fuzzy hashing with the perfect binary Golay code.

The (23, 12, 7) Golay code tiles all 23-bit words with spheres of radius 3 about 4096 codewords.
The codewords nearest to a word and to its 23 neighbours number one or six; two words that differ
in two bits or fewer share a word between them, hence one of these codeword indices. A 64-bit
fingerprint is cut into segments of 23, 23 and 18 bits. Four errors spread over them so that

* one segment is equal and another has two errors at most: key (equal segment, index), or
* two segments have one error each and the third, cut in three, has an equal part: key (that
  part, index, index), where for a single error one side may use its own index only.

Every fingerprint posts about 120 such keys; equal keys meet, and what meets is compared in full.

`link_exact` finds all links at 4 bits or fewer. Keys that more than `RUN` fingerprints share
would mean a square of comparisons; all fingerprints under such a key instead post every word
within two bits of theirs (2081 each): two fingerprints are linked by a chain of common words
exactly if they are by a chain of links, so hot groups cost a multiple of their size.

`similar_components` is the form for a similarity of 0.8 of five-word shingles (about 10 of 64 bits,
beyond what four errors reach): each text posts a fifth of its shingles and one more, the first in an
order that all texts share, so that no pair at 0.8 goes without a common key; shingles that a sample
has often come last in this order. What meets is compared on 256 bits of the five-word fingerprint,
which is taken of the set of shingles. Up to `WIDE_BITS` two texts are candidates, whose Jaccard
similarity is computed from their whole sets; texts of equal sets are one node. A first round checks a few
candidates a row, which join most of what is alike: of small keys a spanning forest, nearest first, of
large ones pairs with the rows nearest to their majority. The second round checks all candidates
between the groups that this has made, without a row for each: groups that candidates tie together
form a cluster, what is not in a cluster's largest group meets all of it in blocks of
`BLOCK_SHINGLES` shingles, and a pair of blocks yields only links. Keys are dealt without words at
first, and only rows whose key another row shares go on.

Defined results: text null, empty or blank -> no words, fingerprint zero, linked like any other;
doc_id null -> takes part, but never names a component (one of null ids only has null; see
`deduplicated` for its choice); repeated rows -> one output row each; empty table -> empty result; extra columns are ignored by
the query and kept by `deduplicated`. Texts of any length are hashed whole, in blocks of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm._shared import components, read_table, stored, unit_hash

#: Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Most fingerprints under one key that are compared with each other directly.
RUN = 4096
#: Fingerprints under such keys that a task takes.
HOT_ROWS = 4096
#: Shingles hashed at a time.
BLOCK = 1 << 16
SEED = 42
#: Wide form: bits that may differ of 256, and how many more where the smaller set has few shingles.
#: Pairs at 0.8 differ in 38 with a deviation of 5.7, sets of 4 and 5 in 48 with one of 6.3.
WIDE_BITS, FEW, FEW_BITS = 64, 8, 24
#: Wide form: texts sampled for common shingles, in how many of them these are, and most of them.
SAMPLE, COMMON, MOST_COMMON = 5000, 10, 100_000
#: Wide form: the similarity asked for.
SIMILARITY = 0.8
#: Wide form: most rows under one key that the first round compares with each other; beyond, it
#: holds them against centres. The second round compares all that are still apart.
WIDE_RUN = 64
#: Wide form: shingles of the texts of one block in which what is still apart is compared.
BLOCK_SHINGLES = 1 << 20
#: Most texts that are picked for checking by a broadcast of their keys.
BROADCAST_TEXTS = 500_000


# ---------------------------------------------------------------- fingerprints
def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit set."""
    bits = np.unpackbits(np.ascontiguousarray(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    out = np.add.reduce(bits[whole:], axis=0, dtype=np.int64)
    if whole:  # sums of 255 bits fit a byte
        out += np.add.reduce(np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8), axis=0, dtype=np.int64)
    return out


def majority(h: np.ndarray) -> np.uint64:
    """The value whose bits are those that more than half of the 64-bit values have."""
    return (np.uint64(1) << np.arange(64, dtype=np.uint64))[bit_counts(h) * 2 > len(h)].sum(dtype=np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash for each k > 0."""
    if k == 0:
        return h
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles in order, a block at a time; fewer words are one shingle."""
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    for at in range(0, n if words else 0, BLOCK):
        part = words[at : at + BLOCK + shingle - 1]
        line = b" ".join(part)
        m, ends, starts, p = max(1, len(part) - shingle + 1), [], [], 0
        for w in part:
            starts.append(p)
            p += len(w)
            ends.append(p)
            p += 1
        yield np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts[:m], ends[min(shingle, len(part)) - 1 :], strict=True)], np.uint64, m)


def fingerprint_words(words: list[bytes], shingle: int, lanes: int = 1) -> list[int]:
    """`lanes` 64-bit SimHash values; a bit is 1 if set in more than half of the shingles' hashes."""
    if not words:
        return [0] * lanes
    counts, n = np.zeros((lanes, 64), np.int64), max(1, len(words) - shingle + 1)
    for h in shingle_hashes(words, shingle):
        for k in range(lanes):
            counts[k] += bit_counts(mixed(h, k))
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return [int(powers[c * 2 > n].sum(dtype=np.uint64)) for c in counts]


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """The distinct shingles' XXH64, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(words, shingle)]))


def set_fingerprint(s: np.ndarray, lanes: int) -> list[int]:
    """As `fingerprint_words`, of a set: how often a shingle occurs does not count, as in the similarity."""
    counts = np.zeros((lanes, 64), np.int64)
    for at in range(0, len(s), BLOCK):
        for k in range(lanes):
            counts[k] += bit_counts(mixed(s[at : at + BLOCK], k))
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return [int(powers[c * 2 > len(s)].sum(dtype=np.uint64)) for c in counts]


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "replace").lower().split()


def fingerprint(text: str | None, shingle: int = 4) -> int:
    return fingerprint_words(words_of(text), shingle)[0]


def signed(values: Iterable[int]) -> np.ndarray:
    return np.array(list(values), np.uint64).view(np.int64)


# ---------------------------------------------------------------- Golay keys
def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GOLAY << (i - 11)
    return v


@lru_cache(1)
def golay_tables() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Syndromes of the three bytes of a word; by syndrome: how many codewords count as near
    (1 or 6) and the error patterns that lead to them, the nearest first."""
    unit = [_remainder(1 << i) for i in range(23)]
    bytes_ = [np.array([int(np.bitwise_xor.reduce([unit[8 * k + i] for i in range(8) if v >> i & 1] or [0])) for v in range(256 if k < 2 else 128)], np.uint16) for k in range(3)]
    near, count = np.zeros((2048, 6), np.uint32), np.zeros(2048, np.uint8)
    for weight in range(5):
        for places in combinations(range(23), weight):
            s = 0
            for i in places:
                s ^= unit[i]
            if weight < 4 or near[s, 0].bit_count() == 3:
                near[s, count[s]] = sum(1 << i for i in places)
                count[s] += 1
    return bytes_, count, near


def near_codewords(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices, the word's own first, and which of them count."""
    (a, b, c), count, near = golay_tables()
    v = v.astype(np.uint32)
    s = a[v & 255] ^ b[v >> 8 & 255] ^ c[v >> 16]
    return (v[:, None] ^ near[s]) >> np.uint32(11), np.arange(6) < count[s][:, None]


def exact_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, position of each key's fingerprint) such that any two fingerprints at four bits
    or fewer share a key."""
    u = fp.view(np.uint64)
    part = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    index, valid = zip(*(near_codewords(p) for p in part), strict=True)
    index = [i.astype(np.int64) for i in index]
    rows, keys, owners = np.arange(len(u)), [], []

    def post(table: int, rest: np.ndarray, last: np.ndarray, counts: np.ndarray) -> None:
        keys.append(((np.int64(table) << 56) | (rest[:, None] << 24) | last)[counts])
        owners.append(np.broadcast_to(rows[:, None], last.shape)[counts])

    for t, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        post(t, part[i], index[j], valid[j])
    for t, (i, j) in enumerate(combinations(range(3), 2)):
        k, n = 3 - i - j, SEGMENTS[3 - i - j][1]
        cross = np.concatenate([index[i] << 12 | index[j][:, :1], index[i][:, :1] << 12 | index[j][:, 1:]], axis=1)
        counts = np.concatenate([valid[i], valid[j][:, 1:]], axis=1)
        for s in range(3):
            lo, hi = n * s // 3, n * (s + 1) // 3
            post(6 + 3 * t + s, part[k] >> lo & ((1 << (hi - lo)) - 1), cross, counts)
    return np.concatenate(keys), np.concatenate(owners)


def prefix_keys(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of a sorted set of hashes its first in an order that all sets share (those in sorted `common`
    last), so many that two sets of similarity `SIMILARITY` or more share one at least: of n
    they have SIMILARITY * n in common, and what is not in common cannot fill the prefix."""
    last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
    return np.concatenate([s[~last], s[last]])[: len(s) - math.ceil(SIMILARITY * len(s) - 1e-9) + 1]


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of the shingles that a sample of docs(text) has often. It orders keys only, so
    that few rows meet under them; what is found does not depend on it."""
    share = SAMPLE / max(SAMPLE, docs.count())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(words_of(t.as_py()), shingle).view(np.int64))], names=["s"])

    sample = docs.where(unit_hash(F.col("text"), seed=SEED) < share).select("text").mapInArrow(sets, "s long")
    often = sample.groupBy("s").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(MOST_COMMON).select("s")
    return np.sort(np.array([r["s"] for r in often.collect()], np.int64).view(np.uint64))


# ---------------------------------------------------------------- comparing what meets
def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable, for positions 0 to n-1 under links a-b."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _long_run(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join a run's components; compares in blocks, keeps one link a member."""
    m = len(words)
    lab = np.arange(m)
    while True:
        new = lab.copy()
        for at in range(0, m, 256):
            close = differing(words[at : at + 256, None], words[None]) <= bits
            new[at : at + 256] = np.where(close, lab[None], m).min(axis=1)
        new = new[new]
        if (new == lab).all():
            return np.arange(m), lab
        lab = new


def links_in_runs(key: np.ndarray, node: np.ndarray, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys; links between nodes of equal key whose words differ in `bits` at most, as
    pairs (node, root of its component in these rows)."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    of = np.repeat(size, size)
    some = np.flatnonzero((of > 1) & (of <= 64))
    k, a, b = key[some], [], []
    for d in range(1, 64):
        at = np.flatnonzero(k[:-d] == k[d:]) if len(k) > d else k[:0]
        if not len(at):
            break
        x, y = some[at], some[at + d]
        close = differing(words[x], words[y]) <= bits
        a.append(x[close])
        b.append(y[close])
    for s, n in zip(start[size > 64], size[size > 64], strict=True):
        x, y = _long_run(words[s : s + n], bits)
        a.append(s + x)
        b.append(s + y)
    if not a:
        return node[:0], node[:0]
    a, b = np.concatenate(a), np.concatenate(b)
    ids, back = np.unique(np.r_[node[a], node[b]], return_inverse=True)
    lab = _rooted(len(ids), back[: len(a)], back[len(a) :])
    moved = lab != np.arange(len(ids))
    return ids[moved], ids[lab[moved]]


def _may_be_alike(x: np.ndarray, y: np.ndarray, d: np.ndarray, bits: int) -> np.ndarray:
    """Whether sets of x and y shingles, d bits of whose fingerprints differ, are candidates."""
    small = np.minimum(x, y)
    return (d <= bits + FEW_BITS * (small <= FEW)) & (small >= SIMILARITY * np.maximum(x, y) - 1e-9)


def _near_pairs(key: np.ndarray, root: np.ndarray, much: np.ndarray, words: np.ndarray, bits: int, run: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted keys; positions of all candidates of equal key and unlike roots, and the bits that
    differ: first those of all keys with `run` rows at most, then block by block."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    of = np.repeat(size, size)
    some = np.flatnonzero((of > 1) & (of <= run))
    k, found = key[some], [(some[:0], some[:0], some[:0])]
    for step in range(1, run):
        at = np.flatnonzero(k[:-step] == k[step:]) if len(k) > step else k[:0]
        if not len(at):
            break
        x, y = some[at], some[at + step]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        d = differing(words[x], words[y])
        near = _may_be_alike(much[x], much[y], d, bits)
        found.append((x[near], y[near], d[near]))
    yield tuple(np.concatenate(c) for c in zip(*found, strict=True))
    for s, n in zip(start[size > run], size[size > run], strict=True):
        _, back, count = np.unique(root[s : s + n], return_inverse=True, return_counts=True)
        most = back == count.argmax()  # rows of the commonest root need no comparison among themselves
        few, step = np.flatnonzero(~most), max(1, (1 << 18) // n)
        for at in range(0, len(few), step):
            i = few[at : at + step]
            d = differing(words[s + i, None], words[None, s : s + n])
            x, y = np.nonzero(_may_be_alike(much[s + i, None], much[None, s : s + n], d, bits) & (back[i, None] != back) & (most | (np.arange(n) > i[:, None])))
            yield s + i[x], s + y, d[x, y]


def _near_centres(much: np.ndarray, words: np.ndarray, bits: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many rows under one key, pairs (x, y, d) that join most of what is alike, a few a row:
    neighbours, and rows with the one nearest to the majority of their bits; what this one does
    not reach has a centre of its own, while centres reach a sixteenth of it."""
    x, left = np.arange(len(words) - 1), np.arange(len(words))
    d = differing(words[x], words[x + 1])
    near = _may_be_alike(much[x], much[x + 1], d, bits)
    found = [(x[near], x[near] + 1, d[near])]
    while len(left) > run:
        w = words[left]
        centre = np.array([majority(w[:, i]) for i in range(w.shape[1])], np.uint64)
        at = differing(w, centre).argmin()
        d = differing(w, w[at])
        near = _may_be_alike(much[left], much[left[at]], d, bits)
        found.append((np.full(near.sum(), left[at]), left[near], d[near]))
        if near.sum() * 16 < len(left):
            break
        left = left[~near]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _forest(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boruvka's spanning forest over the components `lab` of edges a-b, the best first:
    positions of its edges, and the components they leave."""
    open_, taken = np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        open_ = open_[lab[a[open_]] != lab[b[open_]]]
        if not len(open_):
            return np.concatenate(taken), lab
        best = np.full(len(lab), len(a))
        np.minimum.at(best, lab[a[open_]], open_)
        np.minimum.at(best, lab[b[open_]], open_)
        taken.append(np.unique(best[best < len(a)]))
        lab = _rooted(len(lab), lab[a[taken[-1]]], lab[b[taken[-1]]])[lab]


def _once(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of unlike nodes, each once, the nearest first: (nodes, positions of a and b in them)."""
    ids, back = np.unique(np.r_[a, b], return_inverse=True)
    a, b = np.minimum(back[: len(a)], back[len(a) :]), np.maximum(back[: len(a)], back[len(a) :])
    order = np.lexsort((d, b, a))
    first = order[np.r_[True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)]] if len(order) else order
    first = first[a[first] != b[first]]
    first = first[np.lexsort((b[first], a[first], d[first]))]
    return ids, a[first], b[first]


def _candidates(groups: bool, bits: int, run: int):
    """For mapInArrow over rows (key, node, root, much, w0, w1, ...) sorted by key. With `groups`:
    which roots candidates of equal key tie together, as a forest (a, b) of roots. Else a
    few candidates (a, b) a row that join most of what is alike. A key's rows are held together."""

    def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, a, b = _once(a, b, d)
        kept = _forest(np.arange(len(ids)), a, b)[0]
        return ids[a[kept]], ids[b[kept]]

    def chosen(key: np.ndarray, node: np.ndarray, root: np.ndarray, much: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        if groups:
            held = (node[:0], node[:0])
            for x, y, _ in _near_pairs(key, root, much, words, bits, run):
                a, b = np.r_[held[0], root[x]], np.r_[held[1], root[y]]
                held = forest(a, b, np.zeros(len(a), np.int64))
            yield held
            return
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        few = np.flatnonzero(~np.repeat(size > run, size))
        for x, y, d in _near_pairs(key[few], root[few], much[few], words[few], bits, run):
            yield forest(node[few[x]], node[few[y]], d)
        for s, n in zip(start[size > run], size[size > run], strict=True):
            x, y, d = _near_centres(much[s : s + n], words[s : s + n], bits, run)
            ids, a, b = _once(node[s + x], node[s + y], d)
            yield ids[a], ids[b]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows, enough = 0, 65536

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, enough
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = len(parts[0]) if last else int(np.searchsorted(parts[0], parts[0][-1]))
            held, rows = [tuple(x[cut:] for x in parts)], len(parts[0]) - cut
            enough = max(65536, 2 * rows)
            if cut:
                for a, b in chosen(*(x[:cut] for x in parts)):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            if b.num_rows:
                words = np.stack([c.to_numpy() for c in b.columns[4:]], axis=1).view(np.uint64)
                held.append((*(b.column(i).to_numpy() for i in range(4)), words))
                rows += b.num_rows
                if rows >= enough:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return link


def _linker(lanes: int, bits: int, run: int):
    """For mapInArrow over rows (key, node, w0, w1, ...) sorted by key: links as rows (a, b).

    Of a key with more than `run` rows: rows (a, null), for a finer comparison. No more than about
    two blocks of rows are held.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())], schema=schema)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows, open_key = 0, None

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, open_key
            key, node, words = (np.concatenate(x) for x in zip(*held, strict=True))
            held, rows = [], 0
            if open_key is not None:  # rows that continue a key with many
                n = int(np.searchsorted(key, open_key, side="right"))
                yield out(node[:n], None)
                key, node, words = key[n:], node[n:], words[n:]
                if not len(key):
                    return
                open_key = None
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            cut = len(key) if last else int(start[-1])
            large = (size > run) & (start < cut)
            few = np.flatnonzero(~np.repeat(large, size)[:cut])
            yield out(*links_in_runs(key[few], node[few], words[few], bits))
            for s, n in zip(start[large], size[large], strict=True):
                yield out(node[s : s + n], None)
            if len(key) - cut > run:
                open_key = key[-1]
                yield out(node[cut:], None)
            elif cut < len(key):
                held, rows = [(key[cut:], node[cut:], words[cut:])], len(key) - cut

        for b in batches:
            if b.num_rows:
                words = np.stack([b.column(2 + i).to_numpy() for i in range(lanes)], axis=1).view(np.uint64)
                held.append((*(b.column(i).to_numpy() for i in range(2)), words))
                rows += b.num_rows
                if rows >= max(65536, 2 * run):
                    yield from flush(False)
        if held:
            yield from flush(True)

    return link


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node) sorted by key, those whose key another row has."""
    key, node, before = np.zeros(0, np.int64), np.zeros(0, np.int64), False

    def out(kept: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key[: len(kept)][kept]), pa.array(node[: len(kept)][kept])], names=["key", "node"])

    for b in batches:
        if b.num_rows:  # the last row waits for its successor; `before`: the first has its predecessor's key
            key, node = np.r_[key, b.column(0).to_numpy()], np.r_[node, b.column(1).to_numpy()]
            same = np.r_[before, key[1:] == key[:-1]]
            yield out(same[:-1] | same[1:])
            key, node, before = key[-1:], node[-1:], bool(same[-1])
    if before:
        yield out(np.ones(1, bool))


def _ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint with all words within two bits of it."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    flips = np.r_[np.uint64(0), one, [one[i] | one[j] for i, j in combinations(range(64), 2)]]
    for b in batches:
        for at in range(0, b.num_rows, 256):
            v = b.column(0).to_numpy()[at : at + 256]
            words = (v.view(np.uint64)[:, None] ^ flips[None]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.ravel()), pa.array(np.repeat(v, len(flips)))], names=["word", "node"])


def link_exact(prints: DataFrame, run: int = RUN) -> DataFrame:
    """prints(fp) distinct -> links(a, b) whose components are those of all pairs of
    fingerprints at 4 bits or fewer."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                fp = b.column(0).to_numpy()[at : at + 4096]
                key, owner = exact_keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[owner])], names=["key", "node"])

    keyed = prints.select("fp").mapInArrow(post, "key long, node long").select("key", "node", F.col("node").alias("w0"))
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    found = stored(dealt.mapInArrow(_linker(1, 4, run), "a long, b long").distinct(), "links")
    hot = stored(found.where("b is null").select("a").distinct(), "hot")
    links = found.where("b is not null")
    if hot.isEmpty():
        return links
    tasks = -(-hot.count() // HOT_ROWS)  # each row becomes 2081
    words = hot.repartition(tasks, "a").mapInArrow(_ball, "word long, node long")
    return links.union(_stars(words))


def _stars(words: DataFrame) -> DataFrame:
    """Members of a word linked to its smallest member: sums by word before the shuffle."""
    words = stored(words, "words")
    hub = words.groupBy("word").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("word", "hub")
    return words.join(hub, "word").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


# ---------------------------------------------------------------- whole operators
def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """(id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = signed(fingerprint(t.as_py(), shingle) for t in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def named(members: DataFrame, comp: DataFrame) -> DataFrame:
    """members(id, node), comp(node, root) -> (id, node, component_id): the smallest id reachable."""
    first = members.groupBy("node").agg(F.min("id").alias("first"))
    tied = comp.join(first, "node")
    least = tied.groupBy("root").agg(F.min("first").alias("least"))
    tied = tied.join(least, "root").select("node", "least")
    names = first.join(tied, "node", "left").select("node", F.coalesce("least", "first").alias("component_id"))
    # stored, so that both sides of the last join are shuffled for it alone and Spark may split
    # the rows of a text that a large part of them shares
    return members.join(stored(names, "names"), "node")


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stored(fingerprints(read_table(spark, sf_dir, "documents"), "doc_id", "text"), "prints")
    comp = components(link_exact(prints.select("fp").distinct()), "simhash")
    out = named(prints.withColumnRenamed("fp", "node"), comp)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def sets_of(texts: DataFrame, prints: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """(node, s): the sorted hashes of the shingles of asked(node). texts(id, text, h) is read once more, for
    one text of each node(prints: id, h, node)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                of = [shingle_set(words_of(t.as_py()), shingle).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(of, pa.list_(pa.int64()))], names=["node", "s"])

    one = prints.join(asked, "node", "left_semi").groupBy("node").agg(F.min(F.struct("h", "id")).alias("r"))
    one = stored(one.select("node", F.col("r.h").alias("rh"), F.col("r.id").alias("rid")), "asked")
    if one.count() <= BROADCAST_TEXTS:  # a checked size; beyond it the join shuffles
        one = F.broadcast(one)
    picked = texts.join(one, (F.col("h") == F.col("rh")) & F.col("id").eqNullSafe(F.col("rid")))
    return stored(picked.select("node", "text").mapInArrow(sets, "node long, s array<long>").dropDuplicates(["node"]), "sets")


def alike(texts: DataFrame, prints: DataFrame, pairs: DataFrame, shingle: int, least: float = SIMILARITY) -> DataFrame:
    """Those pairs(a, b) of nodes whose shingles' Jaccard similarity is `least` or more."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    of_node = sets_of(texts, prints, asked, shingle)
    both = pairs.join(of_node.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(of_node.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= least * (F.size("x") + F.size("y") - common)).where(F.size("x") > 0).select("a", "b")


def block_links(rows: pa.Table, bits: int, least: float = SIMILARITY) -> pa.Table:
    """rows(i, j, block, node, root, much, w0.., s) of two blocks i and j (or of one): links (a, b) of
    nodes that differ in root, joining whatever is at `least`; roots once joined are not compared again."""
    block, node, root, much = (rows.column(c).to_numpy() for c in ("block", "node", "root", "much"))
    words = np.stack([rows.column(f"w{k}").to_numpy() for k in range(4)], axis=1).view(np.uint64)
    lists = rows.column("s").combine_chunks()
    value, at = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    same, (_, lab) = rows.column("i")[0] == rows.column("j")[0], np.unique(root, return_inverse=True)
    xs, ys = np.flatnonzero(block == rows.column("i")[0].as_py()), np.flatnonzero(block == rows.column("j")[0].as_py())
    a, b = [], []
    for k, x in enumerate(xs):
        rest = ys[k + 1 :] if same else ys
        rest = rest[lab[rest] != lab[x]]
        rest = rest[_may_be_alike(much[x], much[rest], differing(words[rest], words[x]), bits)] if len(rest) else rest
        own = value[at[x] : at[x + 1]]
        if not len(rest) or not len(own):
            continue
        size = at[rest + 1] - at[rest]
        begin = np.r_[0, np.cumsum(size)[:-1]]
        theirs = value[np.repeat(at[rest] - begin, size) + np.arange(size.sum())]
        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        common = np.add.reduceat(np.r_[hit, False].astype(np.int64), begin)
        for y in rest[common >= least * (size + len(own) - common)]:
            if lab[y] != lab[x]:
                a.append(node[x])
                b.append(node[y])
                lab[lab == lab[y]] = lab[x]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def linked_in_blocks(texts: DataFrame, prints: DataFrame, of_node: DataFrame, ties: DataFrame, shingle: int, bits: int, size: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) between nodes of unlike roots that ties(a, b) of roots bring into one cluster.
    of_node(node, root, much, w0..). All of a cluster but its largest root's nodes meet all of it."""
    clusters = components(ties, "clusters")
    rows = stored(of_node.join(clusters.select(F.col("node").alias("root"), F.col("root").alias("cluster")), "root"), "apart")
    heavy = rows.groupBy("cluster", "root").agg(F.sum(F.col("much") + 16).alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    blocks = lambda n: F.greatest(F.ceil(n / F.lit(size)), F.lit(1))
    heavy = heavy.select("cluster", F.col("top.root").alias("most"), blocks(F.col("n") - F.col("top.n")).alias("n_few"), blocks(F.col("top.n")).alias("n_most"))
    dealt = rows.join(stored(heavy, "clusters"), "cluster")
    few, h = F.col("root") != F.col("most"), F.xxhash64(F.lit(SEED), "node")
    block = F.when(few, F.pmod(h, F.col("n_few"))).otherwise(F.col("n_few") + F.pmod(h, F.col("n_most")))
    last = F.when(few, F.col("n_few") + F.col("n_most")).otherwise(F.col("n_few")) - 1
    dealt = dealt.withColumn("block", block).withColumn("last", last).drop("most", "n_few", "n_most")
    met = dealt.join(sets_of(texts, prints, rows.select("node"), shingle), "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    met = met.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("last", "other")
    return met.groupBy("cluster", "i", "j").applyInArrow(lambda t: block_links(t, bits), "a long, b long")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = WIDE_BITS, run: int = WIDE_RUN) -> DataFrame:
    """(id, component_id) for every row: components of texts whose five-word shingles have a
    Jaccard similarity of `SIMILARITY` or are equal."""

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    common = common_shingles(slim, shingle)

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part, node, much, lanes, keys = b.slice(at, 1000), [], [], [], []
                for t in part.column(1):
                    distinct = shingle_set(words_of(t.as_py()), shingle)
                    node.append(xxhash.xxh64_intdigest(distinct.tobytes(), SEED))
                    much.append(len(distinct))
                    lanes.append(set_fingerprint(distinct, 4))
                    keys.append(prefix_keys(distinct, common).view(np.int64))
                lane = np.array(lanes, np.uint64).reshape(-1, 4).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(signed(node)), pa.array(much, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *(pa.array(lane[:, i]) for i in range(4))], names=["id", "h", "node", "much", "keys", "w0", "w1", "w2", "w3"])

    prints = stored(slim.mapInArrow(wide, f"id {kind}, h long, node long, much long, keys array<long>, w0 long, w1 long, w2 long, w3 long"), "prints")
    words = [F.min(c).alias(c) for c in ("much", "w0", "w1", "w2", "w3")]
    keyed = prints.dropDuplicates(["node"]).select(F.explode("keys").alias("key"), "node")
    keyed = stored(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, node long"), "keyed")

    of_node = prints.groupBy("node").agg(*words)

    def candidates(of_node: DataFrame, groups: bool) -> DataFrame:
        rows = keyed.join(of_node, "node").select("key", "node", "root", "much", "w0", "w1", "w2", "w3")
        dealt = rows.repartition("key").sortWithinPartitions("key", "node")
        return stored(dealt.mapInArrow(_candidates(groups, bits, run), "a long, b long").distinct(), "candidates")

    few = candidates(of_node.withColumn("root", F.col("node")), False)
    comp = components(alike(slim, prints.select("id", "h", "node"), few, shingle), "similar")
    of_node = stored(of_node.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    more = linked_in_blocks(slim, prints.select("id", "h", "node"), of_node, candidates(of_node, True), shingle, bits)
    comp = components(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "similar")
    return named(prints.select("id", "node"), comp).select("id", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group: that of the smallest id, rows without id after all others; rows equal
    in id and text count once. Rows travel as one struct, so their columns' names clash with none."""
    text = F.xxhash64(text_col)
    if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        # a row without id stands under a number from its text, beyond the range of ids
        key = F.coalesce(F.col(id_col).cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(text, 3))
    else:  # ids of other kinds go by their text
        key = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.concat(F.lit("~"), F.hex(text)))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("id"), text.alias("h"), F.col(text_col).alias("text"))
    groups = similar_components(rows, "id", "text")
    names = groups.where(F.col("id") == F.col("component_id")).select("id").distinct()
    return rows.drop("text").join(names, "id", "left_semi").dropDuplicates(["id", "h"]).select("row.*")
