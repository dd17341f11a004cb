"""Benchmark decontamination by latent semantic retrieval.

1. Every document is read once; its words (lower-cased, punctuation removed) become hashed terms.
   Document frequencies are counted over all passages of all documents.
2. Latent space: a randomised singular value decomposition of the TF-IDF matrix of passages. The
   range finder and the Rayleigh-Ritz step are two distributed passes over all passages of all
   documents; the first adds up a terms x `RANK` matrix, the second one of `RANK` x `RANK`. What is
   searched is everything.
3. Candidate search: each benchmark item meets all windows of its own size class of every
   document; latent vectors, scaled to unit variance a dimension, are compared by cosine.
4. Checks: the longest common subsequence of item and window must cover `LCS_SHARE` of the item,
   that of the item's answer (its last `ANSWER_WORDS` words, unless a column names it)
   `ANSWER_SHARE` of the answer. Both allow words to be put in, left out or replaced.

The benchmark is the stated query set: it is sent to the executors `ITEM_BLOCK` items at a time,
a bounded broadcast, each block meeting all documents and storing its hits.

Items shorter than `LEAST_WORDS` words, of which a subsequence says nothing, are found where their words
stand next to each other; such a document counts as a leak only if it is hardly more than the item,
`SMALLEST` words at most.

Defined results: text null or without words -> no row; item text null or without words -> never found; repeated rows -> one result row; empty documents or
benchmark -> empty result; extra columns are ignored, `decontaminated` keeps them. Items longer than
`LONGEST` words are searched in parts; texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm._shared import dropped, read_table, stored

TERMS = 1 << 15
RANK = 96
PASSAGE = 32
FIT_BLOCK = 1 << 15
ITEM_BLOCK = 4096
ITEM_GROUP, CHECKED = 64, 4096
SMALLEST, LONGEST, STEP = 16, 256, 8
#: Windows have a size of these, the least that holds the item.
WINDOWS = (16, 24, 32, 48, 64, 96, 128, 192, 256)
COSINE = 0.4
LCS_SHARE, ANSWER_SHARE, ANSWER_WORDS = 0.6, 0.5, 8
LEAST_WORDS = 5
SEED = 5

_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def terms(text: str | None) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint16)
    words = text.lower().encode("utf-8", "replace").translate(None, _PUNCTUATION).split()
    return (np.fromiter(map(crc32, words), np.uint32, len(words)) % TERMS).astype(np.uint16)


def lcs_length(a: list[int], b: list[int]) -> int:
    """Longest common subsequence, bit-parallel over a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x)
        if m is not None:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


# ---------------------------------------------------------------- 1 terms of all documents
def read_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents: key, id, ids (uint16). Frequencies: term, df (one task's passages), with term
    TERMS for the number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, kind = np.zeros(TERMS + 1, np.int64), None
        for b in batches:
            kind = b.schema.field(1).type
            found = [terms(t.as_py()) for t in b.column(2)]
            rest = [x for x in found if len(x)]
            if rest:
                # a term counts once a passage: count distinct (passage, term) pairs
                sizes = np.array([-(-len(x) // PASSAGE) for x in rest])
                first = np.r_[0, np.cumsum(sizes)[:-1]]
                passage = np.concatenate([np.arange(len(x)) // PASSAGE + f for x, f in zip(rest, first, strict=True)])
                pair = np.sort((passage.astype(np.int64) << 16) | np.concatenate(rest))
                df[:TERMS] += np.bincount(pair[np.r_[True, pair[1:] != pair[:-1]]] & 0xFFFF, minlength=TERMS)
                df[TERMS] += int(sizes.sum())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in found], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=["key", "id", "ids", "term", "df"])
        some = np.flatnonzero(df)
        if len(some):
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.binary()), pa.array(some.astype(np.int32)), pa.array(df[some])], names=["key", "id", "ids", "term", "df"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"key long, id {id_kind}, ids binary, term int, df long")


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


# ---------------------------------------------------------------- 2 latent space
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """All passages as rows of sorted terms, TERMS where a text's last one ends; FIT_BLOCK to twice that at a time."""

    def rows(texts: list[np.ndarray]) -> np.ndarray:
        sizes = [-(-len(x) // PASSAGE) for x in texts]
        out, at = np.full((sum(sizes), PASSAGE), TERMS, np.uint16), 0
        for x, n in zip(texts, sizes, strict=True):
            out[at : at + n].reshape(-1)[: len(x)] = x
            at += n
        return np.sort(out, axis=1)

    held, n, most = [], 0, FIT_BLOCK * PASSAGE
    for b in batches:
        for raw in b.column(0):
            ids = np.frombuffer(raw.as_buffer(), np.uint16)
            for at in range(0, len(ids), most):
                held.append(ids[at : at + most])
                n += -(-len(held[-1]) // PASSAGE)
                if n >= FIT_BLOCK:
                    yield rows(held)
                    held, n = [], 0
    if held:
        yield rows(held)


def _norms(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lengths of passages (sorted terms) with weights x: repeats of a term count as its square."""
    total, x2, rows = np.einsum("ij,ij->i", x, x), x * x, np.arange(len(s))
    for k in range(1, PASSAGE):
        same = (s[rows, k:] == s[rows, :-k]) & (s[rows, k:] < TERMS)
        some = same.any(axis=1)
        rows, same = rows[some], same[some]
        if not len(rows):
            break
        total[rows] += 2 * np.einsum("ij,ij->i", x2[rows, k:], same)
    return np.sqrt(total)


def _images(s: np.ndarray, w: np.ndarray, q: np.ndarray, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised weights x of the passages s and A q; w and q have a row of zeros for the term TERMS. Rows are
    taken into one buffer: memory that is new each time costs more than the sums."""
    rank = q.shape[1]
    x = w[s]
    x /= np.maximum(_norms(s, x), 1e-12)[:, None]
    y = np.empty((len(s), rank), np.float32)
    for at in range(0, len(s), 256):
        part = s[at : at + 256]
        near = np.take(q, part.reshape(-1), axis=0, out=buffer[: part.size], mode="clip").reshape(*part.shape, rank)
        y[at : at + 256] = np.matmul(x[at : at + 256, None], near)[:, 0]
    return x, y


def _add_products(s: np.ndarray, w: np.ndarray, q: np.ndarray, out: np.ndarray) -> None:
    """out += A'A q for the passages s."""
    rank, most = q.shape[1], 256 * PASSAGE
    buffer, s = np.empty((most, rank), np.float32), s.astype(np.int64)
    x, y = _images(s, w, q, buffer)
    # by terms: pieces of equally many places, added up together; no term has two pieces in one product
    t = s.reshape(-1)
    order = np.argsort(t.astype(np.uint16), kind="stable")
    order = order[: np.count_nonzero(t < TERMS)]
    t, x, of = t[order], x.reshape(-1)[order], order // PASSAGE
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    long = np.diff(np.r_[first, len(t)])
    pieces = -(-long // most)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first, long = np.repeat(first, pieces) + nth * most, np.minimum(np.repeat(long, pieces) - nth * most, most)
    by = np.argsort(long, kind="stable")
    for same in np.split(by, np.flatnonzero(np.diff(long[by])) + 1):
        n = int(long[same[0]])
        for at in range(0, len(same), most // n):
            start = first[same[at : at + most // n]]
            places = start[:, None] + np.arange(n)
            near = np.take(y, of[places].reshape(-1), axis=0, out=buffer[: places.size], mode="clip").reshape(*places.shape, rank)
            out[t[start]] += np.matmul(x[places][:, None], near)[:, 0]


def _tasks(texts: DataFrame, passages: int) -> DataFrame:
    """texts in tasks of up to a million passages, so that what tasks send stays small beside the texts."""
    return texts.coalesce(max(1, -(-passages // (1 << 20)), min(texts.sparkSession.sparkContext.defaultParallelism, passages >> 14)))


def _range_of(texts: DataFrame, weight: np.ndarray, passages: int, rank: int) -> np.ndarray:
    """A'A times a seeded random basis, made where it is used, for the matrix A of the normalised TF-IDF passages
    of all texts: added up in Spark by slices of terms, in single precision."""
    shared, rows = texts.sparkSession.sparkContext.broadcast(weight), 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.random.default_rng(SEED).standard_normal((TERMS, rank), np.float32)
        w, q = np.append(shared.value, 0).astype(np.float32), np.vstack([q, np.zeros((1, rank), np.float32)])
        out = np.zeros((TERMS, rank), np.float32)
        for s in _blocks(batches):
            _add_products(s, w, q, out)
        slices = np.arange(0, TERMS, rows)
        yield pa.RecordBatch.from_arrays([pa.array(slices.astype(np.int32)), pa.array([out[s : s + rows].tobytes() for s in slices], pa.binary())], names=["slice", "part"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in pdf["part"])
        return pd.DataFrame({"slice": [key[0]], "part": [total.astype(np.float32).tobytes()]})

    summed = stored(_tasks(texts, passages).mapInArrow(run, "slice int, part binary").groupBy("slice").applyInPandas(add, "slice int, part binary"), "range")
    out = np.zeros((TERMS, rank), np.float32)
    for r in summed.toLocalIterator():  # TERMS x rank numbers in all, a partition of them at a time
        out[r["slice"] : r["slice"] + rows] = np.frombuffer(r["part"], np.float32).reshape(-1, rank)
    dropped(summed)
    shared.destroy()
    return out


def _gram_of_images(texts: DataFrame, weight: np.ndarray, passages: int, basis: np.ndarray) -> np.ndarray:
    """basis' A'A basis: products of the passages' images, a rank x rank matrix a task."""
    rank = basis.shape[1]
    shared = texts.sparkSession.sparkContext.broadcast((weight, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, q = shared.value
        w, q = np.append(w, 0).astype(np.float32), np.vstack([q, np.zeros((1, rank), np.float32)])
        buffer, out = np.empty((256 * PASSAGE, rank), np.float32), np.zeros((rank, rank))
        for s in _blocks(batches):
            y = _images(s.astype(np.int64), w, q, buffer)[1]
            for at in range(0, len(y), 1024):
                out += y[at : at + 1024].T @ y[at : at + 1024]
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])

    out = np.zeros((rank, rank))
    parts = stored(_tasks(texts, passages).mapInArrow(run, "part binary"), "gram")
    for r in parts.toLocalIterator():
        out += np.frombuffer(r["part"]).reshape(rank, rank)
    dropped(parts)
    shared.destroy()
    return out


def _turned(a: np.ndarray, turn: np.ndarray) -> None:
    """a = a turn, in place: the driver's memory holds one matrix of this size."""
    for at in range(0, len(a), 1024):
        a[at : at + 1024] = a[at : at + 1024].astype(np.float64) @ turn


def _orthonormal(a: np.ndarray) -> None:
    """An orthonormal basis of a's columns in their place, by the eigenvectors of a'a, twice for precision.
    Columns beyond a's rank, as far as single precision tells it, become zero."""
    for _ in range(2):
        gram = np.zeros((a.shape[1], a.shape[1]))
        for at in range(0, len(a), 1024):
            part = a[at : at + 1024].astype(np.float64)
            gram += part.T @ part
        values, turn = np.linalg.eigh(gram)
        some = values > max(values.max(initial=0) * 1e-14, 1e-300)
        _turned(a, turn * np.where(some, 1 / np.sqrt(np.where(some, values, 1)), 0))


def latent_space(table: DataFrame, weight: np.ndarray, passages: int, rank: int = RANK) -> np.ndarray:
    """terms x rank: latent vector of a term, weighted and scaled by the singular values, from all passages."""
    texts = table.where("term IS NULL").select("ids")
    q = _range_of(texts, weight, passages, rank)
    _orthonormal(q)
    values, turn = np.linalg.eigh(_gram_of_images(texts, weight, passages, q))
    _turned(q, turn / np.sqrt(np.maximum(values, values.max(initial=0) * 1e-6 + 1e-300)))
    q *= weight[:, None].astype(np.float32)
    return q


# ---------------------------------------------------------------- 3 candidates, 4 checks
def window_of(n: int) -> int:
    return next(w for w in WINDOWS if w >= n)


class Searcher:
    """Items by window size, their latent vectors and words."""

    def __init__(self, space: np.ndarray, items: list[tuple[object, list[int], list[int]]], cosine: float) -> None:
        self.space, self.cosine = np.vstack([space, np.zeros((1, space.shape[1]), np.float32)]), cosine
        #: By size of window: items, their vectors, numbers of the terms that any of them has, an item's own terms by these.
        self.by: dict[int, list[tuple[list, np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.short: dict[int, dict[int, list]] = {}  # by words, by the number that these make
        for item, words, _ in items:
            if len(words) < LEAST_WORDS:
                self.short.setdefault(len(words), {}).setdefault(sum(x << 15 * i for i, x in enumerate(words)), []).append(item)
        items = [x for x in items if len(x[1]) >= LEAST_WORDS]
        for w in sorted({window_of(len(x[1])) for x in items}):
            own = [x for x in items if window_of(len(x[1])) == w]
            self.by[w] = [self._group(own[at : at + ITEM_GROUP]) for at in range(0, len(own), ITEM_GROUP)]

    def _group(self, own: list[tuple]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        v = np.array([self.space[x[1]].sum(axis=0) for x in own])
        known = [np.unique(x[1]) for x in own]
        some, number = np.unique(np.concatenate(known)), np.zeros(len(self.space), np.uint16)
        number[some] = np.arange(1, len(some) + 1)
        nth = np.zeros((len(own), len(some) + 1), np.uint16)
        for row, x in zip(nth, known, strict=True):
            row[number[x]] = np.arange(1, len(x) + 1)
        return [(*x, len(k)) for x, k in zip(own, known, strict=True)], (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).T, number, nth

    def candidates(self, docs: list[np.ndarray]) -> Iterator[tuple[int, tuple, float, int, int]]:
        """(document, item, cosine, first word, last word + 1) of windows like an item that, with a margin of half
        the item on both sides, hold as many different words of it as the subsequence needs at least."""
        sizes = np.array([-(-len(d) // STEP) for d in docs])
        most = max(self.by) // STEP - 1
        # documents stand apart by as many empty steps as no window reaches over
        starts = np.cumsum(sizes + most) - sizes - most
        flat = np.full(int(sizes.sum() + most * len(docs)) * STEP, len(self.space) - 1, np.int32)
        for d, at in zip(docs, starts.tolist(), strict=True):
            flat[at * STEP : at * STEP + len(d)] = d
        seg = np.empty((len(flat) // STEP, self.space.shape[1]), np.float32)
        for at in range(0, len(seg), 512):
            seg[at : at + 512] = self.space[flat[at * STEP : (at + 512) * STEP]].reshape(-1, STEP, seg.shape[1]).sum(axis=1)
        of = np.repeat(np.arange(len(docs)), sizes + most)
        nth = np.arange(len(seg)) - starts[of]
        v, reach = seg.copy(), 1
        for w, groups in self.by.items():
            for j in range(reach, w // STEP):
                v[: len(seg) - j] += seg[j:]
            reach = w // STEP
            begin = np.flatnonzero((nth < sizes[of]) & (nth % max(1, reach // 4) == 0))
            near_v = v[begin]
            long = np.maximum(np.sqrt(np.einsum("ij,ij->i", near_v, near_v)), 1e-9)
            for own, items, number, known in groups:
                near = near_v @ items
                at = np.flatnonzero(near >= self.cosine * long[:, None])
                lengths, distinct = np.array([len(x[1]) for x in own]), np.array([x[3] for x in own])
                for part in np.split(at, range(CHECKED, len(at), CHECKED)):
                    x, y = np.divmod(part, len(own))
                    s = begin[x]
                    d = of[s]
                    a, size = nth[s] * STEP, sizes[d] * STEP
                    b, margin = np.minimum(a + w, size), lengths[y] // 2 + STEP
                    # different words of the item from a - margin to b + margin, counted by their numbers in it
                    low, high = np.maximum(a - margin, 0), np.minimum(b + margin, size)
                    places = np.arange((high - low).max(initial=0))
                    words = np.take(flat, (starts[d] * STEP + low)[:, None] + places, mode="clip")
                    word = known[y[:, None], np.where(places < (high - low)[:, None], number[words], 0)]
                    seen = np.zeros((len(part), distinct.max() + 1), bool)
                    seen[np.arange(len(part))[:, None], word] = True
                    enough = seen[:, 1:].sum(axis=1) >= LCS_SHARE * lengths[y] - (lengths[y] - distinct[y])
                    for i in np.flatnonzero(enough).tolist():
                        yield int(d[i]), own[y[i]], float(near[x[i], y[i]] / long[x[i]]), int(a[i]), int(b[i])

    def exact(self, docs: list[np.ndarray]) -> Iterator[tuple[int, object]]:
        """(document, item) of short items whose words stand next to each other."""
        for n, wanted in self.short.items():
            codes = np.array(list(wanted), np.int64)
            for d, words in enumerate(docs):
                if len(words) >= n:
                    w = words.astype(np.int64)
                    here = sum(w[i : len(w) - n + 1 + i] << 15 * i for i in range(n))
                    for code in np.intersect1d(here, codes):
                        yield from ((d, item) for item in set(wanted[int(code)]))

    def hits(self, docs: list[np.ndarray]) -> Iterator[tuple[int, object, float, float, float, bool]]:
        """(document, item, cosine, LCS share, answer share, whether that is a leak) of what passes both checks."""
        for d, item in self.exact(docs):
            yield d, item, 1.0, 1.0, 1.0, len(docs[d]) <= SMALLEST
        if not self.by:
            return
        done = set()
        for d, (item, words, answer, _), cos, a, b in self.candidates(docs):
            if (d, item) in done:
                continue
            margin = len(words) // 2 + STEP
            window = docs[d][max(0, a - margin) : b + margin].tolist()
            share = lcs_length(words, window) / len(words)
            if share >= LCS_SHARE:
                told = lcs_length(answer, window) / len(answer)
                if told >= ANSWER_SHARE:
                    done.add((d, item))
                    yield d, item, cos, share, told, True


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, cosine: float = COSINE) -> DataFrame:
    """key, id, item_id, cosine, lcs_share, answer_share, leak: a row per document and item found in it."""
    spark = docs.sparkSession
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    id_kind = docs.schema[id_col].dataType.simpleString()
    schema = f"key long, id {id_kind}, item_id {item_kind}, cosine double, lcs_share double, answer_share double, leak boolean"
    table = stored(read_terms(docs, id_col, text_col), "terms")
    df = np.zeros(TERMS + 1)
    for r in table.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")).collect():  # TERMS + 1 rows at most
        df[r["term"]] = r["df"]
    passages = int(df[TERMS])
    weight = np.log((1 + passages) / (1 + df[:TERMS]))
    texts = table.where("term IS NULL").select("key", "id", "ids")
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    asked = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).cast("string").alias("t"), answer.alias("a")).where("t IS NOT NULL").distinct()
    space, found = None, []
    rows = asked.toLocalIterator()
    while passages:
        block = []
        for r in rows:
            t = terms(r["t"]).tolist()
            told = terms(r["a"]).tolist() or t[-ANSWER_WORDS:]
            if t:
                parts = max(1, -(-len(t) // LONGEST))
                cut = [t[len(t) * k // parts : len(t) * (k + 1) // parts] for k in range(parts)]
                block += [(r["i"], c, told if parts == 1 else c[-ANSWER_WORDS:]) for c in cut]
            if len(block) >= ITEM_BLOCK:
                break
        if not block:
            break
        if space is None:
            space = spark.sparkContext.broadcast(latent_space(table, weight, passages))
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(space.value, shared.value, cosine)
            for b in batches:
                n, at = b.num_rows, 0
                keys, ids = b.column(0), b.column(1)
                words = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(2)]
                while at < n:
                    stop, size = at, 0
                    while stop < n and (size == 0 or size + len(words[stop]) < 32_768):
                        size += len(words[stop]) + STEP
                        stop += 1
                    part = [k for k in range(at, stop) if len(words[k])]
                    found = list(searcher.hits([words[k] for k in part])) if part else []
                    at = stop
                    if found:
                        own = pa.array([part[f[0]] for f in found])
                        yield pa.RecordBatch.from_arrays([keys.take(own), ids.take(own), *(pa.array([f[i] for f in found]) for i in range(1, 6))], names=["key", "id", "item_id", "cosine", "lcs_share", "answer_share", "leak"])

        found.append(stored(texts.mapInArrow(run, schema), "found"))
        shared.destroy()
    if space is not None:
        space.destroy()
    out = spark.createDataFrame([], schema)
    for hits in found:
        out = out.union(hits)
    return out.distinct()


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item."""
    bad = stored(find(docs, benchmark, id_col, text_col).where("leak").select("key").distinct(), "leaks")
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key(id_col, text_col).alias("key"))
    return rows.join(bad, "key", "left_anti").select("row.*")


def op5_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.groupBy(F.col("id").alias("doc_id"), "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "lcs_share", "answer_share", "leak")])
