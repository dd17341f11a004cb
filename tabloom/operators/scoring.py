"""Numeric scoring of lines and separators with given weights: feature assembly, then the published
shapes of both networks in NumPy over Arrow batches. A batch holds whole tables, one row for each axis
with the image and the feature matrix; weights are broadcast (their size is the model's, not the
data's). Images come with the axis' lines first, so columns go through the same code as rows.

Convolutions run over blocks of lines, each reduced before the next, so a task holds one image and
little more. Where images are large, set spark.sql.execution.arrow.maxRecordsPerBatch to a few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The published shapes.
SHIFTS = (-4, -3, -2, -1, 1, 2, 3, 4)
LINE_FEATURES, GLOBALS, SEPARATOR_FEATURES = 11, 3, 15
LINE_IMAGE, LINE_POOL, LINE_SCANNER, LINE_TOP = (24, 4, 4), 4, (2, 10), 5
LINE_HIDDEN, PREDICTED, PREDICTED_HIDDEN = (48, 16), ((4, 1, 6), (10, 6, 6)), (6,)
AREA, AREA_STEPS, SCANNER, SEPARATOR_TOP, SEPARATOR_HIDDEN = (16, 8, 8), 5, (16, 40), 8, (36, 16)


def assembled(lines: DataFrame, globals_: DataFrame, keys: list[str], names: list[str], scalars: list[str]) -> DataFrame:
    """One row a table: its lines' features in the order of names, then relative position, then
    the table's scalars on every line."""
    n = F.count("*")
    rows = F.array_sort(F.collect_list(F.struct("at", *[F.col(c).cast("double").alias(c) for c in names])))
    out = lines.groupBy(*keys).agg(rows.alias("_r"), n.cast("double").alias("_n")).join(globals_, keys)
    line = lambda x: F.array(*[x[c] for c in names], x["at"] / F.col("_n"), *[F.col(c).cast("double") for c in scalars])
    return out.select(*keys, F.transform("_r", line).alias("features"))


def images(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, image: the values of pixels(keys, line, at, v), line by line."""
    ordered = lambda col, by: F.transform(F.sort_array(F.collect_list(F.struct(by, col))), lambda x: x[col])
    rows = pixels.groupBy(*keys, "line").agg(ordered("v", "at").alias("row"))
    return rows.groupBy(*keys).agg(ordered("row", "line").cast("array<array<double>>").alias("image"))


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def around(width: int) -> tuple[int, int]:
    """Padding that keeps the length; an even width takes the odd one at the end."""
    return (width - 1) // 2, width // 2


def normed(x: np.ndarray, part: dict) -> np.ndarray:
    """Batch norm as scale and shift of the first axis' channels, then rectified."""
    shape = (-1,) + (1,) * (x.ndim - 1)
    return relu(x * part["scale"].reshape(shape) + part["shift"].reshape(shape))


def convolved(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """(lines, channels) with (width, channels, out): same length, ends repeated."""
    padded = np.pad(x, (around(len(kernel)), (0, 0)), mode="edge")
    return sum(padded[i : i + len(x)] @ kernel[i] for i in range(len(kernel)))


def areas(image: np.ndarray, part: dict, reduced: Callable[[np.ndarray], np.ndarray], block: int = 64) -> np.ndarray:
    """Convolution of the whole image (same size, edges repeated) with kernels (out, high, wide), normed
    and rectified; `reduced` takes (out, lines, along) to (lines, features), a block of lines at a time."""
    kernel = part["kernel"]
    _, high, wide = kernel.shape
    padded, (n, along), out = np.pad(image, (around(high), around(wide)), mode="edge"), image.shape, []
    for at in range(0, n, block):
        size = min(block, n - at)
        got = np.zeros((len(kernel), size, along))
        for i in range(high):
            for j in range(wide):
                got += kernel[:, i, j, None, None] * padded[at + i : at + i + size, j : j + along]
        out.append(reduced(normed(got, part)))
    return np.concatenate(out)


def scanned(image: np.ndarray, part: dict) -> np.ndarray:
    """(lines, channels): the largest answer of each line to kernels (out, width) set side by side;
    0 where a line is shorter than one."""
    out, width = part["kernel"].shape
    steps = image.shape[1] // width
    if not steps:
        return np.zeros((len(image), out))
    pieces = image[:, : steps * width].reshape(len(image), steps, width)
    return normed(np.einsum("nsw,cw->cns", pieces, part["kernel"]), part).max(axis=2).T


def pooled(x: np.ndarray, parts: int) -> np.ndarray:
    """Adaptive mean pooling of the first axis to `parts` cells."""
    n = len(x)
    return np.stack([x[n * i // parts : max(n * i // parts + 1, -(-n * (i + 1) // parts))].mean(axis=0) for i in range(parts)])


def top(x: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each column, descending, padded with the smallest."""
    s = -np.sort(-x, axis=0)[:k]
    return np.vstack([s, np.repeat(s[-1:], k - len(s), axis=0)]) if len(s) < k else s


def gathered(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows by index, indices clamped to the table."""
    return x[np.clip(at, 0, len(x) - 1)]


def masked_top(x: np.ndarray, start: int, end: int, k: int) -> np.ndarray:
    """The k largest of all values inside [start, end], minus infinity where there are fewer."""
    inside = x[max(0, start) : end + 1].ravel()
    out = np.full(k, -np.inf)
    s = -np.sort(-inside)[:k]
    out[: len(s)] = s
    return out


def mlp(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i < len(layers) - 1:
            x = relu(x)
    return x


def line_scores(image: np.ndarray, x: np.ndarray, weights: dict) -> np.ndarray:
    """Probability of each line of image (lines, along) with features x (lines, 11 + 3 of the table):
    own and image features with those of eight circular neighbours, the table's features and largest
    scans; then two convolutions along the scores and a last small network."""
    own, shared = x[:, :LINE_FEATURES], x[:, LINE_FEATURES:]
    seen = areas(image, weights["image"], lambda v: pooled(v.transpose(2, 1, 0), LINE_POOL).transpose(1, 2, 0).reshape(v.shape[1], -1))
    near = np.concatenate([own, seen], axis=1)
    near = np.concatenate([near, *[np.roll(near, s, axis=0) for s in SHIFTS]], axis=1)
    best = top(scanned(image, weights["scanner"]), LINE_TOP).T.ravel()
    score = mlp(np.concatenate([near, shared, np.broadcast_to(best, (len(x), len(best)))], axis=1), weights["layers"])
    along = score
    for part in weights["along"]:
        along = normed(convolved(along, part["kernel"]).T, part).T
    return sigmoid(mlp(np.concatenate([score, along], axis=1), weights["last"]))[:, 0]


def separator_scores(image: np.ndarray, spans: np.ndarray, x: np.ndarray, weights: dict) -> np.ndarray:
    """Probability of each separator (first and last line) with features x (separators, 15 + 3 of the
    table): the largest area answers before and after it in five steps of a kernel, the largest scans
    inside it and of the table."""
    if not len(spans):
        return np.zeros(0)
    k, size = SEPARATOR_TOP, weights["area"]["kernel"].shape[1]
    best = areas(image, weights["area"], lambda v: top(v.transpose(0, 2, 1).reshape(-1, v.shape[1]), k).T)
    steps = np.arange(AREA_STEPS) * size
    sides = [spans[:, :1] - size // 2 - 1 - steps, spans[:, 1:] + size // 2 + 1 + steps]
    outside = [top(gathered(best, at).reshape(len(spans), -1).T, k).T for at in sides]
    scans = scanned(image, weights["scanner"])
    inside = np.stack([masked_top(scans, int(a), max(int(a), int(b)), k) for a, b in np.clip(spans, 0, len(image) - 1)])
    whole = np.broadcast_to(masked_top(scans, 0, len(scans), k), inside.shape)
    return sigmoid(mlp(np.concatenate([x, *outside, inside, whole], axis=1), weights["layers"]))[:, 0]


def _kernel(rng: np.random.Generator, shape: tuple[int, ...], channels: int) -> dict:
    kernel = rng.standard_normal(shape)
    return {"kernel": kernel * np.sqrt(channels / kernel.size), "scale": np.ones(channels), "shift": np.zeros(channels)}


def _layers(rng: np.random.Generator, *sizes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(rng.standard_normal((a, b)) / np.sqrt(a), rng.standard_normal(b) * 0.1) for a, b in zip(sizes, sizes[1:], strict=False)]


def made_up_weights(seed: int = 0, separators: bool = False) -> dict[str, dict]:
    """Fixed random weights of both axes: none are published; shape and determinism are what can be
    tested. The image's convolution is shared: columns use its kernels turned over, in the separator
    model rows take its first half and columns the second."""
    rng, out = np.random.default_rng(seed), {}
    image = _kernel(rng, AREA if separators else LINE_IMAGE, (AREA if separators else LINE_IMAGE)[0])
    for axis in ("row", "col"):
        kernel = image["kernel"] if axis == "row" else image["kernel"].transpose(0, 2, 1)
        if separators:
            half = slice(0, AREA[0] // 2) if axis == "row" else slice(AREA[0] // 2, AREA[0])
            area = {"kernel": kernel[half], "scale": image["scale"][half], "shift": image["shift"][half]}
            layers = _layers(rng, SEPARATOR_FEATURES + GLOBALS + 4 * SEPARATOR_TOP, *SEPARATOR_HIDDEN, 1)
            out[axis] = {"area": area, "scanner": _kernel(rng, SCANNER, SCANNER[0]), "layers": layers}
        else:
            flat = (LINE_FEATURES + LINE_IMAGE[0] * LINE_POOL) * (1 + len(SHIFTS)) + GLOBALS + LINE_SCANNER[0] * LINE_TOP
            along = [_kernel(rng, shape, shape[2]) for shape in PREDICTED]
            out[axis] = {"image": image | {"kernel": kernel}, "scanner": _kernel(rng, LINE_SCANNER, LINE_SCANNER[0]), "layers": _layers(rng, flat, *LINE_HIDDEN, 1), "along": along, "last": _layers(rng, 1 + PREDICTED[-1][2], *PREDICTED_HIDDEN, 1)}
    return out


def _size(part: object) -> int:
    if isinstance(part, np.ndarray):
        return part.size
    return sum(_size(p) for p in (part.values() if isinstance(part, dict) else part))


def described(weights: dict) -> dict[str, int]:
    """Parameters of each part of one axis' weights and in total."""
    out = {name: _size(part) for name, part in weights.items()}
    return out | {"total": sum(out.values())}


def scored(tables: DataFrame, keys: list[str], weights: dict[str, dict]) -> DataFrame:
    """keys, at, p for every line of tables(keys, axis among them, image, features)."""
    shared = tables.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                p = line_scores(np.stack(row.image), np.stack(row.features), shared.value[row.axis])
                yield pd.DataFrame({**{k: [getattr(row, k)] * len(p) for k in keys}, "at": np.arange(len(p)), "p": p})

    kinds = ", ".join(f"{k} {tables.schema[k].dataType.simpleString()}" for k in keys)
    return tables.select(*keys, "image", "features").mapInPandas(run, f"{kinds}, at long, p double")


def scored_separators(tables: DataFrame, keys: list[str], weights: dict[str, dict]) -> DataFrame:
    """keys, start, end, p for every separator of tables(keys, axis among them, image,
    spans(start, end, features)), start and end being line numbers."""
    shared = tables.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                at = np.array([(x["start"], x["end"]) for x in row.spans])
                p = separator_scores(np.stack(row.image), at, np.array([x["features"] for x in row.spans]), shared.value[row.axis])
                yield pd.DataFrame({**{k: [getattr(row, k)] * len(p) for k in keys}, "start": at[:, 0], "end": at[:, 1], "p": p})

    kinds = ", ".join(f"{k} {tables.schema[k].dataType.simpleString()}" for k in keys)
    return tables.select(*keys, "image", "spans").mapInPandas(run, f"{kinds}, start long, end long, p double")
