"""Tightening word boxes to the ink of the page raster, one page at a time (a page's raster and
words fit one task)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Context of ruled lines in pixels, share of black that makes a row or column ruled, most
#: pixels of a nearly empty row, its part of the mean inked row, rows of the rolling median and its limit.
CONTEXT, RULED_ROW, RULED_COL, FEW, PART, WINDOW, NOTHING = 20, 0.85, 0.9, 2, 5, 6, 0.01


def ruled_ends(ruled: np.ndarray) -> tuple[int, int]:
    """How many lines to cut at either end: a ruled line that begins in the first quarter goes with
    the line after it, one that ends in the last quarter goes alone. One that fills the rest stays."""
    at, n, head, tail = np.flatnonzero(ruled), len(ruled), 0, 0
    if len(at) and at[0] < n // 4:
        clear = np.flatnonzero(~ruled[at[0] :])
        head = int(at[0] + clear[0] + 1) if len(clear) else 0
    if len(at) and at[-1] > n // 4 * 3:
        clear = np.flatnonzero(~ruled[: at[-1]])
        tail = int(n - 1 - clear[-1]) if len(clear) else 0
    return head, tail


def sparse_rows(black: np.ndarray) -> np.ndarray:
    """Rows whose rolling median is nothing, unless all are. A median belongs to a full window; the
    rows that have none are in the middle, and not sparse."""
    if len(black) < WINDOW:
        return np.zeros(len(black), bool)
    median = np.median(np.lib.stride_tricks.sliding_window_view(black, WINDOW), axis=1)
    nothing = (median < NOTHING) & (median.max() >= NOTHING)
    half = len(nothing) // 2
    return np.concatenate([nothing[:half], np.zeros(WINDOW - 1, bool), nothing[half:]])


def tight(ink: np.ndarray, l: int, t: int, r: int, b: int) -> tuple[int, int, int, int] | None:  # noqa: E741
    """The box (l, t, r, b) shrunk to its ink; None if no row has more than two black pixels.

    Ruled lines at its edges are told from a context of twenty pixels and cut first. A row is nearly
    empty by its count, by its count against the mean inked row, or by the rolling median; such rows
    are cut at both ends. If that leaves none, the count alone decides.
    """
    box = ink[t : b + 1, l : r + 1]
    if not box.size:
        return None
    top, bottom = ruled_ends(ink[t : b + 1, max(0, l - CONTEXT) : r + CONTEXT].mean(axis=1) >= RULED_ROW)
    left, right = ruled_ends(ink[max(0, t - CONTEXT) : b + CONTEXT + 1, l : r + 1].mean(axis=0) >= RULED_COL)
    box = box[top : box.shape[0] - bottom, left : box.shape[1] - right]
    rows, xs = box.sum(axis=1), np.flatnonzero(box.any(axis=0))
    if not len(xs):
        return None
    few = rows <= FEW
    ys = np.flatnonzero(~(few | (rows <= rows[rows > 0].mean() / PART) | sparse_rows(rows)))
    ys = ys if len(ys) else np.flatnonzero(~few)
    if not len(ys):
        return None
    return l + left + int(xs[0]), t + top + int(ys[0]), l + left + int(xs[-1]), t + top + int(ys[-1])


def tightened(words: DataFrame, ink: DataFrame, key: str) -> DataFrame:
    """words(key, pos, l, t, r, b) and ink(key, y, x) of black pixels -> words with tight boxes;
    words without ink go. Boxes are clipped at 0."""

    def run(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left.iloc[:0]
        page = np.zeros((max(right["y"].max(), left["b"].max()) + 1, max(right["x"].max(), left["r"].max()) + 1), bool)
        page[right["y"], right["x"]] = True
        out = [(i, box) for i, w in left.iterrows() if (box := tight(page, max(0, w.l), max(0, w.t), w.r, w.b))]
        kept = left.loc[[i for i, _ in out]].copy()
        kept[["l", "t", "r", "b"]] = [list(box) for _, box in out]
        return kept

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return words.groupBy(key).cogroup(ink.groupBy(key)).applyInPandas(run, kinds)
