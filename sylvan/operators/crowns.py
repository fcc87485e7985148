"""Sequential raster kernels, one Arrow call for each plot: crown growth from seeds, components, mask cleaning.

Plots are independent, so a task holds one plot's dense arrays at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.functions import scalar as S

#: Neighbours in the order in which a flooded cell looks at them (four first, then diagonals).
NEIGHBOURS = ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1))


class Flood:
    """A binary heap of cells by priority. Equal priorities leave in an order that the flood's result depends on:
    entries rise while strictly greater than their parent; on removal the last entry sinks from the root, compared in
    single precision, to the right child unless the left is greater."""

    def __init__(self) -> None:
        self.heap: list[tuple[float, int, int, int]] = []

    def push(self, entry: tuple[float, int, int, int]) -> None:
        heap, at = self.heap, len(self.heap)
        heap.append(entry)
        while at and heap[at][0] > heap[(at - 1) // 2][0]:
            up = (at - 1) // 2
            heap[at], heap[up], at = heap[up], heap[at], up

    def pop(self) -> tuple[float, int, int, int]:
        heap = self.heap
        top, last = heap[0], heap.pop()
        if not heap:
            return top
        heap[0], at, size = last, 0, len(heap)
        value = float(np.float32(last[0]))
        while True:
            left, right = 2 * at + 1, 2 * at + 2
            if right < size and value < heap[right][0]:
                child = left if heap[left][0] > heap[right][0] else right
            elif left < size and value < heap[left][0]:
                child = left
            else:
                return top
            heap[at], heap[child], at = heap[child], heap[at], child


def grow(height: np.ndarray, seeds: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Labels of all cells: seeds flood outwards, highest cells first; a cell joins its nearest labelled seed."""
    rows, cols = height.shape
    around = NEIGHBOURS[:connectivity]
    label, owner, queued = seeds.copy(), np.zeros(seeds.shape, int), np.zeros(seeds.shape, bool)
    places = [(r, c) for c in range(cols) for r in range(rows) if seeds[r, c]]
    flood = Flood()

    def near(r: int, c: int):
        return ((r + a, c + b) for a, b in around if 0 <= r + a < rows and 0 <= c + b < cols)

    for number, (r, c) in enumerate(places, 1):
        for p in near(r, c):
            if not seeds[p] and not queued[p]:
                queued[p] = True
                flood.push((float(height[p]), *p, number))
        owner[r, c], queued[r, c] = number, True
    while flood.heap:
        _, r, c, number = flood.pop()
        best = None
        for p in near(r, c):
            if label[p]:
                sr, sc = places[owner[p] - 1]
                far = (r - sr) ** 2 + (c - sc) ** 2
                if best is None or far < best[0]:
                    best = far, p
            elif not queued[p]:
                queued[p] = True
                flood.push((float(height[p]), *p, number))
        label[r, c], owner[r, c] = label[best[1]], owner[best[1]]
    return label


def dense(table: pd.DataFrame, value: str, rows: int, cols: int, fill: float) -> np.ndarray:
    out = np.full((rows, cols), fill)
    out[table["row_"], table["col"]] = table[value]
    return out


CROWNS = "plot_id long, tree_id long, row_ int, col int"


def extent(*tables: pd.DataFrame) -> tuple[int, int]:
    """Rows and columns of the grid that holds all cells, a plot's at least."""
    if any((t[["row_", "col"]] < 0).any(axis=None) for t in tables):
        raise ValueError("a cell has a negative row or column")
    return tuple(max(S.SIDE, *(int(t[c].max()) + 1 for t in tables if len(t))) for c in ("row_", "col"))


def segment(raster: DataFrame, tops: DataFrame, min_height: float | Column = 2.0, connectivity: int | Column = 8) -> DataFrame:
    """Crown cells (plot_id, tree_id, row_, col) grown from the tops over cells of at least the minimum height.

    The grid reaches as far as the raster's cells; numbers may be columns of the raster, the same for all cells of a plot.
    """

    def run(cells: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        if cells.empty or seeds.empty:
            return pd.DataFrame({"plot_id": [], "tree_id": [], "row_": [], "col": []})
        rows, cols = extent(cells, seeds)
        height = dense(cells, "h", rows, cols, 0.0)
        canopy = height >= cells["least"].iloc[0]
        label = grow(np.where(canopy, height, 0.0), dense(seeds, "tree_id", rows, cols, 0).astype(int), int(cells["around"].iloc[0]))
        r, c = np.nonzero(canopy & (label > 0))
        return pd.DataFrame({"plot_id": cells["plot_id"].iloc[0], "tree_id": label[r, c], "row_": r, "col": c})

    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    known = raster.filter("h is not null").select(
        "plot_id", "row_", "col", F.col("h").cast("double").alias("h"),
        column(min_height).cast("double").alias("least"), column(connectivity).cast("int").alias("around"),
    )
    seeds = tops.select("plot_id", "tree_id", "row_", "col")
    return known.groupBy("plot_id").cogroup(seeds.groupBy("plot_id")).applyInPandas(run, CROWNS)


def components(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Component numbers of the set cells, in row-major order of their first cells."""
    label, number = np.zeros(mask.shape, int), 0
    around = NEIGHBOURS[:connectivity]
    for start in zip(*np.nonzero(mask)):
        if label[start]:
            continue
        number += 1
        label[start], todo = number, [start]
        while todo:
            r, c = todo.pop()
            for a, b in around:
                p = r + a, c + b
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not label[p]:
                    label[p] = number
                    todo.append(p)
    return label


def largest(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """The component with most cells, the first of equal ones."""
    label = components(mask, connectivity)
    sizes = np.bincount(label.ravel())[1:]
    return label == sizes.argmax() + 1 if len(sizes) else mask


def closed(mask: np.ndarray) -> np.ndarray:
    """One closing with a 3 x 3 square, the outside counted as set in both steps."""
    windows = lambda m: np.lib.stride_tricks.sliding_window_view(np.pad(m, 1, constant_values=True), (3, 3))
    return windows(windows(mask).any((2, 3))).all((2, 3))


def filled(mask: np.ndarray) -> np.ndarray:
    """Without holes: background that four-connected steps can't leave the raster from."""
    outside = components(np.pad(~mask, 1, constant_values=True), 4)
    return (outside != outside[0, 0])[1:-1, 1:-1]


def cleaned(mask: np.ndarray) -> np.ndarray:
    return largest(filled(closed(largest(mask))))


CLEAN = "plot_id long, tree_id long, raw_cells long, clean_cells long, n_components long, clean_area_m2 double"


def clean_crowns(cells: DataFrame) -> DataFrame:
    """Of each overlapping crown: cells before and after cleaning, components, area."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros(extent(table), bool)
        mask[table["row_"], table["col"]] = True
        clean = int(cleaned(mask).sum())
        out = {"plot_id": table["plot_id"].iloc[0], "tree_id": table["tree_id"].iloc[0], "raw_cells": int(mask.sum())}
        return pd.DataFrame([out | {"clean_cells": clean, "n_components": int(components(mask).max()), "clean_area_m2": clean * 0.25}])

    return cells.groupBy("plot_id", "tree_id").applyInPandas(run, CLEAN)
