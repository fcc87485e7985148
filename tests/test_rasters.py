"""Rasters, tree tops, crowns and matching on small cases worked by hand or by brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.operators import crowns, focal, matching, rasterize, treetops

POINTS = "plot_id long, tree_id long, x double, y double, z double, cls int"
TREES = "plot_id long, tree_id long, height_m double, completely_inside int, species_code int"


def raster(spark, array, plot=1):
    rows = [(plot, r, c, float(h)) for r, line in enumerate(array) for c, h in enumerate(line) if h is not None]
    return spark.createDataFrame(rows, "plot_id long, row_ int, col int, h double")


def cells(df):
    return {(r.row_, r.col): r.h for r in df.collect()}


def test_canopy_height(spark):
    points = spark.createDataFrame(
        [(1, 7, 0.1, 0.1, 1.0, 4), (1, 7, 0.2, 0.2, 9.0, 4), (1, 3, 0.3, 0.3, 1.0, 4), (1, 3, 0.3, 0.2, 9.0, 4), (1, 0, 5.0, 5.0, 2.0, 2),
         (1, 9, 5.1, 5.1, 50.0, 4), (1, 7, 20.0, 0.0, 0.5, 4)], POINTS)
    trees = spark.createDataFrame([(1, 7, 9.0, 1, 0), (1, 3, 8.0, 1, 0)], TREES)
    got = cells(rasterize.canopy_height(points, trees))
    # tree 7's base is at 0.5 outside the square; tree 9 has no record, so its cell is empty canopy
    assert got == {(29, 30): 8.5, (20, 40): 0.0, (19, 40): 0.0}
    won = rasterize.topmost(rasterize.tree_heights(points, trees)).collect()
    assert [(r.tree_id, r.h) for r in won] == [(7, 8.5)]


def test_equal_heights_go_to_the_smaller_id(spark):
    heights = spark.createDataFrame([(1, 7, 0, 0, 5.0), (1, 3, 0, 0, 5.0), (1, 2, 0, 0, 4.0)], "plot_id long, tree_id long, row_ int, col int, h double")
    assert rasterize.topmost(heights).first().tree_id == 3


def test_nearest_fill_against_brute_force(spark):
    rng = np.random.default_rng(3)
    known = {(int(r), int(c)): float(k) for k, (r, c) in enumerate(rng.integers(0, 60, (12, 2)))}
    rows = [(1, r, c, v) for (r, c), v in known.items()]
    wanted = [(1, r, c) for r in range(0, 60, 9) for c in range(0, 60, 11)]
    found = rasterize.nearest_fill(
        spark.createDataFrame(rows, "plot_id long, row_ int, col int, h double"), spark.createDataFrame(wanted, "plot_id long, row_ int, col int"), "h"
    ).collect()
    assert len(found) == len(wanted)
    for f in found:
        best = min(((r - f.row_) ** 2 + (c - f.col) ** 2, r, c, v) for (r, c), v in known.items())
        assert (f.d2, f.h) == (best[0], best[3])


def test_focal_median_fills_holes(spark):
    got = cells(focal.focal_median(raster(spark, [[1, 2, 3], [4, None, 6], [7, 8, 9]])))
    assert got[1, 1] == 5.0 and got[0, 0] == 2.0


def test_pit_fill_counts_known_cells(spark):
    pit = [[9, 9, 9], [9, 1, 9], [9, 9, 9]]
    assert cells(focal.pit_fill(raster(spark, pit), 3, 2.0))[1, 1] == 9.0
    thin = [[9, None, 9], [None, 1, None], [9, None, 9]]
    assert cells(focal.pit_fill(raster(spark, thin), 3, 2.0))[1, 1] == 1.0


def test_gaussian_of_a_constant(spark):
    got = cells(focal.gaussian(raster(spark, np.full((5, 5), 3.0)), 0.75, 5, 5))
    assert len(got) == 25 and all(v == pytest.approx(3.0) for v in got.values())


def test_plateau_chain(spark):
    # windows of 2 m have a radius of two cells: a and b, b and c are within reach, a and c are not
    line = [[5.0, 0, 5.0, 0, 5.0]]
    tops = treetops.locate(raster(spark, line)).collect()
    assert [(t.tree_id, t.col) for t in sorted(tops, key=lambda t: t.col)] == [(1, 0), (2, 4)]


def test_tops_against_brute_force(spark):
    rng = np.random.default_rng(8)
    h = rng.integers(0, 24, (24, 24)).astype(float)
    radius = lambda v: (2.0 if v < 10 else v * 0.1 + 0.3 if v < 25 else v * 0.15 + 1.0) / 2
    least = min(radius(v) for v in h.ravel())
    kept = []
    for r, c in itertools.product(range(24), range(24)):
        near = lambda rad: [(a, b) for a, b in itertools.product(range(24), range(24)) if ((a - r) ** 2 + (b - c) ** 2) * 0.25 <= rad * rad + 1e-12]
        if h[r, c] >= 2 and h[r, c] == max(h[p] for p in near(least)):
            own = near(radius(h[r, c]))
            if all(h[p] <= h[r, c] for p in own) and not any(p in kept and h[p] == h[r, c] for p in own):
                kept.append((r, c))
    got = treetops.locate(raster(spark, h)).collect()
    assert sorted((t.row_, t.col) for t in got) == kept and sorted(t.tree_id for t in got) == list(range(1, len(kept) + 1))


def test_growth_splits_a_ridge():
    height = np.array([[9.0, 5, 2, 6, 9]])
    label = crowns.grow(height, np.array([[1, 0, 0, 0, 2]]), 4)
    assert label.tolist() in ([[1, 1, 1, 2, 2]], [[1, 1, 2, 2, 2]]) and (crowns.grow(np.zeros((4, 4)), np.eye(4, dtype=int), 8) > 0).all()


def test_heap_leaves_by_priority():
    flood, rng = crowns.Flood(), np.random.default_rng(0)
    entries = [(float(p), k, 0, 0) for k, p in enumerate(rng.integers(0, 50, 200))]
    for e in entries:
        flood.push(e)
    out = [flood.pop() for _ in entries]
    assert [e[0] for e in out] == sorted((e[0] for e in entries), reverse=True) and sorted(out) == sorted(entries)


def test_masks():
    mask = np.zeros((20, 20), bool)
    mask[5:10, 5:10] = True
    mask[7, 7] = False
    mask[14, 14] = True
    clean = crowns.cleaned(mask)
    assert clean[7, 7] and not clean[14, 14] and clean.sum() == 25
    assert crowns.components(mask).max() == 2 and crowns.components(np.eye(3, dtype=bool), 4).max() == 3


def test_assignment_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        score = np.where(rng.random((n, m)) < 0.5, 0, 1 + rng.random((n, m)))
        got = sum(score[a, b] for a, b in matching.assign(score))
        wide = score if n <= m else score.T
        best = max(sum(wide[i, p[i]] for i in range(wide.shape[0])) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert got == pytest.approx(best)


def test_best_matches(spark):
    rows = [(1, 0, 0, 6, 10, 10, 0.6), (1, 0, 1, 3, 10, 10, 0.3), (1, 1, 0, 5, 10, 10, 0.55)]
    pairs = spark.createDataFrame(rows, "plot_id long, gt_id long, pred_id long, common long, gt_cells long, pred_cells long, iou double")
    found = lambda t: {(r.gt_id, r.pred_id) for r in matching.best_matches(pairs, t).collect()}
    assert found(0.5) == {(0, 0)} and found(0.25) == {(0, 1), (1, 0)}
    assert {(r.gt_id, r.pred_id) for r in matching.unique_matches(pairs.filter("gt_id = 0")).collect()} == {(0, 0)}


def crown(spark, *labels):
    return spark.createDataFrame([(1, t, r, c) for t, cs in labels for r, c in cs], "plot_id long, tree_id long, row_ int, col int")


def test_measures(spark):
    square = [(r, c) for r in range(2) for c in range(2)]
    gt = crown(spark, (1, square), (2, [(9, 9)]))
    pred = crown(spark, (5, square), (6, [(20, 20), (20, 21)]), (7, [(30, 30)]))
    ignored = crown(spark, (8, [(20, 20)]))
    m = matching.unique_matches(matching.overlaps(gt, pred))
    found = matching.outcomes(gt, pred, ignored, m)
    status = {(r.side, r.tree_id): r.status for r in found.collect()}
    assert status == {("reference", 1): "matched", ("reference", 2): "false_negative", ("prediction", 5): "matched", ("prediction", 6): "ignored_prediction", ("prediction", 7): "false_positive"}
    got = matching.measures(matching.count_metrics(found, m), "plot_id").first()
    assert (got.tp, got.fp, got.fn, got.ignored, got.precision, got.recall, got.f1, got.mean_iou, got.pq) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 1.0, 0.5)
    d = matching.boundary_distances(m, gt, pred).first()
    assert (d.mean_m, d.p95_m, d.hausdorff_m) == (0.0, 0.0, 0.0)


def test_nothing_matches(spark):
    gt, pred = crown(spark, (1, [(0, 0)])), crown(spark, (2, [(5, 5)]))
    m = matching.unique_matches(matching.overlaps(gt, pred))
    got = matching.measures(matching.count_metrics(matching.outcomes(gt, pred, gt, m), m), "plot_id").first()
    assert (got.f1, got.mean_iou, got.pq) == (0.0, None, None)


def test_a_wide_window_over_fifty_metres(spark):
    """A cell 4.5 m from a 60 m cell, whose window has a radius of 5 m, is no top."""
    rows = [(1, 30, 30, 60.0), (1, 30, 39, 59.0), (1, 30, 59, 30.0), (1, 120, 140, 58.0)]
    tops = treetops.locate(spark.createDataFrame(rows, "plot_id long, row_ int, col int, h double")).collect()
    assert sorted((t.row_, t.col) for t in tops) == [(30, 30), (30, 59), (120, 140)]


def test_canopy_beyond_a_plots_grid(spark):
    rows = [(1, r, q, 20.0 - abs(r - 85) - abs(q - 85)) for r in range(70, 100) for q in range(70, 100)]
    raster = spark.createDataFrame(rows, "plot_id long, row_ int, col int, h double")
    tops = treetops.locate(raster)
    assert [(t.row_, t.col) for t in tops.collect()] == [(85, 85)]
    crown = crowns.segment(raster, tops).collect()
    assert len(crown) == sum(h >= 2 for *_, h in rows)
    assert focal.focal_median(raster, 3, 100, 100).count() > 0
    with pytest.raises(Exception, match="outside the grid"):
        focal.focal_median(raster, 3).collect()


def test_nearest_fill_reaches_any_distance(spark):
    known = spark.createDataFrame([(1, 0, 0, 5.0), (2, 3, 3, 1.0)], "plot_id long, row_ int, col int, h double")
    wanted = spark.createDataFrame([(1, 0, 600), (1, 2000, 1), (2, 3, 4), (3, 0, 0)], "plot_id long, row_ int, col int")
    found = sorted((r.plot_id, r.row_, r.col, r.h, r.d2) for r in rasterize.nearest_fill(known, wanted, "h").collect())
    assert found == [(1, 0, 600, 5.0, 360_000), (1, 2000, 1, 5.0, 4_000_001), (2, 3, 4, 1.0, 1)]


def test_window_parameters_are_columns(spark):
    """The same raster under two windows: a narrow one finds both cells, a wide one the higher."""
    rows = [(k, 10, c, h) for k in (1, 2) for c, h in ((10, 20.0), (14, 19.0))]
    raster = spark.createDataFrame(rows, "plot_id long, row_ int, col int, h double").withColumn("d", F.when(F.col("plot_id") == 1, 2.0).otherwise(6.0))
    tops = treetops.locate(raster, window=lambda h: F.col("d")).groupBy("plot_id").count().collect()
    assert {r.plot_id: r["count"] for r in tops} == {1: 2, 2: 1}
