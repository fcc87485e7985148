"""Hand-worked values of scalar expressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.functions import parameters
from sylvan.functions import scalar as S


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(k) for k, c in columns.items()]).collect()]


def test_windows_at_the_limits(spark):
    got = values(spark, [(9.99,), (10.0,), (24.99,), (25.0,)], "h double", w=S.window_diameter(F.col("h")))
    assert [w for (w,) in got] == pytest.approx([2.0, 1.3, 2.799, 4.75])


def test_diameters(spark):
    got = values(spark, [(0.0,), (1.3,), (11.3,)], "h double", d=S.diameter_at_breast_height(F.col("h")))
    assert [d for (d,) in got] == [0.0, 0.0, 13.44]


def test_plot_edges(spark):
    rows = [(-15.0, 0.0), (15.0, 0.0), (0.0, 15.0), (0.0, -15.0)]
    got = values(spark, rows, "x double, y double", i=S.inside_plot(F.col("x"), F.col("y")), r=S.row_of(F.col("y")))
    assert [i for i, _ in got] == [True, False, True, False] and got[2][1] == 0


def test_core_edges(spark):
    rows = [(-10.0, 0.0), (10.0, 0.0), (0.0, -10.0), (0.0, 10.0)]
    got = values(spark, rows, "x double, y double", i=S.inside_core(F.col("x"), F.col("y"), -10.0, -10.0, 10.0, 10.0))
    assert [i for (i,) in got] == [True, False, True, False]


def test_interpolation_equals_numpy(spark):
    heights, windows = [2.0, 12.0, 22.0, 32.0], [2.0, 2.5, 3.5, 5.0]
    h = [0.0, 2.0, 3.7, 12.0, 21.9, 22.0, 31.0, 32.0, 90.0]
    got = values(spark, [(x,) for x in h], "h double", w=S.interpolated_window(F.col("h"), heights, windows))
    assert [w for (w,) in got] == pytest.approx(np.interp(h, heights, windows))


def test_names(spark):
    rows = [("a_1999_b_2001_c", "plot_x_y_annotated"), ("__é--1__", "plot_annotated"), ("a_2050_", "other")]
    got = values(spark, rows, "n string, s string", y=S.without_year(F.col("n")), d=S.dataset_id(F.col("n")), p=S.plot_from_stem(F.col("s")))
    assert got == [("a_b_2001_c", "a_1999_b_2001_c", "x_y"), ("__é--1__", "--1", None), ("a_", "a_2050", None)]


def test_numbers(spark):
    rows = [(0.125, "1e3"), (0.375, "nan"), (-0.125, "x"), (float("inf"), None)]
    got = values(spark, rows, "v double, t string", q=S.quantised(F.col("v"), 0.25), f=S.optional_float(F.col("t")), z=S.finite_or_zero(F.col("v")))
    assert got[:3] == [(0.0, 1000.0, 0.125), (0.5, None, 0.375), (0.0, None, -0.125)] and got[3][1:] == (None, 0.0)


def test_integer_ids(spark):
    got = values(spark, [(3.0,), (3.0000001,), (3.1,), (float("nan"),)], "v double", i=S.integer_id(F.col("v")))
    assert got == [(3,), (3,), (None,), (0,)]


def test_decoded_parameters_keep_their_order(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.random(11)]) for k in range(50)]
    df = spark.createDataFrame(rows, "event_id long, u array<double>")
    for name in parameters.PROFILES:
        d = parameters.decode(df, name)
        assert d.filter("high <= low or w_mid < w_low").count() == 0
    assert parameters.decode_flexible(df).filter("h1 >= h2 or h2 >= h3 or w0 > w1 or w1 > w2 or w2 > w3").count() == 0
