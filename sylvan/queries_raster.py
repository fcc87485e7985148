"""Queries on points, rasters and tree tops, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvan.functions import scalar as S
from sylvan.operators import crowns, focal, rasterize, treetops
from sylvan.plans import tiles
from sylvan.sources.workspace import written
from sylvan.sources import manifest
from sylvan.sources.tables import plots, points, read, tree_summary, with_sql

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def chm(spark, sf):
    return rasterize.canopy_height(points(spark, sf), tree_summary(spark, sf))


def heights(spark, sf):
    return rasterize.tree_heights(points(spark, sf), tree_summary(spark, sf))


def r6(x, name):
    return F.round(x, 6).alias(name)


# canopy height and its parts


@query(with_sql("chm") + " SELECT plot_id, row_, col, h FROM chm")
def a02_canopy_height(spark, sf):
    return chm(spark, sf).select("plot_id", "row_", "col", "h")


@query(with_sql("base") + " SELECT * FROM base")
def a01_tree_bases(spark, sf):
    return rasterize.tree_bases(points(spark, sf))


CLIP = "CAST(greatest(0, least(floor((15-y)/0.5::DOUBLE), 59)) AS INT) AS row_, CAST(greatest(0, least(floor((x+15)/0.5::DOUBLE), 59)) AS INT) AS col"


@query(with_sql("points") + f""" SELECT plot_id, row_, col, count(*) AS n_points, sum(z) FILTER (cls = 2) AS ground_sum,
  count(*) FILTER (cls = 2) AS ground_count, count(DISTINCT tree_id) FILTER (tree_id > 0) AS n_trees
  FROM (SELECT *, {CLIP} FROM points) GROUP BY ALL""")
def a03_first_pass(spark, sf):
    return rasterize.first_pass(points(spark, sf))


@query(with_sql("points") + f" SELECT plot_id, row_, col, round(avg(z), 6) AS dtm FROM (SELECT *, {CLIP} FROM points) WHERE cls = 2 GROUP BY ALL")
def a04_class2_terrain(spark, sf):
    return rasterize.class2_terrain(points(spark, sf)).select("plot_id", "row_", "col", r6(c("dtm"), "dtm"))


GROUND = with_sql("points") + f""", k AS (SELECT plot_id, row_, col, min(z) AS h FROM (SELECT *, {CLIP} FROM points) WHERE cls = 2 GROUP BY ALL)"""


FILLED = GROUND + """, w AS (SELECT plot_id, CAST(r AS INT) AS row_, CAST(q AS INT) AS col FROM (SELECT DISTINCT plot_id FROM k), range(0, 60) a(r), range(0, 60) b(q)),
 filled AS (SELECT plot_id, row_, col, m.v AS h, m.d2 AS d2 FROM (
  SELECT w.plot_id, w.row_, w.col, min({'d2': (k.row_-w.row_)*(k.row_-w.row_)+(k.col-w.col)*(k.col-w.col), 'kr': k.row_, 'kc': k.col, 'v': k.h}) AS m
  FROM w JOIN k USING (plot_id) GROUP BY ALL))"""


@query(FILLED + " SELECT plot_id, row_, col, h, d2 FROM filled")
def j10_nearest_fill(spark, sf):
    known = ground_minimum(spark, sf)
    at = F.explode(F.sequence(F.lit(0), F.lit(59)))
    wanted = known.select("plot_id").distinct().withColumn("row_", at).withColumn("col", at)
    return rasterize.nearest_fill(known, wanted, "h")


def ground_minimum(spark, sf):
    cells = rasterize.with_clipped_cells(points(spark, sf)).filter(c("cls") == S.GROUND)
    return cells.groupBy("plot_id", "row_", "col").agg(F.min("z").alias("h"))


def mirrored_sql(table: str, reach: int, aggregate: str) -> str:
    """An aggregate over square windows of a 60 x 60 raster whose border is mirrored outwards."""
    at = lambda v: f"CASE WHEN {v} < 0 THEN -1 - ({v}) WHEN {v} > 59 THEN 119 - ({v}) ELSE {v} END"
    return f"""SELECT f.plot_id, f.row_, f.col, {aggregate} AS h FROM {table} f, range({-reach}, {reach + 1}) a(da), range({-reach}, {reach + 1}) b(db)
  JOIN {table} g ON g.plot_id = f.plot_id AND g.row_ = {at('f.row_ + da')} AND g.col = {at('f.col + db')} GROUP BY ALL"""


@query(FILLED + f", low AS ({mirrored_sql('filled', 2, 'min(g.h)')}) {mirrored_sql('low', 4, 'quantile_cont(g.h, 0.5)')}")
def a05_lower_envelope(spark, sf):
    known = ground_minimum(spark, sf)
    at = F.explode(F.sequence(F.lit(0), F.lit(59)))
    wanted = known.select("plot_id").distinct().withColumn("row_", at).withColumn("col", at)
    return focal.lower_envelope(rasterize.nearest_fill(known, wanted, "h").drop("d2"))


@query(with_sql("points") + """ SELECT plot_id, count(*) FILTER (cls = 2) AS ground, min(z) AS low,
  CASE WHEN count(*) FILTER (cls = 2) > 0 THEN 'class2' WHEN min(z) <= 2 THEN 'zero' ELSE 'lower-envelope' END AS dtm FROM points GROUP BY ALL""")
def a06_terrain_choice(spark, sf):
    return rasterize.terrain_choice(points(spark, sf))


@query(with_sql("winners") + " SELECT plot_id, row_, col, tree_id, h FROM winners")
def a07_topmost_labels(spark, sf):
    return rasterize.topmost(heights(spark, sf))


@query(with_sql("gt") + " SELECT plot_id, row_, col, tree_id FROM gt")
def a08_label_raster(spark, sf):
    return rasterize.label_raster(points(spark, sf), rasterize.topmost(heights(spark, sf)))


@query(with_sql("heights") + " SELECT plot_id, tree_id, row_, col, count(*) AS n, max(h) AS h FROM heights GROUP BY ALL")
def a09_crown_cells(spark, sf):
    return rasterize.crown_cells(heights(spark, sf))


@query(with_sql("heights") + """ SELECT plot_id, tree_id, count(DISTINCT row_*60+col) AS raw_cells, count(*) AS point_count_used, max(h) AS max_h,
  any_value(height_m) AS height_m, any_value(completely_inside) AS completely_inside, any_value(species_code) AS species_code,
  count(DISTINCT row_*60+col)*0.25::DOUBLE AS gt_area_m2 FROM heights GROUP BY ALL""")
def a10_crown_attributes(spark, sf):
    return rasterize.crown_attributes(rasterize.crown_cells(heights(spark, sf)), tree_summary(spark, sf))


@query(with_sql("winners") + " SELECT plot_id, tree_id, count(*) AS visible_cells, max(h) AS topmost_max_height_m, count(*)*0.25::DOUBLE AS gt_area_m2 FROM winners GROUP BY ALL")
def a11_topmost_attributes(spark, sf):
    return rasterize.topmost_attributes(rasterize.topmost(heights(spark, sf)))


@query(with_sql("chm", "winners") + """ SELECT count(*) AS differing FROM (SELECT * FROM chm WHERE h >= 2) a FULL JOIN winners b
  USING (plot_id, row_, col) WHERE a.h IS NULL OR b.h IS NULL OR abs(a.h - b.h) > 1e-5""")
def a12_consistency(spark, sf):
    return tiles.differing_cells(chm(spark, sf).filter("h >= 2"), rasterize.topmost(heights(spark, sf)))


@query(with_sql("chm") + """ SELECT plot_id, round(avg(CASE WHEN h >= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS canopy_cover,
  round(coalesce(quantile_cont(h, 0.5) FILTER (h >= 2), 0), 6) AS height_p50, round(coalesce(quantile_cont(h, 0.95) FILTER (h >= 2), 0), 6) AS height_p95,
  round(coalesce(stddev_pop(h) FILTER (h >= 2), 0), 6) AS height_sd FROM chm GROUP BY ALL""")
def a19_structural_features(spark, sf):
    from sylvan.plans.routing import structural_features

    f = structural_features(chm(spark, sf))
    return f.select("plot_id", *[r6(c(n), n) for n in ("canopy_cover", "height_p50", "height_p95", "height_sd")])


@query(with_sql("chm") + """ SELECT CASE WHEN max(h) >= 24 THEN 'tall' ELSE 'low' END AS status, count(*) AS cells, count(DISTINCT plot_id) AS plots FROM chm
  GROUP BY plot_id % 4""")
def a20_run_summary(spark, sf):
    by = chm(spark, sf).groupBy((c("plot_id") % 4).alias("g")).agg(F.max("h").alias("m"), F.count("*").alias("cells"), F.countDistinct("plot_id").alias("plots"))
    return by.select(F.when(c("m") >= 24, "tall").otherwise("low").alias("status"), "cells", "plots")


# scalar expressions


@query(with_sql("inside") + " SELECT plot_id, row_, col, count(*) AS n FROM inside GROUP BY ALL")
def s01_point_cells(spark, sf):
    return rasterize.with_cells(points(spark, sf)).groupBy("plot_id", "row_", "col").agg(F.count("*").alias("n"))


@query(with_sql("points") + f" SELECT plot_id, row_, col, count(*) AS n FROM (SELECT *, {CLIP} FROM points) GROUP BY ALL")
def s02_clipped_cells(spark, sf):
    return rasterize.with_clipped_cells(points(spark, sf)).groupBy("plot_id", "row_", "col").agg(F.count("*").alias("n"))


@query(with_sql("points") + """ SELECT plot_id, count(*) FILTER (x >= -15 AND x < 15 AND y > -15 AND y <= 15) AS inside,
  count(*) FILTER (tree_id > 0 AND cls IN (4,5,6)) AS semantic, count(*) FILTER (tree_id > 0 AND cls NOT IN (2,3)) AS instance,
  count(*) FILTER (cls NOT IN (2,3)) AS non_ground FROM points GROUP BY ALL""")
def s03_s04_s05_s06_point_filters(spark, sf):
    n = lambda x: F.count(F.when(x, 1))
    return points(spark, sf).groupBy("plot_id").agg(
        n(S.inside_plot(c("x"), c("y"))).alias("inside"), n(S.semantic_tree(c("tree_id"), c("cls"))).alias("semantic"),
        n(S.instance_tree(c("tree_id"), c("cls"))).alias("instance"), n(S.non_ground(c("cls"))).alias("non_ground"),
    )


@query("""SELECT l_linenumber, count(*) AS n, sum(CASE WHEN abs(v - round_even(v, 0)) <= 1e-6 THEN CAST(round_even(v, 0) AS BIGINT) END) AS ids,
  count(*) FILTER (abs(v - round_even(v, 0)) > 1e-6) AS bad FROM (SELECT l_linenumber, l_suppkey + CASE WHEN l_partkey % 5 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS v FROM lineitem) GROUP BY ALL""")
def s07_integer_ids(spark, sf):
    v = c("l_suppkey") + F.when(c("l_partkey") % 5 == 0, F.lit(0.25)).otherwise(F.lit(0.0))
    found = read(spark, sf, "lineitem").select("l_linenumber", S.integer_id(v).alias("i"))
    return found.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum("i").alias("ids"), F.count(F.when(c("i").isNull(), 1)).alias("bad"))


@query(with_sql("points", "base") + """ SELECT plot_id, tree_id, sum(greatest(z - base, 0)) AS clamped, count(*) FILTER (z - base >= 2) AS tall
  FROM points JOIN base USING (plot_id, tree_id) GROUP BY ALL""")
def s08_s09_height_over_base(spark, sf):
    p = points(spark, sf)
    found = p.join(rasterize.tree_bases(p), ["plot_id", "tree_id"])
    return found.groupBy("plot_id", "tree_id").agg(
        F.sum(S.above_base(c("z"), c("base"))).alias("clamped"), F.count(F.when(c("z") - c("base") >= S.CUTOFF, 1)).alias("tall")
    )


@query(with_sql("heights") + " SELECT plot_id, tree_id, count(*) AS n, sum(h) AS total FROM heights GROUP BY ALL")
def s10_plausible_points(spark, sf):
    return heights(spark, sf).groupBy("plot_id", "tree_id").agg(F.count("*").alias("n"), F.sum("h").alias("total"))


@query(with_sql("points") + " SELECT plot_id, min(x + 1000*plot_id) AS left_, max(y + 500000) AS top FROM points GROUP BY ALL")
def s11_global_coordinates(spark, sf):
    return points(spark, sf).groupBy("plot_id").agg(F.min(c("x") + 1000 * c("plot_id")).alias("left_"), F.max(c("y") + 500000).alias("top"))


@query(with_sql("chm") + """ SELECT DISTINCT h, CASE WHEN h < 10 THEN 2.0::DOUBLE WHEN h < 25 THEN h*0.1::DOUBLE + 0.3::DOUBLE ELSE h*0.15::DOUBLE + 1.0::DOUBLE END AS w,
  CASE WHEN h <= 2 THEN 2.0::DOUBLE WHEN h < 12 THEN 2.0 + (h-2)*0.05::DOUBLE WHEN h < 22 THEN 2.5 + (h-12)*0.1::DOUBLE WHEN h < 32 THEN 3.5 + (h-22)*0.15::DOUBLE ELSE 5.0 END AS flexible,
  round_even((greatest(h-1.3::DOUBLE,0)*0.6::DOUBLE + sqrt(greatest(h-1.3::DOUBLE,0)*0.6::DOUBLE*(greatest(h-1.3::DOUBLE,0)*0.6::DOUBLE) + 4.0::DOUBLE*greatest(h-1.3::DOUBLE,0)*10))/2.0::DOUBLE*100, 0)/100 AS dbh FROM chm""")
def s12_s13_s14_windows_and_diameters(spark, sf):
    flexible = S.interpolated_window(c("h"), [2.0, 12.0, 22.0, 32.0], [2.0, 2.5, 3.5, 5.0])
    return chm(spark, sf).select(
        "h", S.window_diameter(c("h")).alias("w"), flexible.alias("flexible"), S.diameter_at_breast_height(c("h")).alias("dbh")
    ).distinct()


@query(with_sql("chm") + """ SELECT plot_id, count(*) AS n, sum(-15 + (col + 0.5::DOUBLE)*0.5::DOUBLE) AS sx, sum(15 - (row_ + 0.5::DOUBLE)*0.5::DOUBLE) AS sy FROM chm
  WHERE -15 + (col + 0.5::DOUBLE)*0.5::DOUBLE >= -10 AND -15 + (col + 0.5::DOUBLE)*0.5::DOUBLE < 10 AND 15 - (row_ + 0.5::DOUBLE)*0.5::DOUBLE >= -10 AND 15 - (row_ + 0.5::DOUBLE)*0.5::DOUBLE < 10 GROUP BY ALL""")
def s15_s16_core_cells(spark, sf):
    x, y = S.centre_x(c("col")), S.centre_y(c("row_"))
    core = chm(spark, sf).filter(S.inside_core(x, y, -10.0, -10.0, 10.0, 10.0))
    return core.groupBy("plot_id").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"))


NAMES = "SELECT p_partkey, p_name || '_1999_' || p_brand || '_2001_x' AS name, 'plot_' || p_type || CASE WHEN p_size % 2 = 0 THEN '_annotated' ELSE '' END AS stem FROM part"


@query(f"""WITH n AS ({NAMES}) SELECT p_partkey, trim(regexp_replace(name || '!', '[^A-Za-z0-9_-]+', '_', 'g'), '_') AS dataset,
  regexp_replace(name, '_(?:19|20)[0-9]{{2}}_', '_') AS no_year, regexp_replace(regexp_replace(stem, '_annotated$', ''), '^plot_', '') AS requested,
  nullif(regexp_extract(stem, '^plot_(.+)_annotated$', 1), '') AS plot, array_to_string(string_split(name, '_')[1:2], '_') AS grp2, string_split(name, '_')[1] AS grp1,
  substr(sha256(name), 1, 12) AS signature FROM n""")
def s17_to_s21_s27_names(spark, sf):
    n = read(spark, sf, "part").select(
        "p_partkey", F.concat("p_name", F.lit("_1999_"), "p_brand", F.lit("_2001_x")).alias("name"),
        F.concat(F.lit("plot_"), "p_type", F.when(c("p_size") % 2 == 0, "_annotated").otherwise("")).alias("stem"),
    )
    return n.select(
        "p_partkey", S.dataset_id(F.concat("name", F.lit("!"))).alias("dataset"), S.without_year(c("name")).alias("no_year"),
        S.requested_name(c("stem"), "plot_", "_annotated").alias("requested"), S.plot_from_stem(c("stem")).alias("plot"),
        S.group_key(c("name"), 2).alias("grp2"), S.group_key(c("name"), 1).alias("grp1"), S.short_signature(c("name")).alias("signature"),
    )


@query("""SELECT event_id, round(round_even(value/0.25::DOUBLE, 0)*0.25::DOUBLE, 8) AS q, [1, 3, 5][CAST(least(floor(u*3), 2) AS INT) + 1] AS choice,
  CASE WHEN value - 50 > 0 THEN round(value/(value - 50), 6) END AS ratio, try_cast(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS parsed,
  coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE), 0) AS or_zero
  FROM (SELECT event_id, value, CAST(event_id % 101 AS DOUBLE)/100 AS u FROM events)""")
def s22_to_s26_numbers(spark, sf):
    e = read(spark, sf, "events").withColumn("u", (c("event_id") % 101).cast("double") / 100)
    text = F.when(c("event_id") % 3 == 0, "n/a").otherwise(c("event_id").cast("string"))
    return e.select(
        "event_id", S.quantised(c("value"), 0.25).alias("q"), S.decoded_choice(c("u"), [1, 3, 5]).alias("choice"),
        F.round(S.safe_ratio(c("value"), c("value") - 50), 6).alias("ratio"), S.optional_float(text).alias("parsed"),
        S.finite_or_zero(S.optional_float(text)).alias("or_zero"),
    )


# rasters in neighbourhoods and tree tops

NEAR = "n AS (SELECT a.plot_id, a.row_ + i - {k} AS row_, a.col + j - {k} AS col, a.h, i - {k} AS da, j - {k} AS db FROM chm a, range(0, {w}) r(i), range(0, {w}) s(j) WHERE a.row_ + i - {k} BETWEEN 0 AND 59 AND a.col + j - {k} BETWEEN 0 AND 59)"


def near(k):
    return NEAR.format(k=k, w=2 * k + 1)


@query(with_sql("chm") + ", " + near(1) + " SELECT plot_id, CAST(row_ AS INT) AS row_, CAST(col AS INT) AS col, quantile_cont(h, 0.5) AS h FROM n GROUP BY ALL")
def r01_focal_median(spark, sf):
    return focal.focal_median(chm(spark, sf), 3)


PIT = ", " + near(1) + """, f AS (SELECT plot_id, row_, col, quantile_cont(h, 0.5) AS med, count(*) AS n FROM n GROUP BY ALL),
 filled AS (SELECT plot_id, CAST(row_ AS INT) AS row_, CAST(col AS INT) AS col, CASE WHEN n >= 6 AND med >= 2 AND (c.h IS NULL OR med - c.h >= 1) THEN med ELSE c.h END AS h
  FROM f LEFT JOIN chm c USING (plot_id, row_, col))"""


@query(with_sql("chm") + PIT + " SELECT * FROM filled WHERE h IS NOT NULL")
def r02_pit_fill(spark, sf):
    return focal.pit_fill(written(chm(spark, sf), "raster"), 3, 1.0)


@query(with_sql("chm") + """, pad AS (SELECT k.plot_id, CAST(r2 AS INT) AS r2, CAST(c2 AS INT) AS c2, k.h FROM (SELECT DISTINCT plot_id FROM chm) p, range(-2, 62) a(r2), range(-2, 62) b(c2)
  JOIN chm k ON k.plot_id = p.plot_id AND k.row_ = greatest(0, least(59, r2)) AND k.col = greatest(0, least(59, c2)))
 SELECT k.plot_id, k.row_, k.col, round(sum(exp(-(da*da + db*db)/(2.0::DOUBLE*0.25::DOUBLE))*pad.h)/sum(exp(-(da*da + db*db)/(2.0::DOUBLE*0.25::DOUBLE))), 6) AS h
 FROM chm k, range(-2, 3) x(da), range(-2, 3) y(db) JOIN pad ON pad.plot_id = k.plot_id AND r2 = k.row_ + da AND c2 = k.col + db GROUP BY ALL""")
def r03_gaussian(spark, sf):
    return focal.gaussian(chm(spark, sf), 0.5).select("plot_id", "row_", "col", r6(c("h"), "h"))


@query(with_sql("chm") + PIT + """, g AS (SELECT * FROM filled WHERE h IS NOT NULL),
 m AS (SELECT a.plot_id, a.row_ + i - 1 AS row_, a.col + j - 1 AS col, a.h FROM g a, range(0, 3) r(i), range(0, 3) s(j) WHERE a.row_ + i - 1 BETWEEN 0 AND 59 AND a.col + j - 1 BETWEEN 0 AND 59)
 SELECT plot_id, CAST(row_ AS INT) AS row_, CAST(col AS INT) AS col, quantile_cont(h, 0.5) AS h FROM m GROUP BY ALL""")
def r04_smoothing(spark, sf):
    return focal.smooth(written(chm(spark, sf), "raster"), median=3, pit_size=3, pit_depth=1.0)


@query("SELECT r AS radius, count(*) AS cells FROM (SELECT r, i - 12 AS a, j - 12 AS b FROM (VALUES (0.5::DOUBLE), (1.0), (1.25), (2.375), (4.75)) t(r), range(0, 25) x(i), range(0, 25) y(j)) WHERE a*a*0.25::DOUBLE + b*b*0.25::DOUBLE <= r*r + 1e-12 GROUP BY ALL")
def r05_circles(spark, sf):
    return spark.createDataFrame([(r, len(focal.circle(r))) for r in (0.5, 1.0, 1.25, 2.375, 4.75)], "radius double, cells long")


LMF = with_sql("chm") + """, v AS (SELECT *, CASE WHEN h < 10 THEN 2.0::DOUBLE WHEN h < 25 THEN h*0.1::DOUBLE + 0.3::DOUBLE ELSE h*0.15::DOUBLE + 1.0::DOUBLE END/2 AS r FROM chm),
 mr AS (SELECT plot_id, min(r) AS mr FROM v GROUP BY ALL), cand AS (SELECT v.* FROM v JOIN mr USING (plot_id) WHERE v.h >= 2 AND NOT EXISTS (
  SELECT 1 FROM chm o WHERE o.plot_id = v.plot_id AND o.row_ BETWEEN v.row_ - 5 AND v.row_ + 5 AND o.col BETWEEN v.col - 5 AND v.col + 5
   AND ((o.row_-v.row_)*(o.row_-v.row_) + (o.col-v.col)*(o.col-v.col))*0.25::DOUBLE <= mr.mr*mr.mr + 1e-12 AND o.h > v.h)),
 un AS (SELECT * FROM cand v WHERE NOT EXISTS (
  SELECT 1 FROM chm o WHERE o.plot_id = v.plot_id AND o.row_ BETWEEN v.row_ - 8 AND v.row_ + 8 AND o.col BETWEEN v.col - 8 AND v.col + 8
   AND ((o.row_-v.row_)*(o.row_-v.row_) + (o.col-v.col)*(o.col-v.col))*0.25::DOUBLE <= v.r*v.r + 1e-12 AND o.h > v.h))"""


@query(LMF + " SELECT plot_id, row_, col, h FROM cand")
def r06_candidates(spark, sf):
    return treetops.prefiltered(written(treetops.with_radius(chm(spark, sf)), "cells")).select("plot_id", "row_", "col", "h")


@query(LMF + " SELECT plot_id, row_, col, h FROM un")
def r07_unbeaten(spark, sf):
    raster = written(chm(spark, sf), "raster")
    valid = treetops.with_radius(raster)
    return treetops.unbeaten(valid, treetops.prefiltered(valid)).select("plot_id", "row_", "col", "h")


@query()
def r08_tree_tops(spark, sf):
    return treetops.locate(chm(spark, sf))


@query()
def r09_no_tree_tops(spark, sf):
    return treetops.locate(chm(spark, sf), min_height=1000.0)


@query()
def r10_r11_crowns(spark, sf):
    raster = written(chm(spark, sf), "raster")
    return crowns.segment(raster, treetops.locate(raster))


@query()
def r12_tops_equal_crowns(spark, sf):
    raster = written(chm(spark, sf), "raster")
    tops = treetops.locate(raster)
    return tiles.unpaired(tops, crowns.segment(raster, tops))


@query()
def r14_r15_clean_crowns(spark, sf):
    return crowns.clean_crowns(rasterize.crown_cells(heights(spark, sf)))


@query()
def r16_large_enough_crowns(spark, sf):
    return crowns.clean_crowns(rasterize.crown_cells(heights(spark, sf))).filter("clean_area_m2 >= 0.25")


@query(GROUND + """, i AS (SELECT plot_id, r2 AS row_, c2 AS col, h FROM (SELECT *, unnest(list_distinct([row_, CASE WHEN row_ < 2 THEN -1 - row_ ELSE row_ END, CASE WHEN row_ >= 58 THEN 119 - row_ ELSE row_ END])) AS r2 FROM k),
   LATERAL (SELECT unnest(list_distinct([col, CASE WHEN col < 2 THEN -1 - col ELSE col END, CASE WHEN col >= 58 THEN 119 - col ELSE col END])) AS c2))
 SELECT plot_id, CAST(row_ + a - 2 AS INT) AS row_, CAST(col + b - 2 AS INT) AS col, min(h) AS h FROM i, range(0, 5) p(a), range(0, 5) q(b)
 WHERE row_ + a - 2 BETWEEN 0 AND 59 AND col + b - 2 BETWEEN 0 AND 59 GROUP BY ALL""")
def r17_focal_min(spark, sf):
    return focal.focal_min(ground_minimum(spark, sf))


@query()
def h19_tile_statuses(spark, sf):
    return tiles.run_tiles(chm(spark, sf), plots(spark, sf))


# sources and sinks


@query(with_sql("plots") + """ SELECT r.name, CASE WHEN p.name IS NULL THEN 'missing' ELSE 'found' END AS status
  FROM (SELECT name FROM plots UNION ALL SELECT 'NOWHERE') r LEFT JOIN plots p USING (name)""")
def i01_discover_sources(spark, sf):
    p = plots(spark, sf)
    wanted = p.select("name").union(spark.createDataFrame([("NOWHERE",)], "name string"))
    return manifest.requested(wanted, p.select("name"), "name")


@query("SELECT s_nationkey AS plot, count(*) - count(DISTINCT s_suppkey % 50) AS duplicates FROM supplier GROUP BY ALL HAVING count(*) > count(DISTINCT s_suppkey % 50)")
def i03_duplicate_centres(spark, sf):
    s = read(spark, sf, "supplier").select(c("s_nationkey").alias("plot"), (c("s_suppkey") % 50).alias("k"))
    return manifest.duplicates(s, "plot", "k")


@query("SELECT s_suppkey AS tree_id, s_acctbal AS height_m FROM supplier WHERE s_suppkey > 0 AND s_acctbal >= 0")
def i04_tree_heights(spark, sf):
    s = read(spark, sf, "supplier").select(c("s_suppkey").alias("tree_id"), c("s_acctbal").alias("height_m"))
    return manifest.plausible_heights(s)


@query("SELECT s_suppkey AS tree_id, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS canopy_area_m2, s_suppkey % 4 <> 0 AS completely_inside FROM supplier WHERE s_suppkey > 0")
def i05_tree_records(spark, sf):
    s = read(spark, sf, "supplier").select(
        c("s_suppkey").alias("tree_id"), F.when(c("s_acctbal") >= 0, c("s_acctbal")).alias("canopy_area_m2"), (c("s_suppkey") % 4 != 0).alias("completely_inside")
    )
    return s.filter("tree_id > 0")


@query(with_sql("points", "trees") + """ SELECT p.plot_id, p.tree_id, t.height_m AS dbh FROM (SELECT DISTINCT plot_id, tree_id FROM points WHERE tree_id > 0) p
  LEFT JOIN trees t ON p.plot_id = t.plot_id AND p.tree_id = t.tree_id AND t.height_m > 0""")
def i06_field_metadata(spark, sf):
    present = points(spark, sf).filter("tree_id > 0").select("plot_id", "tree_id").distinct()
    return manifest.with_metadata(present, tree_summary(spark, sf).select("plot_id", "tree_id", c("height_m").alias("dbh")))


@query(with_sql("plots", "points") + """ SELECT p.plot_id, name, CASE WHEN p.plot_id % 3 = 0 THEN 'test' ELSE 'dev' END AS split FROM plots p
  WHERE p.plot_id IN (SELECT plot_id FROM points)""")
def i07_split_metadata(spark, sf):
    split = plots(spark, sf).select("plot_id", "name", F.when(c("plot_id") % 3 == 0, "test").otherwise("dev").alias("split"))
    return manifest.existing(split, points(spark, sf), "plot_id")


@query(with_sql("plots") + " SELECT plot_id, name FROM plots WHERE plot_id % 3 <> 0 AND name IN ('FRANCE', 'CHINA', 'JAPAN', 'NATION_1', 'NATION_2', 'NATION_4')")
def i08_select_sources(spark, sf):
    split = plots(spark, sf).select("plot_id", "name", F.when(c("plot_id") % 3 == 0, "test").otherwise("dev").alias("split"))
    return manifest.select_sources(split, ["FRANCE", "CHINA", "JAPAN", "NATION_1", "NATION_2", "NATION_4"], "dev").select("plot_id", "name")


@query(with_sql("chm") + " SELECT plot_id, row_, col, h FROM chm WHERE row_ BETWEEN 10 AND 39 AND col BETWEEN 20 AND 49")
def i09_buffered_window(spark, sf):
    return tiles.window(chm(spark, sf), 15, 25, 34, 44, buffer=5)


@query(with_sql("points") + """ SELECT plot_id, floor(min(x)/0.5::DOUBLE)*0.5::DOUBLE AS left_, ceil(max(y)/0.5::DOUBLE)*0.5::DOUBLE AS top,
  CAST((ceil(max(x)/0.5::DOUBLE) - floor(min(x)/0.5::DOUBLE))*(ceil(max(y)/0.5::DOUBLE) - floor(min(y)/0.5::DOUBLE)) AS BIGINT) AS cells FROM points GROUP BY ALL""")
def i12_grid_from_bounds(spark, sf):
    return tiles.grids(points(spark, sf))


@query(with_sql("plots") + " SELECT plot_id, coalesce(CASE WHEN plot_id % 2 = 0 THEN 'EPSG:2180' END, CASE collection WHEN 'EUROPE' THEN 'EPSG:25832' WHEN 'ASIA' THEN 'EPSG:32650' ELSE 'EPSG:32633' END) AS crs FROM plots")
def i13_reference_system(spark, sf):
    p = plots(spark, sf).withColumn("header", F.when(c("plot_id") % 2 == 0, "EPSG:2180"))
    return manifest.reference_system(p, {"EUROPE": "EPSG:25832", "ASIA": "EPSG:32650"}, "EPSG:32633").select("plot_id", "crs")


@query(with_sql("plots", "points") + " SELECT plot_id, CASE WHEN plot_id IN (SELECT plot_id FROM points) THEN 'paired' ELSE 'missing' END AS status FROM plots")
def i14_pairs(spark, sf):
    return manifest.requested(plots(spark, sf).select("plot_id"), points(spark, sf).select("plot_id").distinct(), "plot_id", "paired")


@query(with_sql("points", "trees") + """ SELECT plot_id, tree_id, CASE WHEN t.a IS NULL THEN 'missing' ELSE 'extra' END AS problem FROM
  (SELECT DISTINCT plot_id, tree_id, 1 AS g FROM points WHERE tree_id > 0) p FULL JOIN (SELECT plot_id, tree_id, 1 AS a FROM trees) t USING (plot_id, tree_id) WHERE p.g IS NULL OR t.a IS NULL""")
def i15_u01_unpaired(spark, sf):
    p = points(spark, sf).filter("tree_id > 0").select("plot_id", "tree_id").distinct()
    return manifest.mismatches(p, tree_summary(spark, sf).select("plot_id", "tree_id"), ["plot_id", "tree_id"])


@query(with_sql("winners", "trees") + """ SELECT count(*) AS crowns, count(*) - count(DISTINCT (plot_id, tree_id)) AS duplicate_ids, count(*) FILTER (tree_id IS NULL) AS null_ids, count(*) FILTER (n <= 0) AS empty_
  FROM (SELECT plot_id, tree_id, count(*) AS n FROM winners GROUP BY ALL)""")
def i17_validate_crowns(spark, sf):
    won = rasterize.topmost_attributes(rasterize.topmost(heights(spark, sf)))
    return manifest.validated(won, ["plot_id", "tree_id"], "visible_cells")


@query(with_sql("chm") + " SELECT plot_id, min(h) AS min_, max(h) AS max_, round(avg(h), 6) AS mean, round(stddev_pop(h), 6) AS std, count(*) AS valid FROM chm GROUP BY ALL")
def o01_raster_statistics(spark, sf):
    from sylvan.sources.sinks import raster_statistics

    s = raster_statistics(chm(spark, sf))
    return s.select("plot_id", "min_", "max_", r6(c("mean"), "mean"), r6(c("std"), "std"), "valid")


@query(with_sql("plots") + """ SELECT plot_id, lower(name) AS dataset_id, collection, CASE WHEN plot_id % 3 = 0 THEN 'test' ELSE 'dev' END AS split, 'chm/' || lower(name) || '.parquet' AS chm_file, 'gt/' || lower(name) || '.parquet' AS gt_file FROM plots""")
def o06_manifest(spark, sf):
    p = plots(spark, sf).withColumn("split", F.when(c("plot_id") % 3 == 0, "test").otherwise("dev"))
    return manifest.manifest(p)


@query(with_sql("plots") + """ SELECT plot_id, CASE WHEN plot_id % 2 = 0 AND plot_id % 3 = 0 THEN 'skipped' WHEN plot_id % 2 = 0 OR plot_id % 3 = 0 THEN 'error' ELSE 'run' END AS status FROM plots""")
def o10_output_protocol(spark, sf):
    p = plots(spark, sf).select("plot_id")
    done = lambda k: p.filter(c("plot_id") % k == 0)
    return manifest.protocol(p, done(2), done(3), "plot_id")


# joins


@query(with_sql("points", "base") + " SELECT plot_id, tree_id, count(*) AS n, sum(z - base) AS over FROM points JOIN base USING (plot_id, tree_id) GROUP BY ALL")
def j01_points_with_base(spark, sf):
    p = points(spark, sf)
    return p.join(rasterize.tree_bases(p), ["plot_id", "tree_id"]).groupBy("plot_id", "tree_id").agg(F.count("*").alias("n"), F.sum(c("z") - c("base")).alias("over"))


@query(with_sql("points") + f""", p AS (SELECT *, {CLIP} FROM points), d AS (SELECT plot_id, row_, col, avg(z) AS dtm FROM p WHERE cls = 2 GROUP BY ALL)
 SELECT plot_id, count(*) AS n, round(max(z - dtm), 6) AS highest FROM p JOIN d USING (plot_id, row_, col) WHERE z - dtm >= 0 GROUP BY ALL""")
def j02_points_with_terrain(spark, sf):
    p = points(spark, sf)
    found = rasterize.with_clipped_cells(p).join(rasterize.class2_terrain(p), rasterize.CELL).withColumn("h", c("z") - c("dtm"))
    return found.filter("h >= 0").groupBy("plot_id").agg(F.count("*").alias("n"), r6(F.max("h"), "highest"))


STEMS = """s AS (SELECT o_orderkey AS id, 'p' || (o_orderkey % 700) || '_' || (1990 + o_orderkey % 9) || '_a' AS name FROM orders),
 t AS (SELECT p_partkey AS k, 'p' || (p_partkey % 800) || '_' || (1990 + p_partkey % 11) || '_a' AS name FROM part)"""


@query(f"""WITH {STEMS}, sk AS (SELECT *, regexp_replace(name, '_(?:19|20)[0-9]{{2}}_', '_') AS loose FROM s),
 t1 AS (SELECT name, min(k) AS k FROM t GROUP BY ALL), tl AS (SELECT regexp_replace(name, '_(?:19|20)[0-9]{{2}}_', '_') AS loose, min(name) AS name2, min(k) AS k2 FROM t1 GROUP BY ALL HAVING count(*) = 1)
 SELECT id, sk.name, coalesce(t1.name, tl.name2) AS matched, coalesce(t1.k, tl.k2) AS k FROM sk LEFT JOIN t1 ON sk.name = t1.name LEFT JOIN tl ON sk.loose = tl.loose""")
def j03_two_stage_match(spark, sf):
    s = read(spark, sf, "orders").select(
        c("o_orderkey").alias("id"), F.concat(F.lit("p"), c("o_orderkey") % 700, F.lit("_"), 1990 + c("o_orderkey") % 9, F.lit("_a")).alias("name")
    )
    t = read(spark, sf, "part").select(
        c("p_partkey").alias("k"), F.concat(F.lit("p"), c("p_partkey") % 800, F.lit("_"), 1990 + c("p_partkey") % 11, F.lit("_a")).alias("name")
    ).groupBy("name").agg(F.min("k").alias("k"))
    return manifest.match_names(s, t)


@query(with_sql("points", "trees") + """, p AS (SELECT DISTINCT plot_id, tree_id FROM points WHERE tree_id > 0)
 SELECT plot_id, tree_id FROM p ANTI JOIN trees USING (plot_id, tree_id)""")
def j04_trees_without_record(spark, sf):
    p = points(spark, sf).filter("tree_id > 0").select("plot_id", "tree_id").distinct()
    return p.join(tree_summary(spark, sf), ["plot_id", "tree_id"], "left_anti")


@query(with_sql("winners", "trees") + " SELECT DISTINCT plot_id, tree_id FROM winners WHERE (plot_id, tree_id) IN (SELECT (plot_id, tree_id) FROM trees WHERE completely_inside = 1)")
def j05_u02_retained_crowns(spark, sf):
    won = rasterize.topmost(heights(spark, sf)).select("plot_id", "tree_id").distinct()
    return won.join(tree_summary(spark, sf).filter("completely_inside = 1"), ["plot_id", "tree_id"], "left_semi")
