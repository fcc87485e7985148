"""Queries on matching, metrics, searches and routing, and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sylvan.functions import parameters
from sylvan.operators import matching, rasterize, search
from sylvan.plans import evaluation, routing, studies
from sylvan.queries_raster import c, chm, heights, r6
from sylvan.sources.workspace import written
from sylvan.sources import manifest
from sylvan.sources.tables import plots, points, read, tree_summary, trials, with_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def reference(spark, sf, eligible: bool | None = True):
    """Exclusive reference crowns; those completely inside are eligible, the others are ignored ones."""
    won = rasterize.topmost(heights(spark, sf)).select("plot_id", "tree_id", "row_", "col")
    if eligible is None:
        return won
    keep = tree_summary(spark, sf).filter(c("completely_inside") == int(eligible)).select("plot_id", "tree_id")
    return won.join(keep, ["plot_id", "tree_id"], "left_semi")


def prediction(spark, sf):
    """Exclusive labels from fewer points and without records."""
    p = points(spark, sf)
    over = rasterize.with_cells(p.filter("cls <= 5")).join(rasterize.tree_bases(p), ["plot_id", "tree_id"])
    tall = over.withColumn("h", F.greatest(c("z") - c("base"), F.lit(0.0)))
    return rasterize.topmost(tall).select("plot_id", "tree_id", "row_", "col")


def pairs(spark, sf):
    return matching.overlaps(reference(spark, sf), prediction(spark, sf))


CROWNS = with_sql("winners", "pred", "trees") + """,
 g AS (SELECT w.plot_id, w.tree_id, row_, col FROM winners w JOIN trees t USING (plot_id, tree_id) WHERE completely_inside = 1),
 ig AS (SELECT w.plot_id, w.tree_id, row_, col FROM winners w JOIN trees t USING (plot_id, tree_id) WHERE completely_inside = 0),
 gs AS (SELECT plot_id, tree_id AS gt_id, count(*) AS gt_cells FROM g GROUP BY ALL), ps AS (SELECT plot_id, tree_id AS pred_id, count(*) AS pred_cells FROM pred GROUP BY ALL),
 pairs AS (SELECT *, common::DOUBLE/(gt_cells + pred_cells - common) AS iou FROM (SELECT g.plot_id, g.tree_id AS gt_id, p.tree_id AS pred_id, count(*) AS common
   FROM g JOIN pred p USING (plot_id, row_, col) GROUP BY ALL) JOIN gs USING (plot_id, gt_id) JOIN ps USING (plot_id, pred_id)),
 io AS (SELECT plot_id, pred_id, max(common::DOUBLE/pred_cells) AS overlap FROM (SELECT i.plot_id, i.tree_id AS gt_id, p.tree_id AS pred_id, count(*) AS common
   FROM ig i JOIN pred p USING (plot_id, row_, col) GROUP BY ALL) JOIN ps USING (plot_id, pred_id) GROUP BY ALL),
 o1 AS (SELECT *, row_number() OVER (PARTITION BY plot_id, gt_id ORDER BY iou DESC, pred_id) AS r FROM pairs WHERE iou >= 0.5),
 m AS (SELECT * EXCLUDE (r, r2) FROM (SELECT *, row_number() OVER (PARTITION BY plot_id, pred_id ORDER BY iou DESC, gt_id) AS r2 FROM o1 WHERE r = 1) WHERE r2 = 1),
 oc AS (SELECT plot_id, gt_id AS tree_id, 'reference' AS side, gt_cells AS cells, CASE WHEN m.pred_id IS NULL THEN 'false_negative' ELSE 'matched' END AS status
   FROM gs LEFT JOIN (SELECT plot_id, gt_id, pred_id FROM m) m USING (plot_id, gt_id) UNION ALL
   SELECT plot_id, pred_id, 'prediction', pred_cells, CASE WHEN m.gt_id IS NOT NULL THEN 'matched' WHEN overlap >= 0.5 THEN 'ignored_prediction' ELSE 'false_positive' END
   FROM ps LEFT JOIN (SELECT plot_id, gt_id, pred_id FROM m) m USING (plot_id, pred_id) LEFT JOIN io USING (plot_id, pred_id)),
 cm AS (SELECT plot_id, count(*) FILTER (side = 'reference' AND status = 'matched') AS tp, count(*) FILTER (status = 'false_positive') AS fp,
   count(*) FILTER (status = 'false_negative') AS fn, count(*) FILTER (status = 'ignored_prediction') AS ignored,
   coalesce(sum(cells) FILTER (side = 'reference'), 0)*0.25::DOUBLE AS gt_area, coalesce(sum(cells) FILTER (side = 'prediction' AND status IN ('matched', 'false_positive')), 0)*0.25::DOUBLE AS pred_area FROM oc GROUP BY ALL),
 counts AS (SELECT cm.*, coalesce(iou_sum, 0) AS iou_sum, coalesce(dice_sum, 0) AS dice_sum, coalesce(common_area, 0) AS common_area FROM cm LEFT JOIN (
   SELECT plot_id, sum(iou) AS iou_sum, sum(2.0::DOUBLE*common/(gt_cells + pred_cells)) AS dice_sum, sum(common)*0.25::DOUBLE AS common_area FROM m GROUP BY ALL) USING (plot_id))"""
MEASURES = """tp, fp, fn, ignored, round(tp/nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp/nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2*tp/nullif(2*tp + fp + fn, 0)::DOUBLE, 6) AS f1,
 round(iou_sum/nullif(tp, 0), 6) AS mean_iou, round(2*tp/nullif(2*tp + fp + fn, 0)::DOUBLE*(iou_sum/nullif(tp, 0)), 6) AS pq, round(dice_sum/nullif(tp, 0), 6) AS mean_dice,
 round(common_area/nullif(pred_area, 0), 6) AS area_precision, round(common_area/nullif(gt_area, 0), 6) AS area_recall, round(2*common_area/nullif(pred_area + gt_area, 0), 6) AS area_dice,
 round(common_area/nullif(pred_area + gt_area - common_area, 0), 6) AS area_iou"""
DOUBLES = ("precision", "recall", "f1", "mean_iou", "pq", "mean_dice", "area_precision", "area_recall", "area_dice", "area_iou")


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def crown_tables(spark, sf):
    """Eligible and ignored reference crowns and predictions, each written once."""
    won = written(reference(spark, sf, None), "reference")
    trees = tree_summary(spark, sf).select("plot_id", "tree_id", c("completely_inside").alias("inside"))
    both = won.join(trees, ["plot_id", "tree_id"])
    part = lambda v: both.filter(c("inside") == v).drop("inside")
    return part(1), part(0), written(prediction(spark, sf), "prediction")


def found(spark, sf):
    g, ignored, p = crown_tables(spark, sf)
    m = written(matching.unique_matches(matching.overlaps(g, p)), "matches")
    return written(matching.outcomes(g, p, ignored, m), "outcomes"), m


@query(CROWNS + " SELECT plot_id, gt_id, pred_id, common, gt_cells, pred_cells, round(iou, 6) AS iou FROM pairs")
def j06_m01_overlaps(spark, sf):
    return rounded(pairs(spark, sf), "iou").select("plot_id", "gt_id", "pred_id", "common", "gt_cells", "pred_cells", "iou")


@query(CROWNS + " SELECT plot_id, pred_id, round(overlap, 6) AS overlap FROM io")
def j07_ignored_overlap(spark, sf):
    return rounded(matching.ignored_overlap(reference(spark, sf, False), prediction(spark, sf)), "overlap")


@query(CROWNS + " SELECT plot_id, gt_id, pred_id FROM m")
def m02_matches(spark, sf):
    return matching.unique_matches(pairs(spark, sf)).select("plot_id", "gt_id", "pred_id")


@query()
def m02_best_matches(spark, sf):
    return rounded(matching.best_matches(pairs(spark, sf), 0.25), "iou").select("plot_id", "gt_id", "pred_id", "iou")


@query(CROWNS + " SELECT plot_id, tree_id, side, cells, status FROM oc")
def m03_m05_outcomes(spark, sf):
    return found(spark, sf)[0]


CENTRES = """, gc AS (SELECT plot_id, tree_id AS gt_id, avg(row_) AS gr, avg(col) AS gcol FROM g GROUP BY ALL), pc AS (SELECT plot_id, tree_id AS pred_id, avg(row_) AS pr, avg(col) AS pcol FROM pred GROUP BY ALL)"""


@query(CROWNS + CENTRES + """ SELECT plot_id, gt_id, pred_id, round(iou, 6) AS iou, common*0.25::DOUBLE AS intersection_m2, round(2.0::DOUBLE*common/(gt_cells + pred_cells), 6) AS dice,
 gt_cells*0.25::DOUBLE AS gt_area_m2, pred_cells*0.25::DOUBLE AS prediction_area_m2, (pred_cells - gt_cells)*0.25::DOUBLE AS area_error_m2, abs(pred_cells - gt_cells)*0.25::DOUBLE AS absolute_area_error_m2,
 round(sqrt((gr-pr)*(gr-pr) + (gcol-pcol)*(gcol-pcol))*0.5::DOUBLE, 6) AS centroid_distance_m FROM m JOIN gc USING (plot_id, gt_id) JOIN pc USING (plot_id, pred_id)""")
def m04_match_rows(spark, sf):
    g, _, p = crown_tables(spark, sf)
    m = matching.unique_matches(matching.overlaps(g, p))
    return rounded(matching.match_rows(m, g, p), "iou", "dice", "centroid_distance_m")


@query()
def m06_m07_m08_boundary_distances(spark, sf):
    g, _, p = crown_tables(spark, sf)
    m = matching.unique_matches(matching.overlaps(g, p))
    return rounded(matching.boundary_distances(m, g, p), "mean_m", "p95_m", "hausdorff_m")


@query(CROWNS + f" SELECT plot_id, {MEASURES} FROM counts")
def a13_m09_tile_metrics(spark, sf):
    return rounded(matching.measures(matching.count_metrics(*found(spark, sf)), "plot_id"), *DOUBLES)


@query(CROWNS + f" SELECT * FROM (SELECT 1 AS all_, {MEASURES} FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(ignored)::BIGINT AS ignored, sum(gt_area) AS gt_area, sum(pred_area) AS pred_area, sum(iou_sum) AS iou_sum, sum(dice_sum) AS dice_sum, sum(common_area) AS common_area FROM counts))")
def a14_dataset_metrics(spark, sf):
    counts = matching.count_metrics(*found(spark, sf)).withColumn("all_", F.lit(1))
    return rounded(matching.measures(matching.rolled_up(counts, "all_"), "all_"), *DOUBLES)


@query(CROWNS + CENTRES + """, mr AS (SELECT plot_id, iou, sqrt((gr-pr)*(gr-pr) + (gcol-pcol)*(gcol-pcol))*0.5::DOUBLE AS d FROM m JOIN gc USING (plot_id, gt_id) JOIN pc USING (plot_id, pred_id))
 SELECT plot_id, tp, round(x.mean_d, 6) AS mean_distance, round(x.mean_iou, 6) AS mean_iou FROM counts LEFT JOIN (SELECT plot_id, avg(d) AS mean_d, avg(iou) AS mean_iou FROM mr GROUP BY ALL) x USING (plot_id)""")
def a15_j14_shape_means(spark, sf):
    o, m = found(spark, sf)
    g, _, p = crown_tables(spark, sf)
    rows = matching.match_rows(m, g, p).groupBy("plot_id").agg(
        r6(F.avg("centroid_distance_m"), "mean_distance"), r6(F.avg("iou"), "mean_iou")
    )
    return matching.count_metrics(o, m).select("plot_id", "tp").join(rows, "plot_id", "left")


@query(CROWNS.replace("WITH ", "WITH plots0 AS (SELECT CAST(n_nationkey AS BIGINT) AS plot_id, r_name AS collection FROM nation JOIN region ON n_regionkey = r_regionkey), ", 1) + """,
 sp AS (SELECT collection, coalesce(sum(iou_sum)/nullif(sum(tp) + 0.5::DOUBLE*sum(fp) + 0.5::DOUBLE*sum(fn), 0), 0) AS pq FROM counts JOIN plots0 USING (plot_id) GROUP BY ALL)
 SELECT count(*) AS sources, round(avg(pq), 6) AS mean_pq, round(stddev_pop(pq), 6) AS std_pq FROM sp""")
def a16_source_balanced(spark, sf):
    balanced = matching.source_balanced(matching.count_metrics(*found(spark, sf)), plots(spark, sf))
    return rounded(balanced, "mean_pq", "std_pq")


TOTALS = "sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(ignored)::BIGINT AS ignored, sum(gt_area) AS gt_area, sum(pred_area) AS pred_area, sum(iou_sum) AS iou_sum, sum(dice_sum) AS dice_sum, sum(common_area) AS common_area"
FLAT = {"precision": "precision", "recall": "recall", "f1": "f1", "segmentation_quality": "mean_iou", "panoptic_quality": "pq", "mean_iou": "mean_iou", "mean_dice": "mean_dice", "area_iou": "area_iou"}


def flat_sql(t: str) -> str:
    """Crowns matched at a threshold of 0.5 or more, measured over all plots: one row."""
    fields = ", ".join(f'{own} AS "{name}@{t}"' for name, own in FLAT.items())
    return f"(SELECT {fields} FROM ({CROWNS.replace('WHERE iou >= 0.5)', f'WHERE iou >= {t})')} SELECT {MEASURES} FROM (SELECT {TOTALS} FROM counts)))"


@query(f"SELECT * FROM {flat_sql('0.50')}, {flat_sql('0.75')}")
def a17_flattened(spark, sf):
    flat = evaluation.flattened(at_thresholds(spark, sf, 0.5, 0.75))
    return rounded_all(flat)


@query()
def a17_a13_flattened_at_all_thresholds(spark, sf):
    return rounded_all(evaluation.flattened(at_thresholds(spark, sf, 0.25, 0.5, 0.75)))


def at_thresholds(spark, sf, *thresholds):
    g, ignored, p = crown_tables(spark, sf)
    return {t: written(evaluation.counted(g, ignored, p, t), "counts") for t in thresholds}


def rounded_all(df):
    return df.select(*[F.round(c(f"`{n}`"), 6).alias(n) for n in df.columns])


@query(CROWNS.replace("WHERE iou >= 0.5)", "WHERE iou >= 0.75)") + f" SELECT plot_id, {MEASURES} FROM counts")
def a13_tile_metrics_at_075(spark, sf):
    return rounded(matching.measures(at_thresholds(spark, sf, 0.75)[0.75], "plot_id"), *DOUBLES)


@query()
def a13_tile_metrics_at_025(spark, sf):
    return rounded(matching.measures(at_thresholds(spark, sf, 0.25)[0.25], "plot_id"), *DOUBLES)


BALANCED = CROWNS.replace("WITH ", "WITH plots0 AS (SELECT CAST(n_nationkey AS BIGINT) AS plot_id, r_name AS collection FROM nation JOIN region ON n_regionkey = r_regionkey), ", 1) + """,
 sp AS (SELECT collection, coalesce(sum(iou_sum)/nullif(sum(tp) + 0.5::DOUBLE*sum(fp) + 0.5::DOUBLE*sum(fn), 0), 0) AS pq FROM counts JOIN plots0 USING (plot_id) GROUP BY ALL)"""


@query(f"""WITH f AS (SELECT * FROM {flat_sql('0.50')}), b AS ({BALANCED} SELECT avg(pq) AS s FROM sp)
 SELECT kind, round(coalesce(score, 0), 6) AS score FROM (SELECT 'pq' AS kind, "panoptic_quality@0.50" AS score FROM f UNION ALL SELECT 'f1', "f1@0.50" FROM f
 UNION ALL SELECT 'mean-iou', "mean_iou@0.50" FROM f UNION ALL SELECT 'area-iou', "area_iou@0.50" FROM f UNION ALL SELECT 'source-balanced-pq', s FROM b)""")
def a18_s24_objectives(spark, sf):
    counts = at_thresholds(spark, sf, 0.5)
    balanced = matching.source_balanced(counts[0.5], plots(spark, sf)).first()  # one row
    flat = evaluation.flattened(counts).withColumn("source_balanced_pq", F.lit(balanced.mean_pq).cast("double"))
    kinds = ("pq", "f1", "mean-iou", "area-iou", "source-balanced-pq")
    tables = [search.objective(flat, k).select(F.lit(k).alias("kind"), F.round("score", 6).alias("score")) for k in kinds]
    return reduce(lambda a, b: a.unionByName(b), tables)


@query()
def a18_weighted_objective(spark, sf):
    flat = evaluation.flattened(at_thresholds(spark, sf, 0.25, 0.5, 0.75))
    return search.objective(flat, "weighted-pq").select(F.round("score", 6).alias("score"))


@query(with_sql("trials") + " SELECT source, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS min, max(score) AS max FROM trials GROUP BY ALL")
def a21_fold_summary(spark, sf):
    t = trials(spark, sf).groupBy("source")
    return t.agg(r6(F.avg("score"), "mean"), r6(F.stddev_pop("score"), "std"), F.min("score").alias("min"), F.max("score").alias("max"))


# searches


@query(with_sql("trials") + """ SELECT candidate_id, source, score, n, phase, status,
 row_number() OVER (PARTITION BY phase ORDER BY CASE WHEN status = 'failed' THEN 1 ELSE 0 END, score DESC, candidate_id, source) AS rank FROM trials""")
def w01_leaderboard(spark, sf):
    return search.leaderboard(trials(spark, sf))


SOURCES = with_sql("trials") + ", b AS (SELECT candidate_id, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS min, max(score) AS max, count(*) AS sources FROM trials GROUP BY ALL)"


@query(SOURCES + " SELECT candidate_id, round(mean, 6) AS mean, round(std, 6) AS std, min, max, sources, row_number() OVER (ORDER BY mean DESC, candidate_id) AS rank FROM b")
def w02_source_leaderboard(spark, sf):
    return rounded(search.source_leaderboard(trials(spark, sf)), "mean", "std")


@query(SOURCES + " SELECT candidate_id, round(mean, 6) AS mean, round(std, 6) AS std, row_number() OVER (ORDER BY mean DESC, round(std, 9), candidate_id) AS rank FROM b")
def w03_w10_steadiest(spark, sf):
    return rounded(search.steadiest(trials(spark, sf)), "mean", "std")


@query(with_sql("trials") + """ SELECT candidate_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, max(score) AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, candidate_id) AS r FROM trials) WHERE r <= 5 GROUP BY ALL""")
def w04_candidate_pool(spark, sf):
    return search.top_of_each(trials(spark, sf), 5)


@query(with_sql("trials") + " SELECT candidate_id, source, score FROM trials ORDER BY score DESC, candidate_id, source LIMIT 1")
def w05_winner(spark, sf):
    return search.winner(trials(spark, sf)).select("candidate_id", "source", "score")


@query(with_sql("trials") + """, x AS (SELECT *, (sum(score) OVER (PARTITION BY candidate_id) - score)/nullif(count(*) OVER (PARTITION BY candidate_id) - 1, 0) AS rest FROM trials)
 SELECT source AS held_out, candidate_id, round(rest, 6) AS selection_score, score AS held_out_score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(rest, 9) DESC, candidate_id) AS r FROM x WHERE rest IS NOT NULL) WHERE r = 1""")
def w06_leave_one_source_out(spark, sf):
    return rounded(search.leave_one_source_out(trials(spark, sf)), "selection_score")


@query(with_sql("plots") + """, a AS (SELECT plot_id, collection, count(*) OVER (PARTITION BY collection) AS n, row_number() OVER (PARTITION BY collection ORDER BY md5('20260915:' || plot_id)) AS place FROM plots),
 b AS (SELECT *, greatest(1, round_even(0.6::DOUBLE*n, 0)) AS t0, greatest(1, round_even(0.2::DOUBLE*n, 0)) AS v0 FROM a),
 d AS (SELECT *, CASE WHEN t0 + v0 >= n AND n >= 3 THEN greatest(1, n - v0 - 1) ELSE t0 END AS t FROM b)
 SELECT plot_id, collection, CASE WHEN place <= t THEN 'tune' WHEN place <= t + least(v0, n - t) THEN 'validation' ELSE 'test' END AS split FROM d""")
def w07_stratified_split(spark, sf):
    return search.stratified_split(plots(spark, sf))


@query(with_sql("plots") + """, a AS (SELECT plot_id, collection, row_number() OVER (PARTITION BY collection ORDER BY md5('20260919:' || plot_id)) - 1 AS place FROM plots),
 s AS (SELECT collection, coalesce(sum(n) OVER (ORDER BY collection ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 5 AS start FROM (SELECT collection, count(*) AS n FROM a GROUP BY ALL))
 SELECT plot_id, collection, CAST((start + place) % 5 AS INT) AS fold FROM a JOIN s USING (collection)""")
def w08_stratified_folds(spark, sf):
    return search.stratified_folds(plots(spark, sf))


@query(with_sql("winners", "heights") + " SELECT DISTINCT ON (plot_id, row_, col) plot_id, row_, col, tree_id FROM heights ORDER BY plot_id, row_, col, h DESC, tree_id")
def w09_first_in_cell(spark, sf):
    return studies.first_in_cell(heights(spark, sf))


@query(with_sql("plots") + """ SELECT plot_id, collection, turn FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY md5('20260915:' || plot_id)) AS turn FROM plots) ORDER BY turn, collection LIMIT 8""")
def i16_round_robin(spark, sf):
    return search.round_robin(plots(spark, sf), 8).select("plot_id", "collection", "turn")


@query(with_sql("trials", "plots") + """ SELECT candidate_id, source, phase FROM trials WHERE phase = 'tune' UNION ALL SELECT candidate_id, source, 'full' FROM trials WHERE phase = 'validation'""")
def u03_phases(spark, sf):
    t = trials(spark, sf).select("candidate_id", "source", "phase")
    return t.filter("phase = 'tune'").unionByName(t.filter("phase = 'validation'").withColumn("phase", F.lit("full")))


@query("SELECT DISTINCT ON (k) event_id, k FROM (SELECT event_id, user_id % 97 AS k FROM events) ORDER BY k, event_id")
def u04_first_of_equal(spark, sf):
    e = read(spark, sf, "events").select("event_id", (c("user_id") % 97).alias("k"))
    return search.first_of_equal(e, "event_id", "k")


@query(with_sql("trials") + " SELECT DISTINCT candidate_id FROM trials WHERE candidate_id NOT IN (SELECT candidate_id FROM trials WHERE status = 'complete' AND source = 'click')")
def j15_unfinished(spark, sf):
    t = trials(spark, sf)
    return search.unfinished(t.select("candidate_id").distinct(), t.filter("source = 'click'"))


@query(with_sql("plots") + """ SELECT plot_id, CASE WHEN b IS NULL THEN 'missing' ELSE 'extra' END AS problem FROM (SELECT plot_id, 1 AS a FROM plots WHERE collection <> 'ASIA')
 FULL JOIN (SELECT plot_id, 1 AS b FROM plots WHERE collection <> 'EUROPE') USING (plot_id) WHERE a IS NULL OR b IS NULL""")
def j13_unmapped(spark, sf):
    p = plots(spark, sf)
    return manifest.unmapped(p.filter("collection <> 'ASIA'"), p.filter("collection <> 'EUROPE'"), "plot_id")


@query(with_sql("plots", "points") + " SELECT plot_id, collection, count(*) AS n FROM points JOIN plots USING (plot_id) GROUP BY ALL")
def j13_source_mapping(spark, sf):
    return points(spark, sf).join(plots(spark, sf), "plot_id").groupBy("plot_id", "collection").agg(F.count("*").alias("n"))


@query(with_sql("plots", "points") + " SELECT plot_id, count(*) AS n FROM points WHERE plot_id IN (SELECT plot_id FROM plots WHERE collection = 'ASIA') GROUP BY ALL")
def j16_plot_subset(spark, sf):
    keep = plots(spark, sf).filter("collection = 'ASIA'").select("plot_id")
    return points(spark, sf).join(keep, "plot_id", "left_semi").groupBy("plot_id").agg(F.count("*").alias("n"))


@query("SELECT " + ", ".join(f"{'CAST(' + repr(v) + ' AS DOUBLE)' if isinstance(v, float) else v} AS {k}" for k, v in parameters.BASELINE.items()))
def h01_baseline(spark, sf):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in parameters.BASELINE.items()])


CANDIDATES = "u AS (SELECT event_id, list_transform(range(0, 11), lambda k: CAST((event_id*(2*k + 7) + k*k*13) % 101 AS DOUBLE)/101) AS u FROM events)"
Q = "round(round_even({0}/{1}::DOUBLE, 0)*{1}::DOUBLE, 8)"


def q(expression, step):
    return Q.format(f"({expression})", step)


def candidates(spark, sf):
    k = F.sequence(F.lit(0), F.lit(10))
    e = read(spark, sf, "events")
    return e.select("event_id", F.transform(k, lambda k: ((c("event_id") * (2 * k + 7) + k * k * 13) % 101).cast("double") / 101).alias("u"))


def legacy_sql(profile: str) -> str:
    """Candidates decoded by a search profile; the list of u begins with 1 in SQL."""
    p = parameters.PROFILES[profile]
    d = lambda v: f"{v}::DOUBLE"
    span = lambda k, lo, hi: f"{lo} + u[{k}]*({hi} - {lo})"
    pick = lambda k, values: f"[{', '.join(map(str, values))}][CAST(least(floor(u[{k}]*{len(values)}), {len(values) - 1}) AS INT) + 1]"
    least = f"greatest(18, low + {p['gap']})"
    return f"""WITH {CANDIDATES}, a AS (SELECT *, {q(span(1, *map(d, p['low'])), 0.25)} AS low FROM u),
 b AS (SELECT *, {q(f"{least} + u[2]*({p['high']} - {least})", 0.25)} AS high, {q(span(3, *map(d, p['window'])), 0.25)} AS w_low FROM a),
 d AS (SELECT *, {q(f"w_low + u[4]*({d(p['mid'])} - w_low)", 0.25)} AS w_mid, {q(span(5, *map(d, p['jump'])), 0.25)} AS jump, {q(span(6, *map(d, p['slope'])), 0.01)} AS s_high FROM b),
 e AS (SELECT *, (w_mid - w_low)/(high - low) AS s_mid FROM d),
 f AS (SELECT *, w_low - s_mid*low AS i_mid, w_mid + jump - s_high*high AS i_high, {pick(7, p['median'])} AS median, {pick(8, p['connectivity'])} AS connectivity,
  {q('1 + u[9]*3', 0.25)} AS least_height FROM e)"""


LEGACY = legacy_sql("broad")
DECODED = " SELECT event_id, low, high, w_low, w_mid, jump, s_high, round(s_mid, 6) AS s_mid, round(i_mid, 6) AS i_mid, round(i_high, 6) AS i_high, median, connectivity FROM f"


@query(LEGACY + DECODED)
def h02_h04_decode(spark, sf):
    return rounded(parameters.decode(candidates(spark, sf)).drop("u"), "s_mid", "i_mid", "i_high")


@query(legacy_sql("for-instance-refined-v2") + DECODED)
def h04_decode_refined(spark, sf):
    return rounded(parameters.decode(candidates(spark, sf), "for-instance-refined-v2").drop("u"), "s_mid", "i_mid", "i_high")


@query(legacy_sql("ideas-als-small-windows-v2") + DECODED)
def h04_decode_small_windows(spark, sf):
    return rounded(parameters.decode(candidates(spark, sf), "ideas-als-small-windows-v2").drop("u"), "s_mid", "i_mid", "i_high")


@query(LEGACY + " SELECT event_id, least_height AS min_height, median AS median_filter_size, low AS lmf_low_height_limit, round(i_high, 6) AS lmf_high_intercept, connectivity AS watershed_connectivity, 4 AS polygon_connectivity FROM f")
def h02_nine_dimensions(spark, sf):
    d = parameters.named(parameters.decode(candidates(spark, sf)), tune_min_height=True)
    return rounded(d, "lmf_high_intercept").select(
        "event_id", "min_height", "median_filter_size", "lmf_low_height_limit", "lmf_high_intercept", "watershed_connectivity", "polygon_connectivity"
    )


FLEXIBLE = f"""WITH {CANDIDATES}, a AS (SELECT *, [1, 3, 5][CAST(least(floor(u[1]*3), 2) AS INT) + 1] AS pit_size, [0.0::DOUBLE, 0.5, 0.75, 1.0][CAST(least(floor(u[3]*4), 3) AS INT) + 1] AS sigma, [1, 3][CAST(least(floor(u[4]*2), 1) AS INT) + 1] AS median,
  {q('8 + 6*u[5]', 0.25)} AS h1, {q('1.5::DOUBLE + 2*u[8]', 0.25)} AS w0 FROM u), b AS (SELECT *, CASE WHEN pit_size = 1 THEN 0.0::DOUBLE ELSE {q('0.5::DOUBLE + 3.5::DOUBLE*u[2]', 0.5)} END AS pit_depth,
  {q('greatest(16, h1 + 5) + u[6]*(30 - greatest(16, h1 + 5))', 0.25)} AS h2, w0 + {q('1.25::DOUBLE*u[9]', 0.25)} AS w1 FROM a),
 d AS (SELECT *, {q('greatest(28, h2 + 5) + u[7]*(48 - greatest(28, h2 + 5))', 0.25)} AS h3, w1 + {q('2.0::DOUBLE*u[10]', 0.25)} AS w2 FROM b)
 , g AS (SELECT *, w2 + {q('2.5::DOUBLE*u[11]', 0.25)} AS w3 FROM d)"""


@query(FLEXIBLE + " SELECT event_id, pit_size, pit_depth, sigma, median, h1, h2, h3, w0, w1, w2, w3 FROM g")
def h03_decode_flexible(spark, sf):
    return parameters.decode_flexible(candidates(spark, sf)).drop("u")


def joined(values: str) -> str:
    return f"array_to_string(list_transform({values}, lambda v: CAST(CAST(round(1000*v, 0) AS BIGINT) AS VARCHAR)), ',')"


def joined_column(values):
    return F.array_join(F.transform(values, lambda w: F.round(w * 1000, 0).cast("bigint").cast("string")), ",")


@query(LEGACY + f" SELECT event_id, {joined('[2, median, low, high, w_low, round(s_mid, 8), round(i_mid, 8), s_high, round(i_high, 8), connectivity]')} AS features FROM f")
def h08_features(spark, sf):
    d = parameters.named(parameters.decode(candidates(spark, sf)))
    return d.select("event_id", joined_column(parameters.legacy_features(d)).alias("features"))


HEIGHTS = "[2, 5, 10, 15, 20, 25, 30, 35, 40, 50]"


@query(LEGACY + f""" SELECT event_id, {joined(f"list_concat([1.0::DOUBLE, 0, 0, median], list_transform({HEIGHTS}, lambda v: CASE WHEN v < low THEN w_low WHEN v < high THEN round(s_mid, 8)*v + round(i_mid, 8) ELSE s_high*v + round(i_high, 8) END), [connectivity])")} AS features FROM f""")
def h08_h09_features_of_old_candidates(spark, sf):
    d = parameters.with_defaults(parameters.named(parameters.decode(candidates(spark, sf))))
    return d.select("event_id", joined_column(parameters.features(d, False)).alias("features"))


@query(FLEXIBLE + f""" SELECT event_id, {joined(f"list_concat([pit_size::DOUBLE, pit_depth, sigma, median], list_transform({HEIGHTS}, lambda v: CASE WHEN v <= 2 THEN w0 WHEN v < h1 THEN w0 + (v - 2)*(w1 - w0)/(h1 - 2) WHEN v < h2 THEN w1 + (v - h1)*(w2 - w1)/(h2 - h1) WHEN v < h3 THEN w2 + (v - h2)*(w3 - w2)/(h3 - h2) ELSE w3 END), [4])")} AS features FROM g""")
def h08_features_of_flexible_candidates(spark, sf):
    d = parameters.named_flexible(parameters.decode_flexible(candidates(spark, sf)))
    return d.select("event_id", joined_column(parameters.features(d, True)).alias("features"))


@query(with_sql("trials") + " SELECT candidate_id, " + ", ".join(f"max(score) FILTER (source = '{s}') AS {s}" for s in ("click", "view", "purchase", "signup", "error")) + " FROM trials GROUP BY ALL")
def h10_score_vectors(spark, sf):
    return studies.score_vectors(trials(spark, sf), ["click", "view", "purchase", "signup", "error"])


@query()
def h05_initial_designs(spark, sf):
    return studies.initial_candidates(spark, 12, 20260921)


@query()
def h06_surrogate_proposal(spark, sf):
    return studies.propose(spark, studies.scored_designs(spark, 24, 8, 20260921), 8, 2048, 20260921)


@query()
def h07_leave_one_out_proposal(spark, sf):
    return studies.propose_leave_one_out(spark, studies.scored_designs(spark, 24, 8, 20260922), 8, 2048, 20260922)


RULES = """count(*) AS n, count(*) AS finite, count(*) AS min_height, count(*) FILTER (median % 2 = 1) AS median_odd, count(*) FILTER ({pit} % 2 = 1) AS pit_size_odd, count(*) FILTER ({depth} >= 0) AS pit_depth, count(*) FILTER ({sigma} >= 0) AS sigma"""


@query("SELECT * FROM (" + LEGACY + " SELECT " + RULES.format(pit=1, depth=0, sigma=0) + """, count(*) FILTER (low >= 0) AS low_limit, count(*) FILTER (high > low) AS limits_ordered, count(*) FILTER (w_low > 0) AS low_window,
 count(*) FILTER (least(low*round(s_mid, 8) + round(i_mid, 8), high*round(s_mid, 8) + round(i_mid, 8), high*s_high + round(i_high, 8)) > 0) AS windows_positive FROM f)""")
def s29_validation(spark, sf):
    return studies.validation(parameters.with_defaults(parameters.named(parameters.decode(candidates(spark, sf)))))


@query("SELECT * FROM (" + FLEXIBLE + " SELECT " + RULES.format(pit="pit_size", depth="pit_depth", sigma="sigma") + """, count(*) AS complete, count(*) FILTER (h1 > 2 AND h2 > h1 AND h3 > h2) AS heights_increase,
 count(*) FILTER (least(w0, w1, w2, w3) > 0) AS windows_positive, count(*) FILTER (w1 >= w0 AND w2 >= w1 AND w3 >= w2) AS windows_never_fall FROM g)""")
def s29_flexible_validation(spark, sf):
    return studies.validation(parameters.named_flexible(parameters.decode_flexible(candidates(spark, sf))), True)


NAMES = [*parameters.COMMON, *parameters.PREPROCESSING, *parameters.LEGACY, *parameters.FLEXIBLE, "other"]


@query(f"""WITH k AS (SELECT event_id, list_concat({list(parameters.COMMON)}, CASE event_id % 5 WHEN 0 THEN {list(parameters.LEGACY)} WHEN 1 THEN {list(parameters.FLEXIBLE)} WHEN 2 THEN {list(parameters.LEGACY + parameters.FLEXIBLE[:1])} WHEN 3 THEN {list(parameters.LEGACY[1:])} ELSE {list(parameters.LEGACY + ("other",))} END) AS keys FROM events)
 SELECT event_id, (list_has_all(keys, {list(parameters.LEGACY)}) OR list_has_all(keys, {list(parameters.FLEXIBLE)})) AND NOT (list_has_any(keys, {list(parameters.LEGACY)}) AND list_has_any(keys, {list(parameters.FLEXIBLE)})) AND NOT list_contains(keys, 'other') AS valid FROM k""")
def s32_parameter_shape(spark, sf):
    lit = lambda names: F.array(*[F.lit(n) for n in names])
    kinds = (parameters.LEGACY, parameters.FLEXIBLE, parameters.LEGACY + parameters.FLEXIBLE[:1], parameters.LEGACY[1:], parameters.LEGACY + ("other",))
    own = reduce(lambda out, k: F.when(c("event_id") % 5 == k, lit(kinds[k])).otherwise(out), range(4), lit(kinds[4]))
    return read(spark, sf, "events").select("event_id", parameters.shape_valid(F.concat(lit(parameters.COMMON), own)).alias("valid"))


@query()
def h14_structural_router(spark, sf):
    return routing.route(routing.structural_features(chm(spark, sf))).select("plot_id", "class_index")


ROUTE = with_sql("chm") + """, f AS (SELECT plot_id, avg(CASE WHEN h >= 2 THEN 1.0::DOUBLE ELSE 0 END) AS cover, coalesce(quantile_cont(h, 0.5) FILTER (h >= 2), 0) AS p50 FROM chm GROUP BY ALL)"""


@query(ROUTE + """ SELECT plot_id, m.k AS class_index FROM (SELECT plot_id, min({'d': round((cover - a)*(cover - a) + (p50 - b)*(p50 - b), 9), 'k': k}) AS m FROM f, (VALUES (0, 0.2::DOUBLE, 4.0::DOUBLE), (1, 0.6, 9.0), (2, 0.9, 14.0)) v(k, a, b) GROUP BY ALL)""")
def h15_nearest_class(spark, sf):
    f = routing.structural_features(chm(spark, sf)).withColumns({"height_p95": F.lit(0.0), "height_sd": F.lit(0.0)})
    centres = spark.createDataFrame([(0, 0.2, 4.0, 0.0, 0.0), (1, 0.6, 9.0, 0.0, 0.0), (2, 0.9, 14.0, 0.0, 0.0)], "class_index int, c_canopy_cover double, c_height_p50 double, c_height_p95 double, c_height_sd double")
    return routing.nearest_centre(f, centres)


@query(with_sql("trials", "plots") + """, p AS (SELECT candidate_id, max(score) AS s FROM trials GROUP BY ALL ORDER BY s DESC, candidate_id LIMIT 4)
 SELECT candidate_id, collection, count(*) AS plots FROM p, plots GROUP BY ALL""")
def h17_candidates_by_fold(spark, sf):
    return studies.work_list(trials(spark, sf), plots(spark, sf), 4)


def study(spark, sf, n=3):
    """A small study: the baseline and some designs."""
    return studies.initial_candidates(spark, n, 20260921)


@query()
def h11_candidate_evaluation(spark, sf):
    runs = evaluation.runs_of(study(spark, sf), plots(spark, sf).select("plot_id"))
    g, ignored, _ = crown_tables(spark, sf)
    found = evaluation.evaluate(written(chm(spark, sf), "raster"), g, ignored, runs, "candidate_id", plots=plots(spark, sf))
    return found.select("candidate_id", "status", F.round("score", 6).alias("score"), F.round("source_balanced_pq", 6).alias("source_balanced_pq"))


@query()
def h15_route_and_run(spark, sf):
    route = h15_nearest_class(spark, sf)
    frozen = study(spark, sf, 2).withColumn("class_index", c("candidate_id").cast("int")).drop("candidate_id")
    g, ignored, _ = crown_tables(spark, sf)
    found = evaluation.evaluate(written(chm(spark, sf), "raster"), g, ignored, evaluation.routed(route, frozen), "class_index")
    return found.select("class_index", "status", F.round("score", 6).alias("score"))


@query()
def h16_transfer_evaluation(spark, sf):
    """The baseline, frozen, on the plots of another collection."""
    there = plots(spark, sf).filter("collection = 'ASIA'").select("plot_id")
    keep = lambda d: d.join(there, "plot_id", "left_semi")
    runs = evaluation.runs_of(study(spark, sf).filter("candidate_id = 0"), there)
    g, ignored, _ = crown_tables(spark, sf)
    found = evaluation.evaluate(written(keep(chm(spark, sf)), "raster"), keep(g), keep(ignored), runs, "candidate_id")
    return found.select("candidate_id", "status", F.round("score", 6).alias("score"))


@query()
def h17_cross_validation(spark, sf):
    folds = search.stratified_folds(plots(spark, sf), 3)
    g, ignored, _ = crown_tables(spark, sf)
    _, ranked, _ = evaluation.cross_validated(written(chm(spark, sf), "raster"), g, ignored, study(spark, sf, 2), folds)
    return ranked.select("candidate_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), c("rank").cast("bigint").alias("rank"))
