"""Splits, folds, selections, sinks, streams, and every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sylvan import queries_raster, queries_study
from sylvan.functions import parameters
from sylvan.operators import matching, rasterize, search
from sylvan.plans import evaluation, studies
from sylvan.sources import sinks, tables
from sylvan.streaming import canopy

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SQL = {**queries_raster.SQL, **queries_study.SQL}
QUERIES = {**queries_raster.QUERIES, **queries_study.QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, duck, name):
    want = duck.sql(SQL[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert plain(map(tuple, got.select(*[f"`{c}`" for c in columns]).collect())) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_splits_are_complete_and_stable(spark):
    plots = spark.createDataFrame([(k, f"g{k % 4}") for k in range(41)], "plot_id long, collection string")
    a = {r.plot_id: r.split for r in search.stratified_split(plots).collect()}
    b = {r.plot_id: r.split for r in search.stratified_split(plots.repartition(7)).collect()}
    assert a == b and len(a) == 41 and set(a.values()) == {"tune", "validation", "test"}


def test_folds_are_even():
    starts = search.fold_starts([("a", 7), ("b", 3), ("c", 5)], 5)
    assert starts == {"a": 0, "b": 2, "c": 0}


def test_sinks_check_before_they_replace(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "tree_id long, h double")
    assert sinks.write_checked(df, path, ["tree_id"]) == 2 == sinks.existing_rows(spark, path)
    with pytest.raises(FileExistsError):
        sinks.write_checked(df, path, ["tree_id"])
    with pytest.raises(ValueError):
        sinks.write_checked(df.union(df), path, ["tree_id"], overwrite=True)
    assert sinks.existing_rows(spark, path) == 2 and sinks.existing_rows(spark, f"{path}-none") == 0
    assert sinks.json_safe({"a": [float("nan"), 1]}) == {"a": [None, 1]}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_streams_give_the_batch_result(spark, tmp_path):
    points, trees = tables.points(spark, SF), tables.tree_summary(spark, SF)
    points.repartition(4).write.parquet(f"{tmp_path}/points")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/points")
    bases = rasterize.tree_bases(points)
    q = canopy.canopy_stream(stream, bases, trees).writeStream.format("memory").queryName("canopy").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.plot_id, r.row_, r.col): r.h for r in spark.sql("SELECT * FROM canopy").collect()}
    want = {(r.plot_id, r.row_, r.col): r.h for r in rasterize.canopy_height(points, trees).collect()}
    assert got == want


def test_trial_windows_drop_late_events(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0), ("2024-01-01 01:10:00", "b", 5.0)]
    df = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    found = {(str(r.start), r.event_type): (r.n, r["mean"]) for r in canopy.trial_windows(df).collect()}
    assert found == {("2024-01-01 00:00:00", "a"): (2, 2.0), ("2024-01-01 01:00:00", "b"): (1, 5.0)}


def test_proposals_use_the_whole_forest_and_pool(spark, monkeypatch):
    sizes = []
    real = studies.predicted

    def spy(model, pool, dimensions):
        out = real(model, pool, dimensions)
        rows = {r.candidate_id: r.features for r in studies.unpacked(pool, dimensions).filter("candidate_id < 3").collect()}
        for i, mean, deviation in out[:3]:
            votes = [t.predict(rows[i]) for t in model.trees[:3]]
            assert votes == studies.votes_of(model, rows[i].toArray()[None])[:3, 0].tolist()
            assert mean == pytest.approx(model.predict(rows[i])) and deviation >= 0
        sizes.append((model.getNumTrees, len(out)))
        return out

    monkeypatch.setattr(studies, "predicted", spy)
    assert queries_study.h06_surrogate_proposal(spark, "").count() == 1
    assert queries_study.h07_leave_one_out_proposal(spark, "").count() == 1
    assert sizes == [(300, 2048)] * 4


def test_no_split_stays_empty(spark):
    plots = spark.createDataFrame([(k, f"site{k}") for k in range(5)], "plot_id long, collection string")
    sizes = {r.split: r["count"] for r in search.stratified_split(plots).groupBy("split").count().collect()}
    assert sizes == {"tune": 3, "validation": 1, "test": 1}
    with pytest.raises(ValueError):
        search.stratified_split(plots.limit(2))
    assert search.stratified_split(plots.limit(0)).collect() == []


def test_a_source_without_crowns_counts_nothing_and_an_unknown_plot_is_an_error(spark):
    names = ("tp", "fp", "fn", "ignored", "gt_area", "pred_area", "iou_sum", "dice_sum", "common_area")
    rows = [(1, 2, 0, 0, 0, 1.0, 1.0, 1.6, 1.7, 1.0), (2, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    counts = spark.createDataFrame(rows, "plot_id long, " + ", ".join(f"{n} {'long' if k < 4 else 'double'}" for k, n in enumerate(names)))
    plots = spark.createDataFrame([(1, "a"), (2, "b")], "plot_id long, collection string")
    r = matching.source_balanced(counts, plots).first()
    assert (r.sources, round(r.mean_pq, 9), round(r.std_pq, 9)) == (2, 0.4, 0.4)
    with pytest.raises(Exception, match="no source for plot"):
        matching.source_balanced(counts, plots.filter("plot_id = 1")).collect()


def test_parameter_rules_names_and_signatures(spark):
    base = {**parameters.BASELINE, **parameters.PREPROCESSING}
    rows = [base, base | {"median_filter_size": 2}, base | {"lmf_high_height_limit": 5.0}, base | {"min_height": float("nan")}, base | {"lmf_low_window_size": 0.0}]
    found = studies.validation(spark.createDataFrame([tuple(map(float, r.values())) for r in rows], list(base))).first().asDict()
    assert found["n"] == 5 and {k: v for k, v in found.items() if v != 5 and k != "n"} == {"finite": 4, "median_odd": 4, "limits_ordered": 4, "low_window": 4}
    assert parameters.fractions([0.75, 0.25, 0.5], 0.5) == [0.25, 0.5, 0.75]
    for bad in (0.0, 1.5, float("nan")):
        with pytest.raises(ValueError):
            parameters.fractions([bad], 0.5)
    assert parameters.signature(base) == parameters.signature(dict(reversed(base.items()))) and len(parameters.signature(base)) == 12
    assert parameters.signature(base) != parameters.signature(base | {"lmf_mid_slope": 0.10001})


def test_evaluation_of_candidates_in_one_job(spark):
    """Two crowns: the baseline finds them, a window that is too wide one of them, a broken set fails."""
    cone = lambda p, r0, c0: [(p, r, q, 12.0 - 1.5 * ((r - r0) ** 2 + (q - c0) ** 2) ** 0.5) for r in range(r0 - 3, r0 + 4) for q in range(c0 - 3, c0 + 4)]
    cells = cone(1, 20, 20) + cone(1, 20, 30)
    raster = spark.createDataFrame(cells, "plot_id long, row_ int, col int, h double")
    gt = spark.createDataFrame([(p, 1 + (q > 25), r, q) for p, r, q, _ in cells], "plot_id long, tree_id long, row_ int, col int")
    base = parameters.BASELINE | {"median_filter_size": 1}
    wide = base | {"lmf_low_window_size": 14.0, "lmf_mid_slope": 0.0, "lmf_mid_intercept": 14.0}
    names = list(base)
    sets = [(k, *(float(s[n]) if isinstance(base[n], float) else s[n] for n in names)) for k, s in enumerate((base, wide, base | {"median_filter_size": 4}))]
    candidates = spark.createDataFrame(sets, "candidate_id long, " + ", ".join(f"{n} {'double' if isinstance(base[n], float) else 'int'}" for n in names))
    plots = spark.createDataFrame([(1, "a")], "plot_id long, collection string")
    runs = evaluation.runs_of(candidates, plots.select("plot_id"))
    found = {r.candidate_id: r for r in evaluation.evaluate(raster, gt, gt.limit(0), runs, "candidate_id", plots=plots).collect()}
    assert [found[k].status for k in range(3)] == ["complete", "complete", "failed"]
    assert found[0].score == 1.0 and found[0].source_balanced_pq == 1.0 and found[1]["recall@0.50"] <= 0.5 and found[2].score == -1.0


def test_tables_are_replaced_together_or_not(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    rows = spark.createDataFrame([(1, 1.0), (2, float("nan"))], "k long, v double")
    assert sinks.write_together({a: (rows, ["k"]), b: (rows, ["k"])}, same_keys=True) == {a: 2, b: 2}
    with pytest.raises(FileExistsError):
        sinks.write_together({a: (rows, ["k"])})
    more = rows.union(spark.createDataFrame([(3, 2.0)], "k long, v double"))
    for bad, keys in ((more, True), (more.union(rows), False)):
        with pytest.raises(ValueError):
            sinks.write_together({a: (more, ["k"]) if not keys else (rows, ["k"]), b: (bad, ["k"])}, overwrite=True, same_keys=keys)
        assert sinks.existing_rows(spark, a) == sinks.existing_rows(spark, b) == 2
    assert sinks.write_together({a: (more, ["k"]), b: (more, ["k"])}, overwrite=True, same_keys=True) == {a: 3, b: 3}
    assert sorted(os.listdir(tmp_path)) == ["a", "b"]


def test_reports_and_digests(spark, tmp_path):
    import hashlib

    from sylvan.sources import manifest

    sinks.write_report(spark.createDataFrame([(2, float("nan")), (1, 0.5)], "k long, v double"), f"{tmp_path}/r", "k")
    (file,) = [f"{tmp_path}/r/{n}" for n in os.listdir(f"{tmp_path}/r") if n.endswith(".csv")]
    with open(file, "rb") as f:
        data = f.read()
    assert data.decode().split() == ["k,v", "1,0.5", "2,"] or data.decode().split() == ["k,v", "1,0.5", '2,""']
    assert [r.sha256 for r in manifest.file_digests(spark, file).collect()] == [hashlib.sha256(data).hexdigest()]


def test_the_baseline_is_the_first_candidate(spark):
    found = studies.initial_candidates(spark, 6, 1).orderBy("candidate_id").collect()
    assert [r.candidate_id for r in found] == list(range(7)) and all(found[0][k] == v for k, v in parameters.BASELINE.items())
