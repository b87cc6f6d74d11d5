"""Contract checks, label reports, calibration, profile and report tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hostlens.functions.explanation import is_valid_cell
from hostlens.operators import calibration, evaluation, profiling, reporting
from hostlens.operators.validation import validate_features
from hostlens.plans.evaluate import (
    calibration_job, gate_job, gates_from_files, quality_gates)
from hostlens.settings import FEATURE_COLUMNS
from hostlens.sources.sinks import load_calibrator, save_calibrator

GOOD = '{"positive": ["bright rooms"], "issues": [], "suggestions": []}'


def table(spark, *changes):
    base = {
        "listing_id": "home-17", "quality_score": 71.5, "photo_technical": 64.0,
        "photo_aesthetic": 58.0, "room_coverage": 66.5, "amenity_check": 91.0,
        "text_quality": 77.0, "completeness": 82.0, "photo_status": "ok",
        "version": "t-4", "quality_engine_version": "9.8.7",
        "config_version": "t-conf-2", "explanation_json": GOOD,
    }
    kinds = ["string", *["double"] * 7, *["string"] * 5]
    schema = ", ".join(f"{c} {k}" for c, k in zip(FEATURE_COLUMNS, kinds, strict=True))
    return spark.createDataFrame([tuple({**base, **c}.values()) for c in changes], schema)


def test_contract(spark):
    assert validate_features(table(spark, {})).first().passes
    empty = validate_features(table(spark, {}).limit(0)).first()
    assert empty.row_count == 0 and not empty.passes
    nan = validate_features(table(spark, {"quality_score": float("nan")})).first()
    assert (nan.non_finite_quality_scores, nan.quality_score_out_of_range) == (1, 0)
    inf = validate_features(table(spark, {"photo_technical": float("inf")})).first()
    assert (inf.non_finite_component_scores, inf.component_scores_out_of_range) == (1, 1)
    two = validate_features(table(spark, {}, {"explanation_json": "not json"})).first()
    assert (two.duplicate_listing_ids, two.invalid_explanation_json) == (1, 1)
    ids = validate_features(table(spark, {"listing_id": " "}, {"listing_id": None})).first()
    assert ids.listing_id_missing == 2 and not ids.passes
    with pytest.raises(ValueError, match="quality_score"):
        validate_features(table(spark, {}).drop("quality_score"))


def test_explanation_cells(spark):
    good = [GOOD, f"  {GOOD}\n", '{"suggestions":[],"issues":[[1]],"positive":[1,{"a":null}]}',
            '{"positive":[],"positive":["b"],"issues":[],"suggestions":[]}']
    bad = [
        f"{GOOD} x", f"{GOOD}{GOOD}", f"{GOOD}],[1", f'{GOOD},"z":1', "not json", "[]", "", None,
        '{"positive": [NaN], "issues": [], "suggestions": []}',
        '{"positive": [], "issues": [], "suggestions": [], "x": Infinity}',
        '{"positive": [], "issues": []}', '{"positive": "a", "issues": [], "suggestions": []}',
        '{"positive": null, "issues": [], "suggestions": []}',
        '{"positive": [], "issues": [], "suggestions": [],}',
        "{'positive': [], 'issues': [], 'suggestions': []}",
    ]
    df = spark.createDataFrame([(c,) for c in good + bad], "c string")
    found = [r[0] for r in df.select(is_valid_cell(F.col("c"))).collect()]
    assert found == [True] * len(good) + [False] * len(bad)


def test_reports_with_functions(spark):
    labels = spark.createDataFrame(
        [("north.png", "pool"), ("south.png", "view"), ("east.png", "pool")], "photo_file string, label string"
    )

    @F.pandas_udf("string")
    def guess(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: "view" if p.endswith("south.png") else "pool")

    report = evaluation.room_report(
        evaluation.room_pairs(labels, predictor=guess, root="/r")
    ).first()
    assert (report.accuracy, report.row_count) == (1.0, 3)
    assert report.labels == ["pool", "view"]
    assert report.confusion_matrix == [[2, 0], [0, 1]]

    blur = spark.createDataFrame(
        [("fog.png", "blurry"), ("sun.png", "sharp"), ("sea.png", "sharp"), ("fern.png", "blurry")],
        "photo_file string, label string",
    )
    found = evaluation.blur_report(evaluation.blur_pairs(
        blur, detector=lambda p: p.startswith("f")
    )).first()
    assert (found.precision, found.recall, found.row_count) == (1.0, 1.0, 4)
    none = evaluation.blur_report(evaluation.blur_pairs(
        blur, detector=lambda p: F.lit(False)
    )).first()
    assert (none.precision, none.recall) == (0.0, 0.0)
    with pytest.raises(ValueError):
        evaluation.room_pairs(labels.drop("label"))


def test_gates(spark, tmp_path):
    assert quality_gates() is None
    rows = quality_gates(table(spark, {})).collect()
    assert all(r.passes for r in rows)
    good, bad = str(tmp_path / "g"), str(tmp_path / "b")
    table(spark, {}).write.parquet(good)
    table(spark, {"quality_score": 101.0}).write.parquet(bad)
    assert gate_job(spark, good, str(tmp_path / "report"))
    assert not gate_job(spark, bad)


def test_gates_from_files(spark, tmp_path):
    from hostlens.catalog.inputs import _png

    photos = tmp_path / "shots"
    photos.mkdir()
    flat = bytes([90]) * (20 * 10 * 3)
    noisy = bytes((k * 7919 % 251) for k in range(20 * 10 * 3))
    (photos / "pool_1.png").write_bytes(_png(20, 10, flat))
    (photos / "kitchen_2.png").write_bytes(_png(20, 10, noisy))
    (tmp_path / "rooms.csv").write_text(
        "photo_file,label\npool_1.png,pool\nkitchen_2.png,kitchen\nkitchen_3.png,pool\n")
    (tmp_path / "blur.csv").write_text(
        "photo_file,label\npool_1.png,blurry\nkitchen_2.png,sharp\n")
    table(spark, {}).write.parquet(str(tmp_path / "features"))
    out = str(tmp_path / "out")
    passes = gates_from_files(
        spark, out, str(tmp_path / "features"), str(tmp_path / "rooms.csv"),
        str(tmp_path / "blur.csv"), str(photos))
    rows = {(r.check, r.metric): r.value for r in spark.read.parquet(f"{out}/gates").collect()}
    assert rows["blur_precision", "precision"] == 1.0 and rows["blur_precision", "row_count"] == 2
    assert rows["room_accuracy", "accuracy"] == 0.6667 and not passes
    cells = {tuple(r) for r in spark.read.parquet(f"{out}/confusion").collect()}
    assert cells == {("pool", "pool", 1), ("kitchen", "kitchen", 1), ("pool", "kitchen", 1)}
    table(spark, {}).drop("version").write.parquet(str(tmp_path / "short"))
    assert not gates_from_files(spark, str(tmp_path / "o2"), str(tmp_path / "short"))
    assert gates_from_files(spark, str(tmp_path / "o3"), str(tmp_path / "features"))
    assert gates_from_files(spark, str(tmp_path / "o4")) is None


def test_linear_fit(spark, tmp_path):
    pairs = spark.createDataFrame(
        [(float(x), float(2 * x + 1)) for x in (3, 4, 9, 12)], "raw double, human double"
    )
    line = calibration.fit_line(pairs).first()
    assert (round(line.slope, 3), round(line.intercept, 3), line.points) == (2.0, 1.0, 4)
    one = calibration.fit_line(pairs.limit(1)).first()
    assert (one.slope, one.intercept) == (1.0, 0.0)
    flat = calibration.fit_line(pairs.withColumn("raw", F.lit(3.0))).first()
    assert (flat.slope, flat.intercept) == (0.0, 15.0)
    save_calibrator(calibration.fit_line(pairs), str(tmp_path / "line"))
    slope, intercept = load_calibrator(spark, str(tmp_path / "line"))
    assert slope == pytest.approx(2.0) and intercept == pytest.approx(1.0)


def test_bad_calibrator_files(spark, tmp_path):
    cases = {"broken": "}} 12 {", "text": '{"slope": "x"}', "empty": ""}
    for name, body in cases.items():
        (tmp_path / name).write_text(body)
        assert load_calibrator(spark, str(tmp_path / name)) is None, name
    assert load_calibrator(spark, str(tmp_path / "absent")) is None
    (tmp_path / "part").write_text('{"slope": 2}')
    assert load_calibrator(spark, str(tmp_path / "part")) == (2.0, 0.0)


def test_ratings_stay_with_their_photo(spark, tmp_path):
    photos = spark.createDataFrame(
        [("a", 10.0), ("b", 20.0), ("c", 30.0)], "path string, aesthetic_raw double"
    )
    ratings = spark.createDataFrame(
        [("a", 15.0), ("gone", 99.0), ("b", None), (" c ", 35.0)],
        "photo_file string, avg_rating double",
    )
    found = {r.path: (r.raw, r.human) for r in
             calibration.rated_photos(ratings, photos).collect()}
    assert found == {"a": (10.0, 15.0), "c": (30.0, 35.0)}
    slope, intercept = calibration_job(spark, ratings, photos, str(tmp_path / "c"))
    assert (round(slope, 6), round(intercept, 6)) == (1.0, 5.0)
    two = spark.createDataFrame([("a", 4.0, None)],
                                "photo_file string, rater1 double, rater2 double")
    assert two.select(calibration.human_rating(two)).first()[0] == 2.0
    with pytest.raises(ValueError, match="two"):
        calibration_job(spark, ratings.limit(1), photos, str(tmp_path / "d"))


def test_profile_without_vertical(spark):
    listings = spark.createDataFrame(
        [("a", "X", None), ("b", "X", "[]"), ("c", None, None)],
        "listing_id string, city string, amenities string",
    )
    photos = spark.createDataFrame([("e", 1), ("e", 2), (None, 3)], "entity_id string, seq int")
    rows = {(r.metric, r.key): r.value for r in
            profiling.data_profile(listings, photos, listings).collect()}
    assert rows["stay listings", ""] == 3 and rows["unique cities", ""] == 1
    assert rows["missing values", "amenities"] == 2
    assert ("missing values", "listing_id") not in rows
    assert rows["top city", "X"] == 2
    assert (rows["rows", ""], rows["entities", ""], rows["photos per entity", ""]) == (3, 1, 2)


def test_report_tables(spark):
    cell = ('{"positive": ["p"], "issues": [], "suggestions": [], "bad_photos": [{"path": '
            '"pics/door.png", "reason": "Below configured resolution target; room guess: '
            'exterior (61% classifier confidence)", "width": 640, "height": 480}, '
            '{"path": "x", "reason": "a_b", "width": null, "height": null}]}')
    features = table(
        spark, {"quality_score": 70.0, "explanation_json": cell},
        {"listing_id": "b", "quality_score": 90.0}, {"listing_id": "a", "quality_score": 70.0},
    )
    ranked = {r["rank"]: r for r in reporting.ranked(features).collect()}
    assert [ranked[i].listing_id for i in (1, 2, 3)] == ["b", "a", "home-17"]
    assert ranked[3].level == "GOOD" and ranked[1].level == "EXCELLENT"
    assert [r.listing_id for r in reporting.ranked(features, top=1).collect()] == ["b"]
    flags = {r.path: r.flag for r in reporting.photo_flags(features).collect()}
    assert flags == {
        "pics/door.png": "Below configured resolution target; room guess: exterior "
                         "(61% classifier confidence); 640 x 480 px (0.31 MP)",
        "x": "a b",
    }
    assert reporting.report_totals(features.limit(0)).first().mean_score == 0.0


def test_accuracy_has_four_decimals_and_its_gate_sees_them(spark):
    def pairs(hits, n):
        return spark.range(n).select(F.lit("view").alias("truth"), F.when(
            F.col("id") < hits, "view").otherwise("other").alias("predicted"))

    # 861 of 1013 is 0.84995..., just under the gate before rounding
    for hits, n, accuracy, passes in [(861, 1013, 0.85, True), (860, 1013, 0.849, False),
                                      (1, 3, 0.3333, False), (2, 3, 0.6667, False)]:
        assert evaluation.room_accuracy(pairs(hits, n)).first() == (accuracy, n)
        gate = quality_gates(room_pairs=pairs(hits, n)).filter("metric = 'accuracy'").first()
        assert (gate["value"], gate["passes"]) == (accuracy, passes)
