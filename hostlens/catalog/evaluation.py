"""Queries for validation, evaluation, calibration and profiling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.catalog import views
from hostlens.catalog.inputs import (
    FINITE, RANGE, VALID_JSON, _over, csv_copy, profile_inputs, profile_of, r6, scored_photos,
)
from hostlens.catalog.registry import part, query
from hostlens.catalog.scores import rounded
from hostlens.catalog.sqltext import MISSING, half_even, joined, room_case
from hostlens.functions.explanation import is_valid_cell
from hostlens.functions.models import blur_detector, room_predictor
from hostlens.operators import calibration, evaluation, profiling
from hostlens.operators.validation import to_number, validate_features
from hostlens.plans.evaluate import calibration_job, quality_gates, room_evaluation
from hostlens.plans.profile import merged_profile, update_profile
from hostlens.session import scratch_path
from hostlens.sources import sinks
from hostlens.sources.tables import read_ratings


def cells(spark, sf) -> DataFrame:
    return views.cells(spark, sf).drop("doc_id")


# --- contract -----------------------------------------------------------------

@query("D16_contract_validation", "SELECT *, false AS passes FROM contract_counts")
def contract_validation(spark, sf):
    return validate_features(cells(spark, sf))


@query("D17_duplicate_ids", "SELECT duplicate_listing_ids, listing_id_missing "
                            "FROM contract_counts")
def duplicate_ids(spark, sf):
    return validate_features(cells(spark, sf)).select(
        "duplicate_listing_ids", "listing_id_missing"
    )


@query("D18_range_and_finiteness", f"""
SELECT {_over(RANGE)} AS component_scores_out_of_range,
  {_over(FINITE)} AS non_finite_component_scores,
  count(*) FILTER ({RANGE.format('quality_score')}) AS quality_score_out_of_range,
  count(*) FILTER ({FINITE.format('quality_score')}) AS non_finite_quality_scores
FROM v_cells""")
def range_and_finiteness(spark, sf):
    return validate_features(cells(spark, sf)).select(
        "component_scores_out_of_range", "non_finite_component_scores",
        "quality_score_out_of_range", "non_finite_quality_scores",
    )


@query("H20_explanation_validity", f"SELECT doc_id, {VALID_JSON} AS valid FROM v_cells")
def explanation_validity(spark, sf):
    return views.cells(spark, sf).select(
        "doc_id", is_valid_cell(F.col("explanation_json")).alias("valid")
    )


@query("H21_to_number", """
SELECT doc_id, n IS NULL OR isnan(n) AS is_nan,
  round(CASE WHEN isnan(n) THEN NULL ELSE n END, 6) AS number
FROM (SELECT doc_id, TRY_CAST(trim(capacity) AS DOUBLE) AS n FROM v_raw)""")
def numbers(spark, sf):
    n = to_number(F.col("capacity"))
    return views.raw_cells(spark, sf).select(
        "doc_id", F.isnan(n).alias("is_nan"), r6(F.when(~F.isnan(n), n)).alias("number")
    )


# --- labels against predictions -----------------------------------------------

part("room_pairs", f"""
SELECT trim(label) AS truth, {room_case('photo_file', 0)} AS predicted FROM v_labels
""")
part("room_cells", "SELECT truth, predicted, count(*) AS n FROM room_pairs GROUP BY ALL")
part("label_names", """
SELECT truth AS label FROM room_cells UNION SELECT predicted FROM room_cells
""")


def room_pairs(spark, sf) -> DataFrame:
    return evaluation.room_pairs(views.labels(spark, sf).select("photo_file", "label"))


@query("C9_labels_with_predictions", f"""
SELECT truth, predicted, count(*) AS n FROM (
  SELECT trim(v.label) AS truth,
    coalesce(p.room, {room_case('v.photo_file', 0)}) AS predicted
  FROM v_labels v LEFT JOIN (
    SELECT DISTINCT photo_file AS path, 'view' AS room FROM v_labels
    WHERE contains(photo_file, 'img_')) p ON p.path = v.photo_file)
GROUP BY ALL""")
def labels_with_predictions(spark, sf):
    labels = views.labels(spark, sf).select("photo_file", "label")
    seen = labels.filter(F.col("photo_file").contains("img_")).select(
        F.col("photo_file").alias("path"), F.lit("view").alias("room")
    )
    return evaluation.confusion_counts(evaluation.room_pairs(labels, predictions=seen))


@query("D10_room_accuracy", f"""
SELECT {half_even('a', 4)} AS accuracy, n AS row_count FROM (
  SELECT sum(CASE WHEN truth = predicted THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS a,
    sum(n)::BIGINT AS n FROM room_cells)""")
def room_accuracy(spark, sf):
    return evaluation.room_accuracy(room_pairs(spark, sf))


@query("D11_confusion_matrix", f"""
SELECT t.label AS truth, {joined('''list(coalesce(c.n, 0)::VARCHAR ORDER BY p.label)''')}
  AS counts
FROM label_names t CROSS JOIN label_names p
LEFT JOIN room_cells c ON c.truth = t.label AND c.predicted = p.label
GROUP BY t.label""")
def confusion_matrix(spark, sf):
    report = evaluation.room_report(room_pairs(spark, sf))
    rows = report.select(F.inline(F.arrays_zip("labels", "confusion_matrix")))
    return rows.select(
        F.col("labels").alias("truth"),
        F.array_join(F.col("confusion_matrix").cast("array<string>"), " | ").alias("counts"),
    )


part("blur_truth", """
SELECT coalesce(lower(trim(blur_label)) IN ('blurry', 'true', '1', 'yes'), false) AS truth,
  coalesce(m.is_blurry, false) AS predicted
FROM v_labels v LEFT JOIN (SELECT path, bool_or(is_blurry) AS is_blurry FROM photo_scored
  GROUP BY path) m ON m.path = v.photo_file
""")
part("blur_numbers", f"""
SELECT {half_even('p', 4)} AS precision, {half_even('r', 4)} AS recall, row_count,
  tn, fp, fn, tp FROM (
  SELECT coalesce(tp::DOUBLE / nullif(tp + fp, 0)::DOUBLE, 0e0) AS p,
    coalesce(tp::DOUBLE / nullif(tp + fn, 0)::DOUBLE, 0e0) AS r, * FROM (
    SELECT count(*) FILTER (truth AND predicted) AS tp,
      count(*) FILTER (NOT truth AND predicted) AS fp,
      count(*) FILTER (truth AND NOT predicted) AS fn,
      count(*) FILTER (NOT truth AND NOT predicted) AS tn, count(*) AS row_count
    FROM blur_truth))
""")


def blur_pairs(spark, sf) -> DataFrame:
    labels = views.labels(spark, sf).select(
        "photo_file", F.col("blur_label").alias("label")
    )
    metrics = scored_photos(spark, sf).select("path", "is_blurry")
    return evaluation.blur_pairs(labels, metrics)


def _blur_row(report: DataFrame) -> DataFrame:
    matrix = F.col("confusion_matrix")
    return report.select(
        "precision", "recall", "row_count", matrix[0][0].alias("tn"), matrix[0][1].alias("fp"),
        matrix[1][0].alias("fn"), matrix[1][1].alias("tp"),
    )


@query("D12_blur_precision", "SELECT * FROM blur_numbers")
def blur_precision(spark, sf):
    return _blur_row(evaluation.blur_report(blur_pairs(spark, sf)))


@query("D12_label_table_precision", f"""
SELECT {half_even('p', 4)} AS precision, {half_even('r', 4)} AS recall, row_count FROM (
  SELECT coalesce(count(*) FILTER (truth AND predicted)::DOUBLE
      / nullif(count(*) FILTER (predicted), 0)::DOUBLE, 0e0) AS p,
    coalesce(count(*) FILTER (truth AND predicted)::DOUBLE
      / nullif(count(*) FILTER (truth), 0)::DOUBLE, 0e0) AS r, count(*) AS row_count
  FROM (SELECT quality = 0 AS truth, word_count < 100 AS predicted
    FROM labels JOIN text_measured USING (doc_id)))""")
def label_table_precision(spark, sf):
    from hostlens.functions.text import word_count

    documents = views.listings(spark, sf).select(
        F.col("row_key").alias("doc_id"),
        (word_count(F.col("name")) + word_count(F.col("description")) < 100).alias("predicted"),
    )
    pairs = views.table(spark, sf, "labels").join(documents, "doc_id").select(
        (F.col("quality") == 0).alias("truth"), "predicted"
    )
    return evaluation.blur_report(pairs).select("precision", "recall", "row_count")


part("class_numbers", """
SELECT l.label, coalesce(h.n, 0)::DOUBLE AS hit, coalesce(s.n, 0)::DOUBLE AS support,
  coalesce(c.n, 0)::DOUBLE AS claimed
FROM label_names l
LEFT JOIN (SELECT truth, sum(n) AS n FROM room_cells GROUP BY truth) s ON s.truth = l.label
LEFT JOIN (SELECT predicted, sum(n) AS n FROM room_cells GROUP BY predicted) c
  ON c.predicted = l.label
LEFT JOIN room_cells h ON h.truth = l.label AND h.predicted = l.label
""")
part("class_rows", """
SELECT label, coalesce(hit / nullif(claimed, 0), 0e0) AS precision,
  coalesce(hit / nullif(support, 0), 0e0) AS recall,
  coalesce(2 * hit / nullif(claimed + support, 0), 0e0) AS f1_score, support
FROM class_numbers
""")
part("class_report_rows", """
SELECT label, precision, recall, f1_score, support::BIGINT AS support FROM class_rows
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support)::BIGINT
FROM class_rows
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
  sum(recall * support) / sum(support), sum(f1_score * support) / sum(support),
  sum(support)::BIGINT FROM class_rows
""")
_CLASS = ("label, round(precision, 6) AS precision, round(recall, 6) AS recall, "
          "round(f1_score, 6) AS f1_score, support")


@query("D13_class_report", f"SELECT {_CLASS} FROM class_report_rows")
def class_report(spark, sf):
    return rounded(evaluation.class_report(room_pairs(spark, sf)))


@query("G4_label_union", "SELECT label FROM label_names")
def label_union(spark, sf):
    return evaluation.label_union(evaluation.confusion_counts(room_pairs(spark, sf)))


@query("J8_room_evaluation", f"""
SELECT {_CLASS} FROM class_report_rows
UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), n FROM (
  SELECT sum(CASE WHEN truth = predicted THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS a,
    sum(n)::BIGINT AS n FROM room_cells)""")
def room_evaluation_report(spark, sf):
    return rounded(room_evaluation(room_pairs(spark, sf)))


@query("U1_room_predictor", """
SELECT trim(label) AS truth, CASE WHEN contains(photo_file, 'pool') THEN 'pool' ELSE 'other' END
  AS predicted, count(*) AS n FROM v_labels GROUP BY ALL""")
def given_predictor(spark, sf):
    @F.pandas_udf("string")
    def pool_or_other(paths: pd.Series) -> pd.Series:
        return paths.str.contains("pool", regex=False).map({True: "pool", False: "other"})

    labels = views.labels(spark, sf).select("photo_file", "label")
    return evaluation.confusion_counts(
        evaluation.room_pairs(labels, predictor=pool_or_other)
    )


@query("U2_blur_detector", """
SELECT coalesce(lower(trim(blur_label)) IN ('blurry', 'true', '1', 'yes'), false) AS truth,
  contains(photo_file, 'bath') AS predicted, count(*) AS n FROM v_labels GROUP BY ALL""")
def given_detector(spark, sf):
    @F.pandas_udf("boolean")
    def in_bathroom(paths: pd.Series) -> pd.Series:
        return paths.str.contains("bath", regex=False)

    labels = views.labels(spark, sf).select(
        "photo_file", F.col("blur_label").alias("label")
    )
    return evaluation.confusion_counts(evaluation.blur_pairs(labels, detector=in_bathroom))


part("gate_rows", f"""
SELECT 'feature_table' AS "check", unnest(['row_count', 'listing_id_missing',
    'duplicate_listing_ids', 'quality_score_out_of_range', 'component_scores_out_of_range',
    'non_finite_component_scores', 'non_finite_quality_scores', 'invalid_explanation_json'])
    AS metric,
  unnest([row_count, listing_id_missing, duplicate_listing_ids, quality_score_out_of_range,
    component_scores_out_of_range, non_finite_component_scores, non_finite_quality_scores,
    invalid_explanation_json])::DOUBLE AS value, false AS passes FROM contract_counts
UNION ALL
SELECT 'room_accuracy', unnest(['accuracy', 'row_count']), unnest([accuracy, n::DOUBLE]),
  accuracy >= 0.85 FROM (SELECT {half_even('a', 4)} AS accuracy, n FROM (
    SELECT sum(CASE WHEN truth = predicted THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS a,
      sum(n)::BIGINT AS n FROM room_cells))
UNION ALL
SELECT 'blur_precision', unnest(['precision', 'recall', 'row_count']),
  unnest([precision, recall, row_count::DOUBLE]), precision >= 0.90 FROM blur_numbers
""")


@query("D25_quality_gates", "SELECT * FROM gate_rows")
def all_gates(spark, sf):
    return quality_gates(cells(spark, sf), room_pairs(spark, sf), blur_pairs(spark, sf))


@query("J7_gate_report", "SELECT * FROM gate_rows")
def gate_report(spark, sf):
    path = scratch_path(spark, "gates")
    report = quality_gates(cells(spark, sf), room_pairs(spark, sf), blur_pairs(spark, sf))
    sinks.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


# --- calibration --------------------------------------------------------------

part("rated", """
SELECT v.photo_file AS path, p.raw, v.avg_rating AS human FROM v_labels v
JOIN (SELECT path, max(aesthetic_raw) AS raw FROM photo_scored GROUP BY path) p
  ON p.path = v.photo_file WHERE v.avg_rating IS NOT NULL
""")


def _ratings(spark, sf) -> DataFrame:
    return views.labels(spark, sf).select("photo_file", "avg_rating")


def _rated(spark, sf) -> DataFrame:
    return calibration.rated_photos(_ratings(spark, sf), scored_photos(spark, sf))


@query("C11_rated_photos", "SELECT path, round(raw, 6) AS raw, round(human, 6) AS human "
                           "FROM rated")
def rated_photos(spark, sf):
    return rounded(_rated(spark, sf))


@query("D14_linear_fit", """
SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope,
  round(regr_intercept(p_retailprice, p_size), 6) AS intercept, count(*) AS points FROM part""")
def linear_fit(spark, sf):
    parts = views.table(spark, sf, "part")
    return rounded(calibration.fit_line(parts, "p_size", "p_retailprice"))


@query("D15_rater_mean", """
SELECT photo_file, round((coalesce(rater1, 0) + coalesce(rater2, 0)) / 2, 6) AS rating
FROM v_labels""")
def rater_mean(spark, sf):
    rows = views.labels(spark, sf).select("photo_file", "rater1", "rater2")
    return rows.select("photo_file", r6(calibration.human_rating(rows)).alias("rating"))


@query("H12_apply_calibration", """
SELECT file, round(least(greatest(0.8e0 * aesthetic_raw + 12.5e0, 0e0), 100e0), 6) AS calibrated
FROM photo_scored""")
def apply_calibration(spark, sf):
    score = calibration.apply_line(F.col("aesthetic_raw"), 0.8, 12.5)
    return scored_photos(spark, sf).select("file", r6(score).alias("calibrated"))


@query("J6_calibration_job", """
SELECT round(regr_slope(human, raw), 6) AS slope, round(regr_intercept(human, raw), 6)
  AS intercept, count(*) AS points FROM rated""")
def calibrate(spark, sf):
    ratings = read_ratings(spark, csv_copy(_ratings(spark, sf), "ratings"))
    photos = scored_photos(spark, sf).select("path", "aesthetic_raw")
    path = scratch_path(spark, "calibrator")
    calibration_job(spark, ratings, photos, path)
    slope, intercept = sinks.load_calibrator(spark, path)
    return _rated(spark, sf).agg(
        r6(F.lit(slope)).alias("slope"), r6(F.lit(intercept)).alias("intercept"),
        F.count(F.lit(1)).alias("points"),
    )


# --- profile ------------------------------------------------------------------

_RAW_COLUMNS = ("listing_id", "vertical", "name", "description", "city", "capacity",
                "base_price", "instant_booking", "amenities")
part("raw_nulls", "SELECT " + ", ".join(
    f"CASE WHEN {c} NOT IN ({MISSING}) THEN {c} END AS {c}" for c in _RAW_COLUMNS
) + " FROM v_raw")
part("photo_nulls", f"""
SELECT CASE WHEN entity_id NOT IN ({MISSING}) THEN entity_id END AS entity_id FROM v_raw_photos
""")
_NULLS = " UNION ALL ".join(
    f"SELECT 'listings', 'missing values', '{c}', count(*) - count({c}) FROM raw_nulls "
    f"HAVING count(*) > count({c})" for c in _RAW_COLUMNS
)
_COLUMN_ROWS = " UNION ALL ".join(
    f"SELECT 'listings', 'column', '{c}', {i}" for i, c in enumerate(_RAW_COLUMNS)
)
part("listing_counts", f"""
SELECT 'listings' AS section, 'total rows' AS metric, '' AS key, count(*)::DOUBLE AS value
  FROM raw_nulls
UNION ALL SELECT 'listings', 'stay listings', '', count(*) FILTER (vertical = 'stay')
  FROM raw_nulls
UNION ALL SELECT 'listings', 'unique cities', '', count(DISTINCT city) FROM raw_nulls
UNION ALL SELECT 'listings', 'with amenities', '', count(amenities) FROM raw_nulls
UNION ALL {_NULLS}
""")
part("top_cities", """
SELECT 'listings' AS section, 'top city' AS metric, city AS key, n::DOUBLE AS value FROM (
  SELECT city, count(*) AS n FROM raw_nulls WHERE city IS NOT NULL GROUP BY city
  ORDER BY n DESC, city LIMIT 5)
""")
part("photo_profile", """
SELECT 'photos' AS section, 'rows' AS metric, '' AS key, count(*)::DOUBLE AS value
  FROM photo_nulls
UNION ALL SELECT 'photos', 'entities', '', count(DISTINCT entity_id) FROM photo_nulls
UNION ALL SELECT 'photos', 'photos per entity', '',
  round(count(entity_id)::DOUBLE / count(DISTINCT entity_id), 6) FROM photo_nulls
""")
part("profile_rows", f"""
SELECT * FROM listing_counts UNION ALL SELECT * FROM top_cities
UNION ALL SELECT * FROM photo_profile
UNION ALL SELECT 'cities', 'reference cities', '', count(*)::DOUBLE FROM nation
UNION ALL {_COLUMN_ROWS}
""")


@query("D19_listing_counts", "SELECT * FROM listing_counts")
def listing_counts(spark, sf):
    listings, _, _ = profile_inputs(spark, sf)
    return profiling.listing_counts(listings)


@query("D20_distinct_cities", "SELECT value AS cities FROM listing_counts "
                              "WHERE metric = 'unique cities'")
def distinct_cities(spark, sf):
    listings, _, _ = profile_inputs(spark, sf)
    rows = profiling.listing_counts(listings)
    return rows.filter("metric = 'unique cities'").select(F.col("value").alias("cities"))


@query("D21_amenity_cells", "SELECT value AS with_amenities FROM listing_counts "
                            "WHERE metric = 'with amenities'")
def amenity_cells(spark, sf):
    listings, _, _ = profile_inputs(spark, sf)
    rows = profiling.listing_counts(listings)
    return rows.filter("metric = 'with amenities'").select(
        F.col("value").alias("with_amenities")
    )


@query("D22_photo_counts", "SELECT * FROM photo_profile")
def photo_counts(spark, sf):
    _, photos, _ = profile_inputs(spark, sf)
    return rounded(profiling.photo_counts(photos))


@query("D23_city_reference", "SELECT count(*)::DOUBLE AS reference_cities FROM nation")
def city_reference(spark, sf):
    rows = profiling.city_reference(views.table(spark, sf, "nation"))
    return rows.select(F.col("value").alias("reference_cities"))


@query("F5_top_cities", "SELECT key AS city, value AS n FROM top_cities")
def top_cities(spark, sf):
    listings, _, _ = profile_inputs(spark, sf)
    return profiling.top_cities(listings).select(
        F.col("key").alias("city"), F.col("value").alias("n")
    )


@query("J9_data_profile", "SELECT * FROM profile_rows")
def data_profile(spark, sf):
    return profile_of(spark, sf)


# --- forms for many labels, many files and real predictors --------------------

BLOCK = 64
part("part_pairs", """
SELECT l_partkey::VARCHAR AS truth, (l_partkey + l_suppkey % 5 * 7)::VARCHAR AS predicted
FROM lineitem
""")
part("part_cells", "SELECT truth, predicted, count(*) AS n FROM part_pairs GROUP BY ALL")
part("part_labels", """
SELECT label, row_number() OVER (ORDER BY label) - 1 AS i FROM (
  SELECT truth AS label FROM part_cells UNION SELECT predicted FROM part_cells)
""")


@query("D11_confusion_blocks", f"""
SELECT truth, any_value(r) AS row, block, array_to_string(
  list(coalesce(n, 0)::VARCHAR ORDER BY x), ' ') AS counts
FROM (
  SELECT b.truth, b.r, b.block, x, sum(c.n) AS n FROM (
    SELECT DISTINCT c.truth, t.i AS r, p.i // {BLOCK} AS block FROM part_cells c
    JOIN part_labels t ON t.label = c.truth JOIN part_labels p ON p.label = c.predicted) b
  JOIN range({BLOCK}) w(x) ON b.block * {BLOCK} + x < (SELECT count(*) FROM part_labels)
  LEFT JOIN part_labels q ON q.i = b.block * {BLOCK} + x
  LEFT JOIN part_cells c ON c.truth = b.truth AND c.predicted = q.label
  GROUP BY ALL)
GROUP BY truth, block""")
def confusion_in_blocks(spark, sf):
    """As many labels as parts, and every line item a pair."""
    part_key = F.col("l_partkey")
    pairs = views.table(spark, sf, "lineitem").select(
        part_key.cast("string").alias("truth"),
        (part_key + F.col("l_suppkey") % 5 * 7).cast("string").alias("predicted"))
    return evaluation.confusion_blocks(pairs, BLOCK).withColumn(
        "counts", F.array_join(F.col("counts").cast("array<string>"), " "))


@query("U1_loaded_predictor", """
SELECT trim(label) AS truth, CASE WHEN contains(photo_file, 'pool') THEN 'pool'
    WHEN contains(photo_file, 'view') THEN 'view' ELSE 'other' END AS predicted, count(*) AS n
FROM v_labels GROUP BY ALL""")
def loaded_predictor(spark, sf):
    """A model that is loaded once in each worker and gives objects with a label."""
    def load():
        from types import SimpleNamespace

        return [(word, SimpleNamespace(label=word)) for word in ("pool", "view")]

    def predict(model, paths):
        return [next((found for word, found in model if word in path), "other") for path in paths]

    labels = views.labels(spark, sf).select("photo_file", "label")
    return evaluation.confusion_counts(
        evaluation.room_pairs(labels, predictor=room_predictor(load, predict)))


@query("U2_loaded_detector", """
SELECT coalesce(lower(trim(blur_label)) IN ('blurry', 'true', '1', 'yes'), false) AS truth,
  contains(photo_file, 'bath') AS predicted, count(*) AS n FROM v_labels GROUP BY ALL""")
def loaded_detector(spark, sf):
    def load():
        from types import SimpleNamespace

        return SimpleNamespace(is_blurry=True)

    def predict(model, paths):
        return [model if "bath" in path else None for path in paths]

    labels = views.labels(spark, sf).select("photo_file", F.col("blur_label").alias("label"))
    return evaluation.confusion_counts(
        evaluation.blur_pairs(labels, detector=blur_detector(load, predict)))


@query("D20_sketched_profile", "SELECT * FROM listing_counts")
def sketched_profile(spark, sf):
    """The listing section from per-file states, kept up while a second half of files arrives."""
    listings, _, _ = profile_inputs(spark, sf)
    folder, state = scratch_path(spark, "files"), scratch_path(spark, "state")
    half = F.pmod(F.xxhash64("description"), F.lit(2))
    for at in (0, 1):
        listings.filter(half == at).write.mode("append").parquet(folder)
        update_profile(spark, folder, state)
    return merged_profile(sinks.read_table(spark, state))
