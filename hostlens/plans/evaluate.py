"""Evaluation jobs: contract gates, room report, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.operators import calibration, evaluation
from hostlens.operators.pixels import photo_metrics
from hostlens.operators.technical import with_photo_scores
from hostlens.operators.validation import validate_features
from hostlens.settings import DEFAULTS, FEATURE_COLUMNS, Settings
from hostlens.sources import sinks
from hostlens.sources.images import read_images
from hostlens.sources.tables import read_labels


def _rows(report: DataFrame, check: str, metrics: list[str], passes) -> DataFrame:
    values = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in metrics
    ])
    return report.select(F.lit(check).alias("check"), F.inline(values), passes.alias("passes"))


def quality_gates(
    features: DataFrame | None = None, room_pairs: DataFrame | None = None,
    blur_pairs: DataFrame | None = None, s: Settings = DEFAULTS,
) -> DataFrame | None:
    """Long rows (check, metric, value, passes) of the checks that have an input."""
    parts = []
    if features is not None:
        report = validate_features(features, s)
        counts = [c for c in report.columns if c != "passes"]
        parts.append(_rows(report, "feature_table", counts, F.col("passes")))
    if room_pairs is not None:
        report = evaluation.room_accuracy(room_pairs)
        parts.append(_rows(report, "room_accuracy", ["accuracy", "row_count"],
                           F.col("accuracy") >= s.room_accuracy_gate))
    if blur_pairs is not None:
        report = evaluation.blur_report(blur_pairs)
        parts.append(_rows(report, "blur_precision", ["precision", "recall", "row_count"],
                           F.col("precision") >= s.blur_precision_gate))
    if not parts:
        return None
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def gate_job(spark: SparkSession, feature_table: str, output: str | None = None) -> bool:
    """Check a feature table on disk; False means the job should fail."""
    report = validate_features(sinks.read_table(spark, feature_table))
    if output is not None:
        sinks.write_report(report, output)
    return bool(report.first()["passes"])


def gates_from_files(
    spark: SparkSession, output: str, feature_table: str | None = None,
    room_labels: str | None = None, blur_labels: str | None = None,
    photos_root: str | None = None, fmt: str = "csv", s: Settings = DEFAULTS,
    predictor: evaluation.Predictor | None = None, detector: evaluation.Predictor | None = None,
) -> bool | None:
    """Run the gates that have an input file and write their reports below `output`.

    `output`/gates has a row for each metric of a check. `output`/confusion has the
    confusion matrix of the rooms as rows (truth, predicted, n), without empty cells; its
    labels are those of both columns. A feature table that lacks columns is not checked
    further: its gates are one row for each missing column, and fail. Rooms come from the
    `predictor`, else from file names; blur from the `detector`, else from the images below
    `photos_root` (`functions.models` makes both from a model). Returns whether all gates
    pass, or None without any input.
    """
    features = None if feature_table is None else sinks.read_table(spark, feature_table)
    missing = [] if features is None else [
        name for name in FEATURE_COLUMNS if name not in features.columns]
    rooms = None if room_labels is None else evaluation.room_pairs(
        read_labels(spark, room_labels, fmt), predictor=predictor, root=photos_root)
    blur = None
    if blur_labels is not None and detector is not None:
        blur = evaluation.blur_pairs(read_labels(spark, blur_labels, fmt), detector=detector,
                                     root=photos_root)
    elif blur_labels is not None:
        if photos_root is None:
            raise ValueError("blur labels need the root of the photos")
        metrics = with_photo_scores(photo_metrics(read_images(spark, photos_root)), s)
        blur = evaluation.blur_pairs(read_labels(spark, blur_labels, fmt), metrics,
                                     root=photos_root)
    report = quality_gates(None if missing else features, rooms, blur, s)
    if missing:
        absent = spark.createDataFrame(
            [("feature_table", f"missing column {name}", 1.0, False) for name in missing],
            "check string, metric string, value double, passes boolean")
        report = absent if report is None else report.unionByName(absent)
    if report is None:
        return None
    sinks.write_table(report, f"{output}/gates")
    if rooms is not None:
        sinks.write_table(evaluation.confusion_counts(rooms), f"{output}/confusion")
    written = sinks.read_table(spark, f"{output}/gates")
    return written.filter("not coalesce(passes, false)").isEmpty()


def room_evaluation(pairs: DataFrame) -> DataFrame:
    """Per-class report rows with the overall accuracy as one more row."""
    accuracy = pairs.agg(
        F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("precision"),
        F.count(F.lit(1)).alias("support"),
    ).select(
        F.lit("accuracy").alias("label"), "precision", F.col("precision").alias("recall"),
        F.col("precision").alias("f1_score"), "support",
    )
    return evaluation.class_report(pairs).unionByName(accuracy)


def calibration_job(spark: SparkSession, ratings: DataFrame, photos: DataFrame,
                    output: str) -> tuple[float, float]:
    """Fit the line to rated photos and save it; two rated photos are needed."""
    line = calibration.fit_line(calibration.rated_photos(ratings, photos)).first()
    if line["points"] < 2:
        raise ValueError("at least two rated photos are needed to fit a calibration")
    fitted = spark.createDataFrame(
        [(line["slope"], line["intercept"])], "slope double, intercept double"
    )
    sinks.save_calibrator(fitted, output)
    return line["slope"], line["intercept"]
