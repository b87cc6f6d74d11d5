"""Queries for scans, sinks, cleaning, filters and predicates (groups A and B)."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.catalog import views
from hostlens.catalog.registry import NUDGE, part, query
from hostlens.catalog.sqltext import MISSING, strip
from hostlens.functions import clean
from hostlens.operators import calibration, evaluation, profiling
from hostlens.operators.pixels import photo_metrics
from hostlens.operators.scoring import flagged_photos
from hostlens.operators.validation import require_columns, validate_features
from hostlens.plans.features import (
    Vision, contract_rows, listing_rows, photo_rows, score_rows,
)
from hostlens.session import cut_in_turn, scratch_path
from hostlens.settings import FEATURE_COLUMNS
from hostlens.sources import sinks, tables
from hostlens.sources.images import existing_files, fewer_tasks, read_images


def r6(c):
    """Six decimals; the nudge keeps sums that differ in the last bit on one side."""
    return F.round(c + NUDGE, 6)


def csv_copy(df: DataFrame, name: str) -> str:
    """Write a derived table as CSV into the shared folder; returns its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    return path


def slice_features(spark, sf):
    """Feature rows of listings without photos."""
    listings = tables.eligible(views.listings(spark, sf))
    return contract_rows(score_rows(listing_rows(listings), None))


def scored_photos(spark, sf):
    return photo_rows(views.photos(spark, sf), Vision())


# --- A: scans and sinks -------------------------------------------------------

_INT = "CAST(trunc(TRY_CAST(trim({0}) AS DOUBLE)) AS BIGINT)"


def _sql_int(c: str) -> str:
    blank = f"{c} IS NULL OR {c} IN ({MISSING}) OR trim({c}) = ''"
    return f"CASE WHEN {blank} THEN 0 ELSE {_INT.format(c)} END"


def _sql_float(c: str) -> str:
    blank = f"{c} IS NULL OR {c} IN ({MISSING}) OR trim({c}) = ''"
    return f"CASE WHEN {blank} THEN 0e0 ELSE TRY_CAST(trim({c}) AS DOUBLE) END"


def _sql_text(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} IN ({MISSING}) THEN '' ELSE {c} END"


def _sql_bool(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL THEN false "
        f"ELSE lower(trim({c})) IN ('true', '1', 'yes', 'y', 'on') END"
    )


_SQL_LIST = """CASE WHEN amenities IS NULL OR trim(amenities) = '' THEN []::VARCHAR[]
  WHEN starts_with(amenities, '[') AND json_valid(amenities) THEN
    list_transform(CAST(CAST(amenities AS JSON) AS JSON[]), lambda j:
      CASE CAST(j AS VARCHAR) WHEN 'true' THEN 'True' WHEN 'false' THEN 'False'
           ELSE coalesce(j ->> '$', 'None') END)
  WHEN starts_with(amenities, '[''') THEN regexp_extract_all(amenities, '''([^'']*)''', 1)
  WHEN starts_with(amenities, '[') THEN [amenities]
  ELSE list_filter(list_transform(string_split(amenities, '|'), lambda x: trim(x)),
                   lambda x: x <> '') END"""

part("clean_cells", f"""
SELECT {strip(_sql_text('listing_id'))} AS listing_id, {_sql_text('vertical')} AS vertical,
  {_sql_text('name')} AS name, {_sql_text('description')} AS description,
  {_sql_text('city')} AS city, {_sql_int('capacity')} AS capacity,
  {_sql_float('base_price')} AS base_price, {_sql_bool('instant_booking')} AS instant_booking,
  array_to_string({_SQL_LIST}, '~') AS amenities, doc_id
FROM v_raw
""")

_CLEAN = ("listing_id", "vertical", "name", "description", "city", "capacity", "base_price",
          "instant_booking")


@query("A1_listings_csv_scan", """
SELECT listing_id, vertical, name, length(description) AS description_length, city, capacity,
  base_price, instant_booking, amenities, 0 AS bedrooms, 0e0 AS bathrooms, '' AS currency,
  false AS has_active_ical
FROM clean_cells WHERE listing_id <> ''""")
def listings_csv_scan(spark, sf):
    path = csv_copy(views.raw_cells(spark, sf).drop("doc_id"), "listings")
    rows = tables.read_listings(spark, path)
    return rows.select(
        "listing_id", "vertical", "name", F.length("description").alias("description_length"),
        "city", "capacity", "base_price", "instant_booking",
        F.array_join("amenities", "~").alias("amenities"), "bedrooms", "bathrooms", "currency",
        "has_active_ical",
    )


part("clean_photos", f"""
SELECT {strip('coalesce(entity_id, chr(32))')} AS entity_id, {strip('file')} AS file,
  {_sql_int('seq')} AS seq, {_sql_bool('is_cover')} AS is_cover, {_sql_int('width')} AS width,
  {_sql_int('height')} AS height, 0 AS bytes
FROM v_raw_photos
""")


@query("A2_photos_csv_scan", """
SELECT entity_id, file, seq, is_cover, width, height, bytes FROM clean_photos
WHERE entity_id <> '' AND file <> ''""")
def photos_csv_scan(spark, sf):
    path = csv_copy(views.raw_photos(spark, sf), "photos")
    return tables.read_photos(spark, path).drop("row_key")


@query("A3_label_csv_scan", """
SELECT photo_file, CASE WHEN label IN ('', 'NA') THEN NULL ELSE label END AS label FROM (
  SELECT photo_file, label FROM v_labels
  UNION ALL SELECT photo_file, blur_label FROM v_labels)""")
def label_csv_scan(spark, sf):
    rows = views.labels(spark, sf)
    room = tables.read_labels(spark, csv_copy(rows.select("photo_file", "label"), "room"))
    blur = tables.read_labels(spark, csv_copy(
        rows.select("photo_file", F.col("blur_label").alias("label")), "blur"
    ))
    return room.unionByName(blur)


@query("A4_ratings_csv_scan", """
SELECT photo_file, avg_rating, NULL::DOUBLE AS rater1, NULL::DOUBLE AS rater2 FROM v_labels
UNION ALL SELECT photo_file, NULL, rater1, rater2 FROM v_labels""")
def ratings_csv_scan(spark, sf):
    rows = views.labels(spark, sf)
    one = tables.read_ratings(spark, csv_copy(rows.select("photo_file", "avg_rating"), "mean"))
    two = tables.read_ratings(
        spark, csv_copy(rows.select("photo_file", "rater1", "rater2"), "raters")
    )
    return one.unionByName(two, allowMissingColumns=True)


@query("A5_city_reference_scan",
       "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey "
       "FROM nation")
def city_reference_scan(spark, sf):
    return tables.read_cities(spark, csv_copy(views.table(spark, sf, "nation"), "cities"))


def _png(width: int, height: int, bgr: bytes) -> bytes:
    """A minimal true-colour PNG of the given pixels."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        crc = zlib.crc32(kind + body)
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", crc)

    step = 3 * width
    lines = []
    for y in range(height):
        line = bytearray(bgr[y * step:(y + 1) * step])
        line[0::3], line[2::3] = line[2::3], line[0::3]
        lines.append(b"\0" + bytes(line))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head)
        + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    )


# folders that hold the derived pictures of a slice: Spark lists this many in parallel
_FOLDERS = 64
# pictures of a slice: the driver lists the files of one slice at a time
_SLICE = 30_000


def image_folders(images: DataFrame) -> list[str]:
    """Write derived pixels as PNG files below the shared folder, from the tasks.

    The shared folder must be mounted as a file system on every executor. Returns the
    folders of the slices, of about `_SLICE` pictures each.
    """
    top = scratch_path(images.sparkSession, "images").removeprefix("file:")
    folders, slices = _FOLDERS, -(-images.select("vec_id").count() // _SLICE) or 1
    for k in range(slices * folders):
        Path(f"{top}/{k % slices}/{k // slices}").mkdir(parents=True)

    def save(rows) -> None:
        token = uuid.uuid4().hex
        for row in rows:
            # by its name: equal ids meet in one file, whatever the ids are
            place = zlib.crc32(str(row.vec_id).encode())
            inside = f"{top}/{place % slices}/{place // slices % folders}"
            # a retried task replaces the file in one step; readers pass over _ names
            part_file = f"{inside}/_img_{row.vec_id}.{token}.part"
            with open(part_file, "wb") as out:
                out.write(_png(row.width, row.height, bytes(row.data)))
            os.replace(part_file, f"{inside}/img_{row.vec_id}.png")

    images.select("vec_id", "height", "width", "data").foreachPartition(save)
    return [f"{top}/{k}" for k in range(slices)]


def _scanned(spark, folder: str) -> DataFrame:
    """Shape and brightness of the pictures below a folder, and whether they are listed."""
    images = fewer_tasks(read_images(spark, folder))
    images = images.withColumn("shape", F.struct("height", "width", "channels"))
    number = F.regexp_extract("path", r"img_(\d+)\.png$", 1).cast("bigint")
    listed = existing_files(spark, folder).withColumn("listed", F.lit(True))
    # each picture is decoded once: its shape comes along with its metrics
    measured = photo_metrics(images, ("shape",)).select(
        "path", "shape.*", r6(F.col("brightness")).alias("brightness")
    )
    return measured.join(listed, "path", "left").select(
        number.alias("vec_id"), "height", "width", "channels", "listed", "brightness"
    )


@query("A6_image_file_scan", """
SELECT vec_id, 32 AS height, 32 AS width, 3 AS channels, true AS listed,
  round(avg(grey), 6) AS brightness
FROM pixel_rows GROUP BY vec_id""")
def image_file_scan(spark, sf):
    from hostlens.catalog.photos import derived_images

    folders = image_folders(derived_images(spark, sf))
    if len(folders) == 1:
        return _scanned(spark, folders[0])
    return cut_in_turn((_scanned(spark, folder) for folder in folders), "pictures")


_FEATURE_VALUES = """listing_id, round(quality_score, 6) AS quality_score,
  round(text_quality, 6) AS text_quality, round(completeness, 6) AS completeness,
  photo_status, version, quality_engine_version, config_version, explanation_json"""


@query("A7_feature_table_sink", f"SELECT {_FEATURE_VALUES} FROM slice_features")
def feature_table_sink(spark, sf):
    path = scratch_path(spark, "features")
    sinks.write_table(slice_features(spark, sf), path)
    return sinks.read_table(spark, path).select(
        "listing_id", r6(F.col("quality_score")).alias("quality_score"),
        r6(F.col("text_quality")).alias("text_quality"),
        r6(F.col("completeness")).alias("completeness"), "photo_status", "version",
        "quality_engine_version", "config_version", "explanation_json",
    )


@query("A8_feature_table_scan", """
SELECT photo_status, count(*) AS n, round(avg(quality_score), 6) AS mean_score
FROM slice_features GROUP BY photo_status""")
def feature_table_scan(spark, sf):
    path = scratch_path(spark, "features")
    sinks.write_table(slice_features(spark, sf), path)
    return sinks.read_table(spark, path).groupBy("photo_status").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("quality_score")).alias("mean_score")
    )


@query("A9_calibrator_file", """
SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope,
  round(regr_intercept(p_retailprice, p_size), 6) AS intercept, true AS absent_is_none
FROM part""")
def calibrator_file(spark, sf):
    parts = views.table(spark, sf, "part")
    path = scratch_path(spark, "calibrator")
    sinks.save_calibrator(calibration.fit_line(parts, "p_size", "p_retailprice"), path)
    slope, intercept = sinks.load_calibrator(spark, path)
    absent = sinks.load_calibrator(spark, path + "-absent") is None
    return parts.limit(1).select(
        r6(F.lit(slope)).alias("slope"), r6(F.lit(intercept)).alias("intercept"),
        F.lit(absent).alias("absent_is_none"),
    )


part("cells_numbers", "SELECT *, trim(listing_id) AS id FROM v_cells")
_COMPONENT_NAMES = ("photo_technical", "photo_aesthetic", "room_coverage", "amenity_check",
                    "text_quality", "completeness")


def _over(test: str) -> str:
    return " + ".join(
        f"count(*) FILTER ({test.format(name)})" for name in _COMPONENT_NAMES
    )


RANGE = "NOT isnan({0}) AND ({0} < 0 OR {0} > 100)"
FINITE = "NOT isfinite({0})"
VALID_JSON = r"""coalesce(CASE WHEN json_valid(explanation_json)
    AND NOT regexp_matches(explanation_json, '\bNaN\b') THEN
  json_type(explanation_json) = 'OBJECT'
  AND json_type(explanation_json, '$.positive') = 'ARRAY'
  AND json_type(explanation_json, '$.issues') = 'ARRAY'
  AND json_type(explanation_json, '$.suggestions') = 'ARRAY' END, false)"""
part("contract_counts", f"""
SELECT count(*) AS row_count,
  count(*) FILTER (id IS NULL OR id = '') AS listing_id_missing,
  count(*) FILTER (id <> '') - count(DISTINCT id) FILTER (id <> '') AS duplicate_listing_ids,
  count(*) FILTER ({RANGE.format('quality_score')}) AS quality_score_out_of_range,
  {_over(RANGE)} AS component_scores_out_of_range,
  {_over(FINITE)} AS non_finite_component_scores,
  count(*) FILTER ({FINITE.format('quality_score')}) AS non_finite_quality_scores,
  count(*) FILTER (NOT ({VALID_JSON})) AS invalid_explanation_json
FROM cells_numbers
""")


@query("A10_report_json_sink", "SELECT *, false AS passes FROM contract_counts")
def report_json_sink(spark, sf):
    path = scratch_path(spark, "report")
    report = validate_features(views.cells(spark, sf).drop("doc_id"))
    sinks.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("A11_profile_sink", "SELECT * FROM profile_rows")
def profile_sink(spark, sf):
    path = scratch_path(spark, "profile")
    sinks.write_table(profile_of(spark, sf), path)
    return sinks.read_table(spark, path)


def profile_inputs(spark, sf):
    raw = views.raw_cells(spark, sf).drop("doc_id")
    listings = raw.select(*[clean.missing_to_null(F.col(c)).alias(c) for c in raw.columns])
    photos = views.raw_photos(spark, sf)
    photos = photos.select(
        *[clean.missing_to_null(F.col(c)).alias(c) for c in photos.columns]
    )
    return listings, photos, views.table(spark, sf, "nation")


def profile_of(spark, sf):
    rows = profiling.data_profile(*profile_inputs(spark, sf))
    return rows.withColumn("value", r6(F.col("value")))


# --- B: cleaning, filters, predicates -----------------------------------------

@query("B1_missing_cells", f"""
SELECT doc_id, coalesce(capacity IN ({MISSING}), true) AS capacity_missing,
  coalesce(city IN ({MISSING}), true) AS city_missing,
  coalesce(name IN ({MISSING}), true) AS name_missing
FROM v_raw""")
def missing_cells(spark, sf):
    return views.raw_cells(spark, sf).select("doc_id", *[
        clean.missing_to_null(F.col(c)).isNull().alias(f"{c}_missing")
        for c in ("capacity", "city", "name")
    ])


def _cleaned(spark, sf, column, convert):
    cell = clean.missing_to_null(F.col(column))
    return views.raw_cells(spark, sf).select("doc_id", convert(cell).alias(column))


@query("B2_as_text", "SELECT doc_id, name, city FROM clean_cells")
def as_text(spark, sf):
    return views.raw_cells(spark, sf).select("doc_id", *[
        clean.as_text(clean.missing_to_null(F.col(c))).alias(c) for c in ("name", "city")
    ])


@query("B3_as_int", "SELECT doc_id, capacity FROM clean_cells")
def as_int(spark, sf):
    return _cleaned(spark, sf, "capacity", clean.as_int)


@query("B4_as_float", "SELECT doc_id, base_price FROM clean_cells")
def as_float(spark, sf):
    return _cleaned(spark, sf, "base_price", clean.as_float)


@query("B5_as_bool", "SELECT doc_id, instant_booking FROM clean_cells")
def as_bool(spark, sf):
    return _cleaned(spark, sf, "instant_booking", clean.as_bool)


@query("B6_parse_amenities", "SELECT doc_id, amenities FROM clean_cells")
def parse_amenities(spark, sf):
    return _cleaned(
        spark, sf, "amenities", lambda c: F.array_join(clean.parse_list(c), "~")
    )


@query("B7_listings_with_id", "SELECT listing_id, doc_id FROM clean_cells WHERE listing_id <> ''")
def listings_with_id(spark, sf):
    rows = views.raw_cells(spark, sf).withColumnRenamed("doc_id", "row_key")
    return tables.clean_listings(rows).select("listing_id", F.col("row_key").alias("doc_id"))


@query("B8_photos_with_entity", """
SELECT entity_id, file, seq FROM clean_photos WHERE entity_id <> '' AND file <> ''""")
def photos_with_entity(spark, sf):
    return tables.clean_photos(views.raw_photos(spark, sf)).select("entity_id", "file", "seq")


@query("B9_eligible_vertical", """
SELECT doc_id, vertical FROM clean_cells WHERE vertical IN ('', 'stay')""")
def eligible_vertical(spark, sf):
    rows = _cleaned(spark, sf, "vertical", clean.as_text)
    return tables.eligible(rows)


@query("B10_feature_columns", """
SELECT listing_id, round(quality_score, 6) AS quality_score,
  round(photo_technical, 6) AS photo_technical, round(photo_aesthetic, 6) AS photo_aesthetic,
  round(room_coverage, 6) AS room_coverage, round(amenity_check, 6) AS amenity_check,
  round(text_quality, 6) AS text_quality, round(completeness, 6) AS completeness,
  photo_status, version, quality_engine_version, config_version, explanation_json
FROM slice_features""")
def feature_columns(spark, sf):
    rows = slice_features(spark, sf)
    doubles = {n for n, t in rows.dtypes if t == "double"}
    return rows.select(*[
        r6(F.col(c)).alias(c) if c in doubles else F.col(c) for c in FEATURE_COLUMNS
    ])


part("inventory", """
SELECT DISTINCT CASE WHEN l_partkey % 3 = 0 THEN 'root/data/' || file
  WHEN l_partkey % 3 = 1 THEN 'root/' || file ELSE 'elsewhere/' || file END AS path
FROM v_photos
UNION
SELECT 'root/' || file FROM v_photos WHERE l_partkey % 6 = 0
""")


def inventory(spark, sf) -> DataFrame:
    """Files below a data folder, below its parent, and elsewhere."""
    rows = views.select(spark, sf, views.V_PHOTOS)
    kind = F.col("l_partkey") % 3
    first = rows.select(F.when(kind == 0, F.concat(F.lit("root/data/"), "file"))
                        .when(kind == 1, F.concat(F.lit("root/"), "file"))
                        .otherwise(F.concat(F.lit("elsewhere/"), "file")).alias("path"))
    second = rows.filter(F.col("l_partkey") % 6 == 0).select(
        F.concat(F.lit("root/"), "file").alias("path")
    )
    return first.union(second).distinct()


@query("B11_existing_photos", """
SELECT p.file, p.seq, coalesce(a.path, b.path) AS path FROM v_photos p
LEFT JOIN inventory a ON a.path = 'root/data/' || p.file
LEFT JOIN inventory b ON b.path = 'root/' || p.file
WHERE a.path IS NOT NULL OR b.path IS NOT NULL""")
def existing_photos(spark, sf):
    from hostlens.operators.matching import existing_photos as existing

    photos = views.photos(spark, sf).select("file", "seq")
    return existing(photos, inventory(spark, sf), "root/data").select("file", "seq", "path")


@query("B12_bad_photos", """
SELECT path, reason, width, height FROM (
  SELECT path, width, height, CASE WHEN is_blurry THEN 'Blurry photo'
    ELSE 'Below configured resolution target' END AS reason
  FROM photo_scored WHERE is_blurry OR is_low_resolution)""")
def bad_photos(spark, sf):
    flags = flagged_photos(scored_photos(spark, sf))
    return flags.select("path", F.substring_index("reason", ";", 1).alias("reason"),
                        "width", "height")


@query("B13_blurry", """
SELECT is_blurry, count(*) AS n FROM photo_scored GROUP BY is_blurry""")
def blurry(spark, sf):
    return scored_photos(spark, sf).groupBy("is_blurry").agg(F.count(F.lit(1)).alias("n"))


@query("B14_low_resolution", """
SELECT is_low_resolution, count(*) AS n FROM photo_scored GROUP BY is_low_resolution""")
def low_resolution(spark, sf):
    return scored_photos(spark, sf).groupBy("is_low_resolution").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("B15_confident_rooms", """
SELECT room, count(*) AS n FROM photo_scored
WHERE room_confidence >= 0.25 AND room <> 'other' GROUP BY room""")
def confident_rooms(spark, sf):
    from hostlens.operators.rooms import room_bit

    # counted, then dropped: a filter on rooms would move below the room rule and repeat
    # the whole path for every keyword of every room, in code too long to compile
    rows = scored_photos(spark, sf)
    return rows.groupBy("room").agg(F.count_if(room_bit() != 0).alias("n")).filter("n > 0")


@query("B17_stay_listings", "SELECT doc_id, name FROM clean_cells WHERE vertical = 'stay'")
def stay_listings(spark, sf):
    rows = views.raw_cells(spark, sf)
    rows = rows.withColumn("vertical", clean.missing_to_null(F.col("vertical")))
    stay = rows.filter(profiling.is_stay(rows))
    return stay.select("doc_id", clean.as_text(clean.missing_to_null(F.col("name"))).alias("name"))


@query("B18_required_columns", """
SELECT count(*) AS rows_checked, 'quality_score' AS refused_without FROM v_cells""")
def required_columns(spark, sf):
    rows = views.cells(spark, sf)
    require_columns(rows, FEATURE_COLUMNS)
    try:
        require_columns(rows.drop("quality_score"), FEATURE_COLUMNS)
        refused = ""
    except ValueError:
        refused = "quality_score"
    return rows.agg(F.count(F.lit(1)).alias("rows_checked")).withColumn(
        "refused_without", F.lit(refused)
    )


@query("B19_truth_label", """
SELECT coalesce(blur_label, '-') AS blur_label,
  coalesce(lower(trim(blur_label)) IN ('blurry', 'true', '1', 'yes'), false) AS truth,
  count(*) AS n FROM v_labels GROUP BY ALL""")
def truth_label(spark, sf):
    rows = views.labels(spark, sf)
    return rows.groupBy(
        F.coalesce("blur_label", F.lit("-")).alias("blur_label"),
        evaluation.is_blurry_label(F.col("blur_label")).alias("truth"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("B20_photo_path", """
SELECT CASE WHEN l_linenumber = 1 THEN '/abs/' || file ELSE 'root/data/' || file END AS path,
  count(*) AS n FROM v_photos GROUP BY 1""")
def photo_path(spark, sf):
    rows = views.select(spark, sf, views.V_PHOTOS)
    file = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("/abs/"), "file")).otherwise(
        F.col("file")
    )
    path = evaluation.resolved_path(file, "root/data")
    return rows.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"))
