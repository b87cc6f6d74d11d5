"""Queries for listing scores, explanations, ranking and whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.catalog import views
from hostlens.catalog.inputs import r6, slice_features
from hostlens.catalog.photos import names
from hostlens.catalog.registry import part, query
from hostlens.catalog.sqltext import (
    half_even, issue_reason, joined, positive_reason, text_issue,
)
from hostlens.functions import display
from hostlens.functions import explanation as ex
from hostlens.functions import text as tx
from hostlens.operators import listing, reporting, scoring
from hostlens.plans.features import build_features
from hostlens.settings import COMPONENTS, DEFAULTS, FEATURE_COLUMNS, check_weights
from hostlens.sources.tables import first_listings


def features(spark, sf) -> DataFrame:
    """The whole scoring job over listings and photos."""
    return build_features(views.listings(spark, sf), views.photos(spark, sf))


def rounded(rows: DataFrame) -> DataFrame:
    doubles = {n for n, t in rows.dtypes if t == "double"}
    return rows.select(*[r6(F.col(c)).alias(c) if c in doubles else F.col(c)
                         for c in rows.columns])


_ROUND = ", ".join(
    f"round({c}, 6) AS {c}" for c in ("quality_score", *COMPONENTS)
)

# --- text ---------------------------------------------------------------------


def _texts(spark, sf) -> DataFrame:
    return listing.with_text_quality(views.listings(spark, sf))


@query("H2_language_markers", "SELECT listing_id, arabic, french, english FROM text_measured")
def language_markers(spark, sf):
    return listing.text_measures(views.listings(spark, sf)).select(
        "listing_id", *tx.LANGUAGES
    )


@query("H3_word_count", "SELECT listing_id, word_count FROM text_measured")
def word_count(spark, sf):
    return listing.text_measures(views.listings(spark, sf)).select("listing_id", "word_count")


@query("H4_length_score", "SELECT length_score, count(*) AS n FROM text_scored GROUP BY ALL")
def length_score(spark, sf):
    rows = listing.text_measures(views.listings(spark, sf))
    return rows.groupBy(tx.length_score(F.col("word_count")).alias("length_score")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("H5_title_score", """
SELECT title_length, title_score, count(*) AS n FROM text_scored GROUP BY ALL""")
def title_score(spark, sf):
    rows = listing.text_measures(views.listings(spark, sf))
    return rows.groupBy(
        "title_length", tx.title_score(F.col("title_length")).alias("title_score")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("H6_text_score", f"""
SELECT listing_id, round(text_quality, 6) AS text_quality, {joined('text_reasons')} AS reasons
FROM text_scored""")
def text_score(spark, sf):
    return _texts(spark, sf).select(
        "listing_id", r6(F.col("text_quality")).alias("text_quality"),
        names("text_reasons").alias("reasons"),
    )


@query("D8_completeness", f"""
SELECT listing_id, round(completeness, 6) AS completeness,
  {joined('filled_fields')} AS filled, {joined('missing_fields')} AS missing,
  {joined('completeness_reasons')} AS reasons FROM listing_scored""")
def completeness(spark, sf):
    return listing.with_completeness(views.listings(spark, sf)).select(
        "listing_id", r6(F.col("completeness")).alias("completeness"),
        names("filled_fields").alias("filled"), names("missing_fields").alias("missing"),
        names("completeness_reasons").alias("reasons"),
    )


# --- weighted score -----------------------------------------------------------

_WEIGHTED = ", ".join(
    f"doc_id * {k} % 1009 / 10e0 AS {c}"
    for c, k in zip(COMPONENTS, (7, 11, 13, 17, 19, 23), strict=True)
)
part("component_rows", f"SELECT doc_id, {_WEIGHTED} FROM documents")
part("component_totals", """
SELECT *, least(greatest((photo_technical * 20e0 + photo_aesthetic * 15e0 + room_coverage * 10e0
  + amenity_check * 10e0 + text_quality * 15e0 + completeness * 30e0) / 100e0, 0e0), 100e0)
  AS total FROM component_rows
""")


def component_rows(spark, sf) -> DataFrame:
    return views.select(spark, sf, f"SELECT doc_id, {_WEIGHTED} FROM @documents")


@query("D9_weighted_score", f"""
SELECT doc_id, {half_even('total', 2)} AS quality_score FROM component_totals""")
def weighted_score(spark, sf):
    return scoring.with_quality_score(component_rows(spark, sf)).select(
        "doc_id", "quality_score"
    )


@query("J10_weight_check", """
SELECT 100e0 AS total, 3 AS refused, count(*) AS rows_scored FROM documents""")
def weight_check(spark, sf):
    total = check_weights()
    bad = [
        {**DEFAULTS.weights, "photo_technical": -10, "completeness": 60},
        {**DEFAULTS.weights, "photo_technical": float("nan")},
        {"photo_technical": 100},
    ]
    refused = 0
    for weights in bad:
        try:
            check_weights(weights)
        except ValueError:
            refused += 1
    rows = scoring.with_quality_score(component_rows(spark, sf))
    return rows.agg(
        F.lit(float(total)).alias("total"), F.lit(refused).alias("refused"),
        F.count("quality_score").alias("rows_scored"),
    )


# --- explanation --------------------------------------------------------------

part("reasons", """
SELECT listing_id, unnest(list_concat(list_concat(photo_reasons, text_reasons),
  completeness_reasons)) AS reason FROM slice_features_explained
""")


def _explained_slice(spark, sf) -> DataFrame:
    from hostlens.plans.features import listing_rows, score_rows
    from hostlens.sources.tables import eligible

    return score_rows(listing_rows(eligible(views.listings(spark, sf))), None)


@query("G5_reason_lists_in_order", f"""
SELECT listing_id, {joined('photo_reasons')} AS reasons FROM slice_features_explained""")
def reason_lists_in_order(spark, sf):
    rows = _explained_slice(spark, sf)
    return rows.select(
        "listing_id",
        F.array_join(F.concat(*scoring.PHOTO_REASONS), " | ").alias("reasons"),
    )


@query("H25_reason_class", f"""
SELECT reason, {positive_reason('reason')} AS positive, {issue_reason('reason')} AS issue,
  {text_issue('reason')} AS text_issue, count(*) AS n FROM reasons GROUP BY ALL""")
def reason_class(spark, sf):
    rows = _explained_slice(spark, sf)
    lists = F.concat(*scoring.PHOTO_REASONS, "text_reasons", "completeness_reasons")
    reason = F.col("reason")
    return rows.select(F.explode(lists).alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n")
    ).select(
        "reason", ex.is_positive_reason(reason).alias("positive"),
        ex.is_issue_reason(reason).alias("issue"), ex.is_text_issue(reason).alias("text_issue"),
        "n",
    )


@query("F6_list_truncation", f"""
SELECT listing_id, len(issues) AS all_issues, {joined('issues[1:10]')} AS issues,
  {joined('suggestions[1:8]')} AS suggestions FROM slice_features_explained""")
def list_truncation(spark, sf):
    rows = _explained_slice(spark, sf)
    lists = F.concat(*scoring.PHOTO_REASONS)
    every = (
        F.size(F.filter(lists, ex.is_issue_reason))
        + F.size(F.filter("text_reasons", ex.is_text_issue))
        + F.size(F.filter("completeness_reasons", lambda r: r.startswith("Missing")))
    )
    return rows.select(
        "listing_id", every.alias("all_issues"),
        F.array_join("explanation.issues", " | ").alias("issues"),
        F.array_join("explanation.suggestions", " | ").alias("suggestions"),
    )


@query("H18_explanation_json", "SELECT listing_id, explanation_json FROM slice_features")
def explanation_json(spark, sf):
    return slice_features(spark, sf).select("listing_id", "explanation_json")


@query("H19_read_explanation", """
SELECT listing_id, s.section, CAST(p - 1 AS INT) AS position, s.items[p] AS item FROM (
  SELECT listing_id, unnest([
    {'section': 'positive', 'items': positive[1:10]},
    {'section': 'issues', 'items': issues[1:10]},
    {'section': 'suggestions', 'items': suggestions[1:8]}]) AS s
  FROM slice_features_explained), range(1, 11) t(p) WHERE p <= len(s.items)""")
def read_explanation(spark, sf):
    return reporting.explanation_lists(slice_features(spark, sf))


@query("H15_amenity_title", f"""
SELECT key, array_to_string(list_transform(string_split(key, '_'),
  lambda w: upper(w[1:1]) || w[2:]), ' ') AS title, count(*) AS n
FROM (SELECT unnest(declared) AS key FROM declared_amenities) GROUP BY ALL""")
def amenity_title(spark, sf):
    from hostlens.operators.amenities import declared_keys

    keys = views.listings(spark, sf).select(
        F.explode(declared_keys(F.col("amenities"))).alias("key")
    ).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return keys.select("key", display.amenity_title(F.col("key")).alias("title"), "n")


@query("H16_score_level", f"""
SELECT doc_id, CASE WHEN q >= 80 THEN 'EXCELLENT' WHEN q >= 65 THEN 'GOOD'
  WHEN q >= 50 THEN 'NEEDS WORK' ELSE 'LOW' END AS level
FROM (SELECT doc_id, {half_even('total', 2)} AS q FROM component_totals)""")
def score_level(spark, sf):
    rows = scoring.with_quality_score(component_rows(spark, sf))
    return rows.select("doc_id", display.score_level(F.col("quality_score")).alias("level"))


@query("H17_score_bar", f"""
SELECT doc_id, '[' || repeat('#', n) || repeat('.', 20 - n) || ']' AS bar FROM (
  SELECT doc_id, CAST(round_even(least(greatest(q, 0e0), 100e0) / 100e0 * 20e0, 0) AS BIGINT) AS n
  FROM (SELECT doc_id, {half_even('total', 2)} AS q FROM component_totals))""")
def score_bar(spark, sf):
    rows = scoring.with_quality_score(component_rows(spark, sf))
    return rows.select("doc_id", display.score_bar(F.col("quality_score")).alias("bar"))


@query("H24_megapixels", f"""
SELECT width, height, width::VARCHAR || ' x ' || height::VARCHAR || ' px ('
  || printf('%.2f', {half_even('area', 2)}) || ' MP)' AS size, count(*) AS n
FROM (SELECT width, height, width::DOUBLE * height::DOUBLE / 1e6 AS area FROM v_photos)
GROUP BY ALL""")
def megapixels(spark, sf):
    sizes = views.photos(spark, sf).groupBy("width", "height").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select(
        "width", "height",
        display.megapixel_text(F.col("width"), F.col("height")).alias("size"), "n",
    )


# --- order, limits, ranks -----------------------------------------------------

@query("F2_first_listings", """
SELECT listing_id, vertical FROM v_listings ORDER BY doc_id LIMIT 100""")
def first_n_listings(spark, sf):
    return first_listings(views.listings(spark, sf), 100).select("listing_id", "vertical")


@query("F3_sorted_by_score", """
SELECT listing_id, quality_score FROM slice_features
ORDER BY quality_score DESC, listing_id""")
def sorted_by_score(spark, sf):
    rows = slice_features(spark, sf).select("listing_id", "quality_score")
    return reporting.by_score(rows)


@query("F4_first_rows", f"""
SELECT listing_id, {_ROUND}, photo_status FROM slice_features
ORDER BY listing_id LIMIT 20""")
def first_rows(spark, sf):
    rows = rounded(slice_features(spark, sf)).orderBy("listing_id")
    return reporting.first_rows(rows).select(
        "listing_id", "quality_score", *COMPONENTS, "photo_status"
    )


@query("E1_rank", """
SELECT listing_id, row_number() OVER (ORDER BY quality_score DESC, listing_id) AS rank
FROM slice_features""")
def rank(spark, sf):
    return reporting.ranked(slice_features(spark, sf)).select("listing_id", "rank")


@query("D24_report_totals", """
SELECT count(*) AS listings_scored, round(coalesce(avg(quality_score), 0), 6) AS mean_score
FROM slice_features""")
def report_totals(spark, sf):
    return rounded(reporting.report_totals(slice_features(spark, sf)))


# --- whole jobs ---------------------------------------------------------------

@query("C8_components_per_listing", f"""
SELECT listing_id, {', '.join(f'round({c}, 6) AS {c}' for c in COMPONENTS)}
FROM features""")
def components_per_listing(spark, sf):
    return rounded(features(spark, sf).select("listing_id", *COMPONENTS))


@query("J1_score_listings", f"""
SELECT listing_id, {_ROUND}, photo_status FROM features""")
def score_listings(spark, sf):
    return rounded(features(spark, sf).select(
        "listing_id", "quality_score", *COMPONENTS, "photo_status"
    ))


@query("J2_explanations", "SELECT listing_id, explanation_json FROM features")
def explanations(spark, sf):
    return features(spark, sf).select("listing_id", "explanation_json")


@query("J3_result_versions", """
SELECT version, quality_engine_version, config_version, photo_status, count(*) AS n
FROM features GROUP BY ALL""")
def result_versions(spark, sf):
    return features(spark, sf).groupBy(
        "version", "quality_engine_version", "config_version", "photo_status"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("J4_feature_rows", f"""
SELECT listing_id, {_ROUND}, photo_status, version, quality_engine_version, config_version,
  explanation_json FROM features""")
def feature_rows(spark, sf):
    return rounded(features(spark, sf)).select(*FEATURE_COLUMNS)


_ONE = {c: half_even(c, 1) for c in ("quality_score", *COMPONENTS)}


@query("J5_ranked_report", f"""
SELECT listing_id, {', '.join(f'{sql} AS {c}' for c, sql in _ONE.items())}, photo_status,
  row_number() OVER (ORDER BY quality_score DESC, listing_id) AS rank,
  CASE WHEN quality_score >= 80 THEN 'EXCELLENT' WHEN quality_score >= 65 THEN 'GOOD'
    WHEN quality_score >= 50 THEN 'NEEDS WORK' ELSE 'LOW' END AS level,
  '[' || repeat('#', CAST(round_even(quality_score / 100e0 * 20e0, 0) AS BIGINT))
    || repeat('.', 20 - CAST(round_even(quality_score / 100e0 * 20e0, 0) AS BIGINT)) || ']' AS bar
FROM features""")
def ranked_report(spark, sf):
    return reporting.ranked(features(spark, sf))


@query("J5_photo_flags", f"""
SELECT listing_id, b.path AS path, b.reason || '; ' || b.width::VARCHAR || ' x '
  || b.height::VARCHAR || ' px (' || printf('%.2f', {half_even('area', 2)}) || ' MP)' AS flag
FROM (SELECT listing_id, b, b.width::DOUBLE * b.height::DOUBLE / 1e6 AS area
      FROM (SELECT listing_id, unnest(bad_photos) AS b FROM features_explained))""")
def photo_flags(spark, sf):
    return reporting.photo_flags(features(spark, sf))
