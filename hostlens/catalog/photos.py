"""Queries on photos: matching, duplicates, rooms, amenities, pixels, embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from hostlens.catalog import views
from hostlens.catalog.inputs import inventory, r6
from hostlens.catalog.registry import part, query
from hostlens.catalog.sqltext import (
    aesthetic, amenity_case, clamp, exposure, joined, normal, quoted, resolution,
    room_case, room_phrase,
)
from hostlens.functions import display
from hostlens.functions.numeric import names_in, normalise
from hostlens.functions.similarity import hamming, prompt_softmax
from hostlens.operators import amenities, duplicates, matching, ordering, rooms, technical
from hostlens.operators.aliases import with_alias_key
from hostlens.operators.pixels import photo_metrics
from hostlens.plans.features import Vision, photo_rows
from hostlens.session import cut
from hostlens.settings import AMENITY_LABELS, DEFAULTS, EXPECTED_ROOMS, ROOM_LABELS
from hostlens.sources.tables import eligible


def members(spark, sf) -> DataFrame:
    """Scored photos with their gallery, fallback included."""
    listings = eligible(views.listings(spark, sf))
    found = matching.gallery_members(listings, views.photos(spark, sf))
    return photo_rows(found, Vision())


# --- C: joins -----------------------------------------------------------------

@query("C1_suffix_match", """
SELECT l.listing_id, count(p.file) AS photos, count(DISTINCT p.entity_id) AS entities,
  min(p.file) AS first_file
FROM eligible_listings l LEFT JOIN photo_scored p
  ON p.entity_digits = l.gallery AND l.gallery <> ''
GROUP BY l.listing_id""")
def suffix_match(spark, sf):
    listings = eligible(views.listings(spark, sf)).select(
        "listing_id", matching.id_digits(F.col("listing_id")).alias("gallery")
    )
    direct = matching.direct_members(views.photos(spark, sf))
    # two levels: photos per entity, entities per gallery
    per_entity = direct.groupBy("gallery", "entity_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("file").alias("f")
    )
    per_gallery = per_entity.groupBy("gallery").agg(
        F.sum("n").alias("photos"), F.count(F.lit(1)).alias("entities"),
        F.min("f").alias("first_file"),
    )
    keyed = listings.withColumn(
        "gallery", matching.spread_key(F.col("gallery"), F.col("listing_id"))
    )
    return keyed.join(per_gallery, "gallery", "left").select(
        "listing_id", F.coalesce("photos", F.lit(0)).alias("photos"),
        F.coalesce("entities", F.lit(0)).alias("entities"), "first_file",
    )


@query("C2_path_fallback_match", """
SELECT w.gallery, count(*) AS photos, sum(p.seq) AS seq_sum, min(p.file) AS first_file
FROM (SELECT DISTINCT regexp_extract(listing_id, '([0-9]+)$', 1) AS gallery FROM v_listings
      WHERE regexp_extract(listing_id, '([0-9]+)$', 1) NOT IN
        (SELECT regexp_extract(entity_id, '([0-9]+)$', 1) FROM v_photos)) w
JOIN v_photos p ON contains(p.file, w.gallery) GROUP BY w.gallery""")
def path_fallback_match(spark, sf):
    listings = views.listings(spark, sf).select("listing_id")
    photos = views.photos(spark, sf).select("entity_id", "file", "seq")
    wanted = matching.wanted_galleries(listings)
    unmatched = matching.unmatched_galleries(wanted, photos)
    found = matching.fallback_members(unmatched, photos)
    return found.groupBy("gallery").agg(
        F.count(F.lit(1)).alias("photos"), F.sum("seq").alias("seq_sum"),
        F.min("file").alias("first_file"),
    )


@query("C3_photo_file_lookup", """
SELECT p.entity_id, count(*) AS photos,
  count(*) FILTER (a.path IS NOT NULL) AS below_data,
  count(*) FILTER (a.path IS NULL) AS below_parent
FROM v_photos p
LEFT JOIN inventory a ON a.path = 'root/data/' || p.file
LEFT JOIN inventory b ON b.path = 'root/' || p.file
WHERE a.path IS NOT NULL OR b.path IS NOT NULL GROUP BY p.entity_id""")
def photo_file_lookup(spark, sf):
    photos = views.photos(spark, sf).select("entity_id", "file")
    found = matching.existing_photos(photos, inventory(spark, sf), "root/data")
    below = F.col("path").startswith("root/data/")
    return found.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("photos"), F.count_if(below).alias("below_data"),
        F.count_if(~below).alias("below_parent"),
    )


@query("C4_metrics_with_rooms", f"""
SELECT path, {room_phrase('guess', 'sure')} AS guess, count(*) AS n FROM (
  SELECT path, CASE WHEN l_partkey % 4 <> 0 THEN room END AS guess,
    CASE WHEN l_partkey % 4 <> 0 THEN room_confidence END AS sure FROM photo_scored)
GROUP BY ALL""")
def metrics_with_rooms(spark, sf):
    photos = views.select(spark, sf, views.V_PHOTOS).withColumnRenamed("file", "path")
    guessed = rooms.with_room(photos.filter(F.col("l_partkey") % 4 != 0).select("path"))
    seen = rooms.join_predictions(photos.select("path"), guessed)
    phrase = display.room_phrase(F.col("room"), F.col("room_confidence"))
    return seen.groupBy("path", phrase.alias("guess")).agg(F.count(F.lit(1)).alias("n"))


part("declared_and_seen", f"""
SELECT *, doc_id * 37 % 1024 AS mask,
  list_sort(list_filter([{', '.join(
      f"CASE WHEN (doc_id * 37 % 1024) & {1 << i} <> 0 THEN '{a}' END"
      for i, a in enumerate(AMENITY_LABELS))}], lambda x: x IS NOT NULL)) AS detected,
  list_sort(list_filter(declared, lambda d: list_contains(detected, d))) AS matched,
  list_filter(declared, lambda d: NOT list_contains(detected, d)) AS unconfirmed,
  list_filter(detected, lambda d: NOT list_contains(declared, d)) AS undeclared
FROM declared_amenities
""")


def declared_and_seen(spark, sf) -> DataFrame:
    """Declared keys per listing against a mask of seen amenities."""
    rows = views.listings(spark, sf).select(
        "listing_id", "photo_count", amenities.declared_keys(F.col("amenities")).alias("declared"),
        (F.col("row_key") * 37 % 1024).cast("int").alias("detected_mask"),
    )
    return rows


def _checked(spark, sf) -> DataFrame:
    rows = declared_and_seen(spark, sf).withColumn(
        "detected", amenities.detected_keys(F.col("detected_mask"))
    )
    return rows.withColumns(amenities.cross_check(F.col("declared"), F.col("detected")))


def names(c: str):
    return F.array_join(c, " | ")


@query("C5_declared_against_detected", f"""
SELECT listing_id, {joined('matched')} AS matched, {joined('unconfirmed')} AS unconfirmed,
  {joined('undeclared')} AS undeclared FROM declared_and_seen""")
def declared_against_detected(spark, sf):
    return _checked(spark, sf).select(
        "listing_id", *[names(c).alias(c) for c in ("matched", "unconfirmed", "undeclared")]
    )


part("room_masks", f"""
SELECT doc_id, list_filter([{', '.join(
    f"CASE WHEN (doc_id * 29 % 128) & {1 << i} <> 0 THEN '{r}' END"
    for i, r in enumerate(EXPECTED_ROOMS))}], lambda x: x IS NOT NULL) AS covered,
  list_filter([{quoted(*EXPECTED_ROOMS)}], lambda r: NOT list_contains(covered, r)) AS missing
FROM documents
""")


@query("C6_expected_against_covered", f"""
SELECT doc_id, {joined('list_sort(covered)')} AS covered_rooms,
  {joined('missing')} AS missing_rooms,
  len(list_filter(covered, lambda r: r NOT IN ('pool', 'view'))) * 20e0 AS room_coverage
FROM room_masks""")
def expected_against_covered(spark, sf):
    rows = views.table(spark, sf, "documents").select(
        "doc_id", (F.col("doc_id") * 29 % 128).cast("int").alias("room_mask"),
        F.lit(1).alias("photo_count"),
    )
    found = rows.withColumns(rooms.coverage_columns())
    return found.select(
        "doc_id", names("covered_rooms").alias("covered_rooms"),
        names("missing_rooms").alias("missing_rooms"),
        r6(F.col("room_coverage")).alias("room_coverage"),
    )


part("amenity_words", """
SELECT item, lower(trim(item)) AS word FROM (
  SELECT unnest(amenities) AS item FROM typed_listings
  UNION ALL SELECT unnest(string_split(text, chr(10))) FROM documents)
""")


@query("C7_amenity_alias_match", f"""
SELECT item, {amenity_case('word')} AS key, count(*) AS n FROM amenity_words GROUP BY ALL""")
def amenity_alias_match(spark, sf):
    listed = views.listings(spark, sf).select(F.explode("amenities").alias("item"))
    documents = views.table(spark, sf, "documents")
    words = documents.select(F.explode(F.split("text", "\n")).alias("item"))
    items = listed.unionByName(words).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    keyed = items.withColumn("word", F.trim(F.lower("item")))
    return keyed.select("item", amenities.amenity_key(F.col("word")).alias("key"), "n")


part("part_aliases", """
SELECT p_partkey AS place, p_name AS key, lower(trim(split_part(p_name, ' ', 1))) AS alias FROM part
UNION ALL SELECT 1000000000 + p_partkey, p_brand, lower(p_brand) FROM part
""")


@query("C7_alias_table", """
SELECT item, count(*) AS n, (SELECT min_by(key, {'p': place, 'k': key, 'a': alias})
  FROM part_aliases a WHERE contains(w.word, alias) OR contains(alias, w.word)) AS key
FROM amenity_words w GROUP BY item, word""")
def alias_table_match(spark, sf):
    """Amenity texts against an alias table that grows with the parts."""
    parts = views.table(spark, sf, "part")
    table = parts.select(
        F.col("p_partkey").cast("bigint").alias("place"), F.col("p_name").alias("key"),
        F.trim(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("alias"),
    ).unionByName(parts.select(
        (F.col("p_partkey") + 1_000_000_000).cast("bigint").alias("place"),
        F.col("p_brand").alias("key"), F.lower("p_brand").alias("alias")))
    listed = views.listings(spark, sf).select(F.explode("amenities").alias("item"))
    words = views.table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("item"))
    items = listed.unionByName(words).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    keyed = with_alias_key(
        items.withColumn("word", F.trim(F.lower("item"))), table, shares=True)
    return keyed.select("item", "n", "key")


@query("C10_near_copies", """
SELECT h.gallery, sum(h.copies) FILTER (h.copies > 1 OR n.u IS NOT NULL) AS near_photos,
  sum(h.copies) AS photos
FROM hashes h LEFT JOIN (SELECT DISTINCT gallery, u FROM near_pairs) n
  ON n.gallery = h.gallery AND n.u = h.phash
GROUP BY h.gallery""")
def near_copies(spark, sf):
    found = duplicates.near_copies(members(spark, sf), DEFAULTS.hash_threshold)
    return found.groupBy("gallery").agg(
        F.sum(F.when(F.col("has_near_copy"), F.col("copies"))).alias("near_photos"),
        F.sum("copies").alias("photos"),
    )


part("sign_hashes", f"""
SELECT gallery, vec_id, CAST({' + '.join(
    f"(CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i}::HUGEINT ELSE 0 END)"
    for i in range(63))} AS BIGINT) AS phash FROM v_embeddings
""")


def sign_hashes(spark, sf) -> DataFrame:
    bits = [
        F.when(F.get("embedding", F.lit(i)) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
        for i in range(63)
    ]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return views.embeddings(spark, sf).select("vec_id", "gallery", mask.alias("phash"))


@query("C10_near_embeddings", """
SELECT h.vec_id, h.gallery, EXISTS (SELECT 1 FROM sign_hashes o WHERE o.gallery = h.gallery
  AND o.vec_id <> h.vec_id AND bit_count(xor(o.phash, h.phash)) <= 20) AS has_near_copy
FROM sign_hashes h""")
def near_embeddings(spark, sf):
    hashed = sign_hashes(spark, sf)
    found = duplicates.near_copies(hashed, threshold=20)
    return hashed.join(found, ["gallery", "phash"]).select("vec_id", "gallery", "has_near_copy")


# --- D, E, F, G on photos -----------------------------------------------------

@query("D1_photos_by_entity", """
SELECT entity_id, count(*) AS photos, min(seq) AS first_seq, max(seq) AS last_seq,
  count(*) FILTER (is_cover) AS covers FROM v_photos GROUP BY entity_id""")
def photos_by_entity(spark, sf):
    return views.photos(spark, sf).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("photos"), F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"), F.count_if(F.col("is_cover")).alias("covers"),
    )


def _technical_sql() -> str:
    from hostlens.catalog.parts import technical_reasons_sql, technical_sql

    return f"""
SELECT gallery, n_photos AS photo_count, valid_count, blurry_count, low_resolution_count,
  duplicate_groups, round({technical_sql()}, 6) AS photo_technical,
  {joined(technical_reasons_sql('n_photos'))} AS reasons FROM galleries"""


@query("D2_technical_score", _technical_sql())
def technical_score(spark, sf):
    rows = members(spark, sf)
    groups = duplicates.duplicate_groups(rows, DEFAULTS.hash_threshold)
    found = technical.score_galleries(rows, groups)
    return found.select(
        "gallery", "photo_count", "valid_count", "blurry_count", "low_resolution_count",
        "duplicate_groups", r6(F.col("photo_technical")).alias("photo_technical"),
        names("technical_reasons").alias("reasons"),
    )


@query("D3_duplicate_groups", "SELECT gallery, duplicate_groups FROM duplicate_counts")
def duplicate_groups(spark, sf):
    return duplicates.duplicate_groups(members(spark, sf), DEFAULTS.hash_threshold)


@query("D4_aesthetic_score", f"""
SELECT gallery, round(avg_aesthetic, 6) AS photo_aesthetic,
  round({clamp('0.8e0 * avg_aesthetic + 12.5e0')}, 6) AS calibrated,
  CASE WHEN avg_aesthetic >= 65 THEN 'Good composition and lighting'
    ELSE 'Photo aesthetics could be improved' END AS reason
FROM gallery_stats""")
def aesthetic_score(spark, sf):
    stats = technical.score_galleries(members(spark, sf))
    score = technical.aesthetic_score()
    return stats.select(
        "gallery", r6(score).alias("photo_aesthetic"),
        r6(technical.aesthetic_score((0.8, 12.5))).alias("calibrated"),
        F.get(technical.aesthetic_reasons(score), F.lit(0)).alias("reason"),
    )


def _rooms_sql() -> str:
    from hostlens.catalog.parts import _room_list

    return f"""
SELECT gallery, {joined('list_sort(' + _room_list('room_mask', True) + ')')} AS covered_rooms,
  {joined(_room_list('room_mask', False))} AS missing_rooms,
  bit_count(room_mask & 31) * 20e0 AS room_coverage,
  CASE WHEN room_mask & 31 = 31 THEN 'Good room coverage' ELSE
    {joined("list_transform(list_filter(" + _room_list('room_mask', False)
            + ", lambda r: r NOT IN ('pool', 'view')), "
            + "lambda r: 'No ' || r || ' photo detected')")} END AS reasons
FROM gallery_stats"""


@query("D5_room_coverage", _rooms_sql())
def room_coverage(spark, sf):
    found = members(spark, sf).groupBy("gallery").agg(
        rooms.room_aggregate(), F.count(F.lit(1)).alias("photo_count")
    ).withColumns(rooms.coverage_columns())
    return found.select(
        "gallery", names("covered_rooms").alias("covered_rooms"),
        names("missing_rooms").alias("missing_rooms"),
        r6(F.col("room_coverage")).alias("room_coverage"), names("room_reasons").alias("reasons"),
    )


def prompt_vectors(spark, sf, labels: int) -> list[list[float]]:
    """One vector per label: the embedding with the lowest id; `labels` rows."""
    rows = (
        views.table(spark, sf, "embeddings").filter(F.col("label") < labels)
        .groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    )
    return [row["v"] for row in sorted(rows.collect(), key=lambda row: row["label"])]


def _probabilities(labels: int) -> str:
    return f"""
SELECT vec_id, gallery, path, list(p ORDER BY label) AS p FROM (
  SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM (
    SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM (
      SELECT v.vec_id, v.gallery, v.path, q.label,
        100e0 * list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
      FROM v_embeddings v, (SELECT label, arg_min(embedding, vec_id) AS embedding
        FROM embeddings WHERE label < {labels} GROUP BY label) q)))
GROUP BY vec_id, gallery, path"""


part("room_probabilities", _probabilities(8))
part("amenity_probabilities", _probabilities(10))
part("room_predictions", f"""
SELECT vec_id, gallery, path, list_max(p) AS confidence,
  [{quoted(*ROOM_LABELS)}][list_position(p, list_max(p))] AS room FROM room_probabilities
""")
part("amenity_hits", f"""
SELECT vec_id, gallery, list_sort(list_filter([{', '.join(
    f"CASE WHEN p[{i + 1}] >= 0.22 THEN '{a}' END" for i, a in enumerate(AMENITY_LABELS))}],
  lambda x: x IS NOT NULL)) AS detected FROM amenity_probabilities
""")


def _with_amenities(spark, sf) -> DataFrame:
    rows = views.embeddings(spark, sf).select("vec_id", "gallery", "embedding")
    return amenities.with_detected(rows, "embedding", prompt_vectors(spark, sf, 10))


@query("B16_detected_amenities", f"""
SELECT vec_id, {joined('detected')} AS detected FROM amenity_hits""")
def detected_amenities(spark, sf):
    rows = _with_amenities(spark, sf)
    keys = amenities.detected_keys(F.col("amenity_mask"))
    return rows.select("vec_id", F.array_join(keys, " | ").alias("detected"))


@query("D6_gallery_amenities", f"""
SELECT gallery, {joined("list_sort(list_distinct(flatten(list(detected))))")} AS detected
FROM amenity_hits GROUP BY gallery""")
def gallery_amenities(spark, sf):
    masks = _with_amenities(spark, sf).groupBy("gallery").agg(amenities.amenity_aggregate())
    keys = amenities.detected_keys(F.col("detected_mask"))
    return masks.select("gallery", F.array_join(keys, " | ").alias("detected"))


part("amenity_checked", f"""
SELECT listing_id, photo_count, declared, matched, unconfirmed, undeclared,
  CASE WHEN photo_count = 0 THEN 50e0
    WHEN len(declared) = 0 AND len(detected) = 0 THEN 50e0
    WHEN len(declared) = 0 THEN {clamp('(70e0 + least(len(undeclared) * 5, 20))')}
    ELSE {clamp('''(len(matched)::DOUBLE / len(declared)::DOUBLE * 100e0
      - len(unconfirmed) * 0.3e0 * 10 + least(len(undeclared) * 3, 10))''')} END AS amenity_check,
  CASE WHEN photo_count = 0 THEN ['Visual amenity detection unavailable; neutral score used']
    WHEN len(matched) + len(unconfirmed) + len(undeclared) = 0
      THEN ['Amenity information available']
    ELSE list_concat(list_concat(
      list_transform(matched, lambda k: titled(k) || ' detected and declared'),
      list_transform(unconfirmed, lambda k: titled(k) || ' declared but not visually confirmed')),
      list_transform(undeclared, lambda k: titled(k) || ' detected but not declared')) END
    AS reasons
FROM declared_and_seen
""".replace("titled(k)", "array_to_string(list_transform(string_split(k, '_'), "
            "lambda w: upper(w[1:1]) || w[2:]), ' ')"))


@query("D7_amenity_check", f"""
SELECT listing_id, round(amenity_check, 6) AS amenity_check, {joined('reasons')} AS reasons
FROM amenity_checked""")
def amenity_check(spark, sf):
    rows = amenities.with_amenity_check(declared_and_seen(spark, sf), vision=True)
    return rows.select(
        "listing_id", r6(F.col("amenity_check")).alias("amenity_check"),
        names("amenity_reasons").alias("reasons"),
    )


@query("E2_photo_position", """
SELECT gallery, file, row_number() OVER (PARTITION BY gallery
  ORDER BY entity_first, seq, m.row_key) AS position
FROM members m JOIN entity_order o ON o.entity_id = m.entity_id""")
def photo_position(spark, sf):
    photos = views.photos(spark, sf).select("entity_id", "file", "seq", "row_key")
    listings = eligible(views.listings(spark, sf))
    found, wanted = matching.open_members(listings, photos)
    # written: the shuffle that finds the first photos goes
    first = cut(matching.entity_order(photos), "first")
    # the photos of an entity follow each other, in the place of its first one
    placed = ordering.position_by_section(
        found, "gallery", "entity_id", first, [F.col("seq"), F.col("row_key")],
        kept=["gallery", "file"], groups=wanted,
    )
    return placed.select("gallery", "file", "position")


@query("E3_top_label", f"""
SELECT vec_id, [{quoted(*ROOM_LABELS)}][list_position(p, list_max(p))] AS top_label
FROM room_probabilities""")
def top_label(spark, sf):
    from hostlens.functions.similarity import top_label as top

    soft = prompt_softmax(prompt_vectors(spark, sf, 8))
    rows = views.embeddings(spark, sf).select("vec_id", soft(F.col("embedding")).alias("p"))
    return rows.select("vec_id", top(F.col("p"), ROOM_LABELS).alias("top_label"))


@query("E4_first_keyword", f"""
SELECT split_part(split_part(file, '/', -1), '_', 1) AS start, {room_case('file', 0)} AS room,
  count(*) AS n FROM v_photos GROUP BY ALL""")
def first_keyword(spark, sf):
    seen = rooms.with_room(views.photos(spark, sf).select("path"))
    start = F.substring_index(F.substring_index("path", "/", -1), "_", 1)
    return seen.groupBy(start.alias("start"), "room").agg(F.count(F.lit(1)).alias("n"))


@query("F1_photos_by_seq", """
SELECT entity_id, file, row_number() OVER (PARTITION BY entity_id ORDER BY seq, row_key)
  AS position FROM photo_scored""")
def photos_by_seq(spark, sf):
    photos = views.photos(spark, sf).select("entity_id", "file", "seq", "row_key")
    placed = ordering.position_in_group(
        photos, "entity_id", [F.col("seq"), F.col("row_key")]
    )
    return placed.select("entity_id", "file", "position")


@query("F7_sorted_names", f"""
SELECT listing_id, {joined('declared')} AS declared, {joined('detected')} AS detected
FROM declared_and_seen""")
def sorted_names(spark, sf):
    return _checked(spark, sf).select(
        "listing_id", names("declared").alias("declared"), names("detected").alias("detected")
    )


@query("G1_intersection", f"SELECT listing_id, {joined('matched')} AS matched FROM "
                          "declared_and_seen")
def intersection(spark, sf):
    return _checked(spark, sf).select("listing_id", names("matched").alias("matched"))


@query("G2_difference", f"""
SELECT listing_id, {joined('unconfirmed')} AS unconfirmed FROM declared_and_seen""")
def difference(spark, sf):
    return _checked(spark, sf).select("listing_id", names("unconfirmed").alias("unconfirmed"))


@query("G3_union_over_photos", f"""
SELECT gallery, {joined('list_sort(list(DISTINCT room))')} AS rooms FROM members
WHERE room_confidence >= 0.25 AND room <> 'other' GROUP BY gallery""")
def union_over_photos(spark, sf):
    masks = members(spark, sf).groupBy("gallery").agg(rooms.room_aggregate())
    seen = F.array_sort(names_in(F.col("room_mask"), EXPECTED_ROOMS))
    return masks.filter("room_mask <> 0").select(
        "gallery", F.array_join(seen, " | ").alias("rooms")
    )


@query("G6_entities_of_gallery", """
SELECT entity_digits AS gallery, entity_id, count(*) AS photos FROM photo_scored
WHERE entity_digits <> '' GROUP BY ALL""")
def entities_of_gallery(spark, sf):
    direct = matching.direct_members(views.photos(spark, sf))
    return direct.groupBy("gallery", "entity_id").agg(F.count(F.lit(1)).alias("photos"))


# --- H: scalar functions on photos --------------------------------------------

@query("H1_id_digits", r"""
SELECT entity_id, regexp_extract(entity_id, '([0-9]+)$', 1) AS digits, count(*) AS n
FROM v_photos GROUP BY ALL""")
def id_digits(spark, sf):
    return views.photos(spark, sf).groupBy(
        "entity_id", matching.id_digits(F.col("entity_id")).alias("digits")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("H7_normalise", f"""
SELECT l_orderkey, l_linenumber, l_partkey,
  round({normal('l_quantity', '10e0', '40e0')}, 6) AS score FROM lineitem""")
def normalise_quantity(spark, sf):
    return views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        r6(normalise(F.col("l_quantity"), 10.0, 40.0)).alias("score"),
    )


@query("H8_clamp", f"""
SELECT s_suppkey, round({clamp('s_acctbal')}, 6) AS clamped FROM supplier""")
def clamp_balance(spark, sf):
    from hostlens.functions.numeric import clamp as clamped

    return views.table(spark, sf, "supplier").select(
        "s_suppkey", r6(clamped(F.col("s_acctbal"))).alias("clamped")
    )


@query("H9_exposure_score", f"""
SELECT round(brightness, 6) AS brightness, round({exposure('brightness')}, 6) AS exposure,
  count(*) AS n FROM v_photos GROUP BY ALL""")
def exposure_score(spark, sf):
    return views.photos(spark, sf).groupBy(
        r6(F.col("brightness")).alias("brightness"),
        r6(technical.exposure_score(F.col("brightness"))).alias("exposure"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("H10_resolution_score", f"""
SELECT width, height, round({resolution('width', 'height')}, 6) AS resolution,
  count(*) AS n FROM v_photos GROUP BY ALL""")
def resolution_score(spark, sf):
    score = technical.resolution_score(F.col("width"), F.col("height"))
    return views.photos(spark, sf).groupBy(
        "width", "height", r6(score).alias("resolution")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("H11_aesthetic_heuristic", f"""
SELECT file, round({aesthetic()}, 6) AS aesthetic FROM v_photos""")
def aesthetic_heuristic(spark, sf):
    score = technical.aesthetic_raw(
        F.col("valid"), F.col("sharpness"), F.col("colorfulness"), F.col("contrast")
    )
    return views.photos(spark, sf).select("file", r6(score).alias("aesthetic"))


@query("H13_room_from_file_name", f"""
SELECT file, {room_case('file', 0)} AS room, {room_case('file', 1)} AS confidence
FROM v_photos""")
def room_from_file_name(spark, sf):
    seen = rooms.with_room(views.photos(spark, sf).select("file"), "file")
    return seen.select("file", "room", F.col("room_confidence").alias("confidence"))


@query("H14_room_phrase", f"""
SELECT vec_id, {room_phrase('room', 'confidence')} AS phrase FROM room_predictions""")
def room_phrase_of(spark, sf):
    seen = _with_rooms(spark, sf)
    return seen.select(
        "vec_id",
        display.room_phrase(F.col("room"), F.col("room_confidence")).alias("phrase"),
    )


@query("H22_prompt_softmax", """
SELECT vec_id, unnest(range(1, 9)) AS slot, round(unnest(p), 6) AS probability
FROM room_probabilities""")
def prompt_softmax_rows(spark, sf):
    soft = prompt_softmax(prompt_vectors(spark, sf, 8))
    rows = views.embeddings(spark, sf).select("vec_id", soft(F.col("embedding")).alias("p"))
    return rows.select("vec_id", F.posexplode("p").alias("slot", "probability")).select(
        "vec_id", (F.col("slot") + 1).alias("slot"),
        r6(F.col("probability")).alias("probability"),
    )


@query("H23_hamming_distance", """
SELECT vec_id, bit_count(xor(phash, vec_id * 2654435761)) AS distance FROM sign_hashes""")
def hamming_distance(spark, sf):
    return sign_hashes(spark, sf).select(
        "vec_id",
        hamming(F.col("phash"), F.col("vec_id") * F.lit(2654435761)).alias("distance"),
    )


# --- K: pixel kernels ---------------------------------------------------------

_SIDE = 32


def _sql_channel(c: int) -> str:
    place = f"((i // 32) // 4 * 8 + (i % 32) // 4 + {21 * c}) % 64 + 1"
    grain = f"((i % 32) * 7 + (i // 32) * 13 + {5 * c}) % 17"
    return (
        f"least(greatest(floor((embedding[{place}]::DOUBLE + 0.6e0) * 200e0)::BIGINT + {grain},"
        " 0), 255)"
    )


part("pixel_rows", f"""
SELECT vec_id, i, b, g, r, (b * 3735 + g * 19235 + r * 9798 + 16384) >> 15 AS grey,
  (b * 7471 + g * 38470 + r * 19595 + 32768) >> 16 AS luma
FROM (SELECT vec_id, i, {_sql_channel(0)} AS b, {_sql_channel(1)} AS g, {_sql_channel(2)} AS r
      FROM embeddings, range(1024) t(i))
""")
part("grey_lists", "SELECT vec_id, list(grey ORDER BY i) AS v FROM pixel_rows GROUP BY vec_id")
part("laplacian", """
SELECT vec_id, v[(CASE WHEN y = 0 THEN 1 ELSE y - 1 END) * 32 + x + 1]
  + v[(CASE WHEN y = 31 THEN 30 ELSE y + 1 END) * 32 + x + 1]
  + v[y * 32 + (CASE WHEN x = 0 THEN 1 ELSE x - 1 END) + 1]
  + v[y * 32 + (CASE WHEN x = 31 THEN 30 ELSE x + 1 END) + 1] - 4 * v[y * 32 + x + 1] AS edge
FROM grey_lists, (SELECT i // 32 AS y, i % 32 AS x FROM range(1024) t(i))
""")
part("cosines", """
SELECT k, n, 2e0 * cos(pi() * k * (2 * n + 1) / 64) AS c FROM range(8) a(k), range(32) b(n)
""")
part("frequencies", """
SELECT s.vec_id, s.k, c.k AS l, sum(s.f * c.c) AS f FROM (
  SELECT p.vec_id, p.i % 32 AS x, c.k, sum(p.luma * c.c) AS f
  FROM pixel_rows p JOIN cosines c ON c.n = p.i // 32 GROUP BY ALL) s
JOIN cosines c ON c.n = s.x GROUP BY ALL
""")


# a type in words would need a session when this module is read
@F.pandas_udf(BinaryType())
def _pictures(vectors: pd.Series) -> pd.Series:
    """The pixel bytes of vectors of 64 doubles; null stays null."""
    i, c = np.divmod(np.arange(3 * _SIDE * _SIDE), 3)
    y, x = np.divmod(i, _SIDE)
    place = (y // 4 * 8 + x // 4 + c * 21) % 64
    grain = (x * 7 + y * 13 + c * 5) % 17
    found = vectors.notna()
    made = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
    if found.any():
        levels = np.floor((np.stack(vectors[found].to_list()) + 0.6) * 200.0).astype(np.int64)
        pixels = np.clip(levels[:, place] + grain, 0, 255).astype(np.uint8)
        made[found] = [row.tobytes() for row in pixels]
    return made


def derived_images(spark, sf) -> DataFrame:
    """One 32 x 32 picture per embedding, pixels by formula from its values."""
    def level(k):
        i, c = F.floor(k / 3), k % 3
        y, x = F.floor(i / _SIDE), i % _SIDE
        place = (F.floor(y / 4) * 8 + F.floor(x / 4) + c * 21) % 64
        value = F.element_at("embedding", (place + 1).cast("int")).cast("double")
        base = F.floor((value + 0.6) * 200.0) + (x * 7 + y * 13 + c * 5) % 17
        return F.lpad(F.hex(F.least(F.greatest(base, F.lit(0)), F.lit(255))), 2, "0")

    places = F.sequence(F.lit(0), F.lit(3 * _SIDE * _SIDE - 1))
    slow = F.unhex(F.array_join(F.transform(places, level), ""))
    # whole vectors of usual numbers in one step for a batch, any other by the formula
    v = F.col("embedding")
    usual = (F.size(v) >= 64) & F.forall(F.slice(v, 1, 64), lambda x: F.abs(x) < 1e6)
    usual = F.coalesce(usual, F.lit(False))
    data = F.coalesce(_pictures(F.when(usual, F.slice(v, 1, 64).cast("array<double>"))),
                      F.when(~usual, slow))
    rows = views.table(spark, sf, "embeddings")
    return rows.select(
        "vec_id", F.col("vec_id").cast("string").alias("path"),
        F.lit(_SIDE).alias("height"), F.lit(_SIDE).alias("width"), F.lit(3).alias("channels"),
        data.alias("data"),
    )


def _measured(spark, sf, *columns: str) -> DataFrame:
    found = photo_metrics(derived_images(spark, sf))
    return found.select(
        F.col("path").cast("bigint").alias("vec_id"),
        *[r6(F.col(c)).alias(c) if c not in ("valid", "width", "height", "phash") else F.col(c)
          for c in columns],
    )


part("measured", """
SELECT p.vec_id, true AS valid, 32 AS width, 32 AS height, round(s.sharpness, 6) AS sharpness,
  round(sqrt(avg((r - g) * (r - g)) + avg((0.5e0 * (r + g) - b) * (0.5e0 * (r + g) - b))), 6)
    AS colorfulness,
  round(stddev_pop(grey), 6) AS contrast, round(avg(grey), 6) AS brightness
FROM pixel_rows p JOIN (SELECT vec_id, var_pop(edge) AS sharpness FROM laplacian GROUP BY vec_id) s
  ON s.vec_id = p.vec_id GROUP BY p.vec_id, s.sharpness
""")


@query("K0_photo_metrics", "SELECT * FROM measured")
def all_metrics(spark, sf):
    return _measured(spark, sf, "valid", "width", "height", "sharpness", "colorfulness",
                     "contrast", "brightness")


@query("K1_grey_level", """
SELECT vec_id, round(avg(grey), 6) AS mean_grey FROM pixel_rows GROUP BY vec_id""")
def grey_levels(spark, sf):
    return _measured(spark, sf, "brightness").withColumnRenamed("brightness", "mean_grey")


@query("K2_sharpness", "SELECT vec_id, sharpness FROM measured")
def sharpness(spark, sf):
    return _measured(spark, sf, "sharpness")


@query("K3_colorfulness", "SELECT vec_id, colorfulness FROM measured")
def colorfulness(spark, sf):
    return _measured(spark, sf, "colorfulness")


@query("K4_contrast", "SELECT vec_id, contrast FROM measured")
def contrast(spark, sf):
    return _measured(spark, sf, "contrast")


@query("K5_brightness", "SELECT vec_id, brightness FROM measured")
def brightness(spark, sf):
    return _measured(spark, sf, "brightness")


@query("K6_size", "SELECT vec_id, width, height, 0.001024 AS megapixels FROM measured")
def size(spark, sf):
    area = F.col("width").cast("double") * F.col("height") / 1e6
    return _measured(spark, sf, "width", "height").withColumn("megapixels", r6(area))


@query("K7_perceptual_hash", """
SELECT vec_id, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END
  AS BIGINT) AS phash
FROM (SELECT f.vec_id, sum(CASE WHEN f.f > m.mid
    THEN CAST(pow(2, 63 - (f.k * 8 + f.l)) AS HUGEINT) ELSE 0 END)::HUGEINT AS h
  FROM frequencies f JOIN (SELECT vec_id, median(f) AS mid FROM frequencies GROUP BY vec_id) m
    ON m.vec_id = f.vec_id GROUP BY f.vec_id)""")
def perceptual_hashes(spark, sf):
    return _measured(spark, sf, "phash")


# --- M: classification over embeddings ----------------------------------------

def _with_rooms(spark, sf) -> DataFrame:
    rows = views.embeddings(spark, sf).select("vec_id", "gallery", "path", "embedding")
    return rooms.with_room(rows, "path", "embedding", prompt_vectors(spark, sf, 8))


@query("M1_room_classification", """
SELECT vec_id, room, round(confidence, 6) AS confidence FROM room_predictions""")
def room_classification(spark, sf):
    return _with_rooms(spark, sf).select(
        "vec_id", "room", r6(F.col("room_confidence")).alias("confidence")
    )


@query("M2_amenity_detection", """
SELECT vec_id, gallery, len(detected) AS amenities FROM amenity_hits""")
def amenity_detection(spark, sf):
    return _with_amenities(spark, sf).select(
        "vec_id", "gallery", F.bit_count("amenity_mask").alias("amenities")
    )


@query("M3_vision_switch", """
SELECT listing_id, 50e0 AS without_vision, round(amenity_check, 6) AS with_vision
FROM amenity_checked""")
def vision_switch(spark, sf):
    rows = declared_and_seen(spark, sf)
    off = amenities.with_amenity_check(rows, vision=False).select(
        *rows.columns, F.col("amenity_check").alias("without_vision")
    )
    on = amenities.with_amenity_check(off, vision=True)
    return on.select(
        "listing_id", "without_vision", r6(F.col("amenity_check")).alias("with_vision")
    )
