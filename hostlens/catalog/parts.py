"""Named SELECTs the SQL counterparts are built from."""

from __future__ import annotations

from hostlens.catalog import views
from hostlens.catalog.registry import part
from hostlens.catalog.sqltext import (
    aesthetic, amenity_case, arabic, clamp, digits, english, exposure, french, half_even,
    issue_reason, normal, positive_reason, present, resolution, room_case, room_phrase, strip,
    text_issue, words,
)
from hostlens.settings import EXPECTED_ROOMS

part("v_listings", views.V_LISTINGS)
part("v_photos", views.V_PHOTOS)
part("v_embeddings", views.V_EMBEDDINGS)
part("v_raw", views.V_RAW)
part("v_raw_photos", views.V_RAW_PHOTOS)
part("v_labels", views.V_LABELS)
part("v_cells", views.V_CELLS)

# amenity cells as lists
part("typed_listings", """
SELECT * REPLACE (CASE WHEN amenities IS NULL OR amenities = '' THEN []::VARCHAR[]
    WHEN starts_with(amenities, '[') THEN CAST(CAST(amenities AS JSON) AS VARCHAR[])
    ELSE list_filter(list_transform(string_split(amenities, '|'), lambda x: trim(x)),
                     lambda x: x <> '') END AS amenities)
FROM v_listings
""")

part("declared_amenities", f"""
SELECT *, list_sort(list_distinct(list_filter(list_transform(
    list_transform(amenities, lambda a: trim(lower(a))),
    lambda w: {amenity_case('w')}), lambda k: k IS NOT NULL))) AS declared
FROM typed_listings
""")

part("text_measured", f"""
SELECT *, {words('name')} + {words('description')} AS word_count,
       length({strip('name')}) AS title_length,
       {arabic('name')} OR {arabic('description')} AS arabic,
       {french('name')} OR {french('description')} AS french,
       {english('name')} OR {english('description')} AS english
FROM declared_amenities
""")

_LANGS = ", ".join(
    f"CASE WHEN {n} THEN '{n.capitalize()} content detected' "
    f"ELSE '{n.capitalize()} description missing' END"
    for n in ("arabic", "french", "english")
)
part("text_scored", f"""
SELECT *,
  CASE WHEN word_count < 50 THEN 30e0 WHEN word_count < 100 THEN 60e0
       WHEN word_count < 300 THEN 85e0 ELSE 95e0 END AS length_score,
  CASE WHEN title_length = 0 THEN 0e0 WHEN title_length < 10 THEN 40e0 ELSE 100e0 END
       AS title_score,
  (arabic::INT + french::INT + english::INT)::DOUBLE / 3e0 * 100e0 AS lang_score,
  0.4e0 * lang_score + 0.4e0 * length_score + 0.2e0 * title_score AS text_quality,
  {present(_LANGS, "CASE WHEN word_count >= 100 THEN 'Good description length' "
           "WHEN word_count >= 50 THEN 'Description length is moderate' "
           "ELSE 'Description is too short' END",
           "CASE WHEN title_length = 0 THEN 'Title is empty' "
           "WHEN title_length < 10 THEN 'Title is very short' END")} AS text_reasons
FROM text_measured
""")

_CHECKS = (
    ("title", f"{strip('name')} <> ''"), ("description", f"{strip('description')} <> ''"),
    ("amenities", "len(amenities) > 0"), ("capacity", "capacity > 0"),
    ("bedrooms", "bedrooms > 0"), ("price", "base_price > 0"), ("city", "city <> ''"),
    ("photos", "photo_count > 0"), ("calendar", "pricing_days_180 >= 30"),
    ("instant_book", "instant_booking"), ("ical", "has_active_ical OR is_calendar_synced"),
)
_FILLED = present(*[f"CASE WHEN {test} THEN '{name}' END" for name, test in _CHECKS])
_MISSING = present(*[f"CASE WHEN NOT ({test}) THEN '{name}' END" for name, test in _CHECKS])
part("listing_scored", f"""
SELECT *, {_FILLED} AS filled_fields, {_MISSING} AS missing_fields,
  len(filled_fields)::DOUBLE / 11e0 * 100e0 AS completeness,
  list_concat(list_transform(filled_fields[1:5], lambda f: f || ' present'),
    list_transform(missing_fields, lambda f: 'Missing or weak: ' || replace(f, '_', ' ')))
    AS completeness_reasons
FROM text_scored
""")

part("photo_scored", f"""
SELECT *, file AS path, {exposure('brightness')} AS exposure_score,
  {resolution('width', 'height')} AS resolution_score,
  valid AND sharpness < 50 AS is_blurry,
  {aesthetic()} AS aesthetic_raw,
  valid AND resolution_score < 40 AS is_low_resolution,
  {room_case('file', 0)} AS room, {room_case('file', 1)} AS room_confidence,
  {digits('entity_id')} AS entity_digits,
  row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS row_key
FROM v_photos
""")

part("eligible_listings", f"""
SELECT *, {digits('listing_id')} AS gallery FROM listing_scored
WHERE vertical IN ('', 'stay')
""")
part("wanted", "SELECT DISTINCT gallery FROM eligible_listings WHERE gallery <> ''")
part("unmatched", """
SELECT gallery FROM wanted
WHERE gallery NOT IN (SELECT entity_digits FROM photo_scored WHERE entity_digits <> '')
""")
part("members", """
SELECT entity_digits AS gallery, p.* FROM photo_scored p
WHERE entity_digits IN (SELECT gallery FROM wanted)
UNION ALL
SELECT u.gallery, p.* FROM unmatched u JOIN photo_scored p ON contains(p.file, u.gallery)
""")
part("entity_order", """
SELECT entity_id, min(row_key) AS entity_first FROM photo_scored GROUP BY entity_id
""")
part("hashes", """
SELECT gallery, phash, count(*) AS copies FROM members WHERE phash IS NOT NULL
GROUP BY gallery, phash
""")
part("near_pairs", """
SELECT a.gallery, a.phash AS u, b.phash AS v FROM hashes a JOIN hashes b
  ON a.gallery = b.gallery AND a.phash <> b.phash AND bit_count(xor(a.phash, b.phash)) <= 5
""")
part("reach", """(gallery, node, root) AS
SELECT gallery, phash, phash FROM hashes
UNION
SELECT r.gallery, n.v, r.root FROM reach r JOIN near_pairs n
  ON n.gallery = r.gallery AND n.u = r.node
""")
part("clusters", """
SELECT c.gallery, c.root, sum(h.copies) AS photos FROM
  (SELECT gallery, node, min(root) AS root FROM reach GROUP BY gallery, node) c
  JOIN hashes h ON h.gallery = c.gallery AND h.phash = c.node
GROUP BY c.gallery, c.root
""")
part("duplicate_counts", """
SELECT gallery, count(*) AS duplicate_groups FROM clusters WHERE photos > 1 GROUP BY gallery
""")
_ROOM_BITS = " ".join(f"WHEN '{room}' THEN {1 << i}" for i, room in enumerate(EXPECTED_ROOMS))
part("gallery_stats", f"""
SELECT gallery, count(*) AS n_photos, count(*) FILTER (valid) AS valid_count,
  count(*) FILTER (is_blurry) AS blurry_count,
  count(*) FILTER (is_low_resolution) AS low_resolution_count,
  avg(sharpness) FILTER (valid) AS avg_sharpness,
  avg(exposure_score) FILTER (valid) AS avg_exposure,
  avg(resolution_score) FILTER (valid) AS avg_resolution,
  avg(aesthetic_raw) AS avg_aesthetic,
  bit_or(CASE WHEN room_confidence >= 0.25 THEN CASE room {_ROOM_BITS} ELSE 0 END ELSE 0 END)
    AS room_mask
FROM members GROUP BY gallery
""")
part("flags", f"""
SELECT m.gallery, m.path, m.width, m.height, o.entity_first, m.seq, m.row_key,
  CASE WHEN is_blurry THEN 'Blurry photo; ' ELSE 'Below configured resolution target; ' END
    || {room_phrase('room', 'room_confidence')} AS reason
FROM members m JOIN entity_order o ON o.entity_id = m.entity_id
WHERE is_blurry OR is_low_resolution
""")
part("gallery_flags", """
SELECT gallery, list({'path': path, 'reason': reason, 'width': width, 'height': height}
  ORDER BY entity_first, seq, row_key, path, reason) AS bad_photos FROM flags GROUP BY gallery
""")
part("galleries", """
SELECT s.*, CASE WHEN valid_count > 0 THEN coalesce(d.duplicate_groups, 0) ELSE 0 END
  AS duplicate_groups, f.bad_photos
FROM gallery_stats s LEFT JOIN duplicate_counts d USING (gallery)
LEFT JOIN gallery_flags f USING (gallery)
""")
part("no_galleries", """
SELECT NULL::VARCHAR AS gallery, 0 AS n_photos, 0 AS valid_count, 0 AS blurry_count,
  0 AS low_resolution_count, 0e0 AS avg_sharpness, 0e0 AS avg_exposure, 0e0 AS avg_resolution,
  0e0 AS avg_aesthetic, 0 AS room_mask, 0 AS duplicate_groups,
  NULL::STRUCT(path VARCHAR, reason VARCHAR, width INT, height INT)[] AS bad_photos
FROM region WHERE false
""")


def _room_list(mask: str, present_: bool) -> str:
    sign = "<>" if present_ else "="
    return present(*[
        f"CASE WHEN {mask} & {1 << i} {sign} 0 THEN '{room}' END"
        for i, room in enumerate(EXPECTED_ROOMS)
    ])


def technical_sql() -> str:
    return (
        "CASE WHEN valid_count > 0 THEN "
        + clamp(f"0.35e0 * {normal('avg_sharpness', '50e0', '100e0')} + 0.25e0 * avg_exposure "
                "+ 0.25e0 * avg_resolution - least(duplicate_groups * 8, 25)::DOUBLE")
        + " ELSE 0e0 END"
    )


def technical_reasons_sql(count: str) -> str:
    found = present(
        "CASE WHEN blurry_count > 0 THEN blurry_count::VARCHAR || ' blurry photo(s)' END",
        "CASE WHEN duplicate_groups > 0 THEN duplicate_groups::VARCHAR "
        "|| ' near-duplicate photo group(s)' END",
        "CASE WHEN low_resolution_count > 0 THEN low_resolution_count::VARCHAR "
        "|| ' low-resolution photo(s)' END",
    )
    return (
        f"CASE WHEN {count} = 0 THEN ['No photos available'] "
        f"WHEN valid_count = 0 THEN ['No valid photos could be processed'] "
        f"WHEN len({found}) = 0 THEN ['Good technical photo quality'] ELSE {found} END"
    )


_NEUTRAL = "Visual amenity detection unavailable; neutral score used"
_REQUIRED = "('bedroom', 'bathroom', 'kitchen', 'living', 'exterior')"


def _scored(name: str, galleries: str) -> None:
    part(f"{name}_joined", f"""
SELECT l.listing_id, l.text_quality, l.text_reasons, l.completeness, l.completeness_reasons,
  l.declared, coalesce(g.n_photos, 0) AS n_photos, coalesce(g.valid_count, 0) AS valid_count,
  coalesce(g.blurry_count, 0) AS blurry_count,
  coalesce(g.low_resolution_count, 0) AS low_resolution_count,
  coalesce(g.duplicate_groups, 0) AS duplicate_groups, g.avg_sharpness, g.avg_exposure,
  g.avg_resolution, g.avg_aesthetic, coalesce(g.room_mask, 0) AS room_mask,
  coalesce(g.bad_photos, []) AS bad_photos
FROM eligible_listings l LEFT JOIN {galleries} g ON g.gallery = l.gallery
""")
    part(f"{name}_components", f"""
SELECT *, {technical_sql()} AS photo_technical,
  {technical_reasons_sql('n_photos')} AS technical_reasons,
  CASE WHEN n_photos > 0 THEN avg_aesthetic ELSE 0e0 END AS photo_aesthetic,
  [CASE WHEN n_photos = 0 THEN 'No photos for aesthetic scoring'
        WHEN photo_aesthetic >= 65 THEN 'Good composition and lighting'
        ELSE 'Photo aesthetics could be improved' END] AS aesthetic_reasons,
  {_room_list('room_mask', False)} AS missing_rooms,
  list_filter(missing_rooms, lambda r: r IN {_REQUIRED}) AS missing_required,
  (5 - len(missing_required))::DOUBLE / 5e0 * 100e0 AS room_coverage,
  CASE WHEN n_photos = 0 THEN ['No photos for room coverage']
       WHEN len(missing_required) = 0 THEN ['Good room coverage']
       ELSE list_transform(missing_required, lambda r: 'No ' || r || ' photo detected') END
    AS room_reasons,
  50e0 AS amenity_check, ['{_NEUTRAL}'] AS amenity_reasons,
  CASE WHEN n_photos > 0 THEN 'ok' ELSE 'no_photos' END AS photo_status
FROM {name}_joined
""")
    part(f"{name}_explained", f"""
SELECT *,
  {clamp('(photo_technical * 20e0 + photo_aesthetic * 15e0 + room_coverage * 10e0 '
         '+ amenity_check * 10e0 + text_quality * 15e0 + completeness * 30e0) / 100e0')}
    AS total,
  list_concat(list_concat(technical_reasons, aesthetic_reasons),
              list_concat(room_reasons, amenity_reasons)) AS photo_reasons,
  list_concat(list_filter(photo_reasons, lambda r: {positive_reason('r')}),
              list_filter(text_reasons, lambda r: NOT {text_issue('r')})) AS positive,
  list_concat(list_concat(list_filter(photo_reasons, lambda r: {issue_reason('r')}),
              list_filter(text_reasons, lambda r: {text_issue('r')})),
              list_filter(completeness_reasons, lambda r: starts_with(r, 'Missing'))) AS issues,
  list_concat(list_concat(
    CASE WHEN blurry_count > 0 THEN ['Replace ' || blurry_count::VARCHAR || ' blurry photo(s)']
         ELSE [] END,
    list_transform(missing_rooms, lambda r: 'Add a clear ' || r || ' photo')),
    CASE WHEN len(list_filter(issues, lambda i: contains(lower(i), 'arabic'))) > 0
         THEN ['Add an Arabic description'] ELSE [] END) AS suggestions
FROM {name}_components
""")
    part(name, f"""
SELECT listing_id, {half_even('total', 2)} AS quality_score, photo_technical, photo_aesthetic,
  room_coverage, amenity_check, text_quality, completeness, photo_status,
  'quality-v1' AS version, '1.0.0' AS quality_engine_version,
  'quality-config-v1' AS config_version,
  CAST(to_json({{'positive': positive[1:10], 'issues': issues[1:10],
    'suggestions': suggestions[1:8], 'bad_photos': bad_photos}}) AS VARCHAR)
    AS explanation_json
FROM {name}_explained
""")


_scored("features", "galleries")
_scored("slice_features", "no_galleries")
