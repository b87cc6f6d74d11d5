"""Scores, explanations, matching and the whole job."""

import json
import random

import pytest
from pyspark.sql import functions as F

from hostlens.catalog.inputs import _png
from hostlens.functions import display
from hostlens.functions.numeric import percent_text, round_half_even
from hostlens.operators import amenities, matching, rooms, scoring
from hostlens.operators.listing import with_completeness
from hostlens.plans.features import (
    Vision, build_features, listing_flags, score_folder, scored_members)
from hostlens.sources.tables import eligible
from hostlens.settings import COMPONENTS, FEATURE_COLUMNS, WEIGHTS, Settings, check_weights

PHOTO = ("entity_id string, file string, seq bigint, width int, height int, sharpness double, "
         "colorfulness double, contrast double, brightness double, valid boolean, phash bigint, "
         "path string, row_key bigint")
LISTING = ("row_key bigint, listing_id string, vertical string, name string, "
           "description string, city string, capacity bigint, bedrooms bigint, "
           "base_price double, instant_booking boolean, is_calendar_synced boolean, "
           "has_active_ical boolean, pricing_days_180 bigint, amenities array<string>, "
           "photo_count bigint")


def component_frame(spark, rows):
    schema = ", ".join(f"{c} double" for c in COMPONENTS)
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], schema)


def totals(spark, rows):
    scored = scoring.with_quality_score(component_frame(spark, rows))
    return [r.quality_score for r in scored.collect()]


def test_weights():
    assert check_weights() == 100
    for bad in (
        {**WEIGHTS, "photo_technical": -10, "completeness": 60},
        {**WEIGHTS, "photo_technical": float("nan")},
        {"photo_technical": 100},
        {**WEIGHTS, "completeness": 31},
    ):
        with pytest.raises(ValueError):
            check_weights(bad)
        with pytest.raises(ValueError):
            scoring.with_quality_score(None, Settings(weights=bad))


def test_score_range_and_monotonicity(spark):
    assert totals(spark, [[100] * 6, [0] * 6]) == [100.0, 0.0]
    rng = random.Random(2)
    base = [[rng.uniform(0, 100) for _ in range(6)] for _ in range(40)]
    raised = [[*row[:i % 6], row[i % 6] + 5, *row[i % 6 + 1:]] for i, row in enumerate(base)]
    for low, high in zip(totals(spark, base), totals(spark, raised), strict=True):
        assert 0 <= low <= high <= 100


def test_published_totals(spark):
    # fixed values: published example rows and their totals
    rows = [
        (79.5, 85.9, 80.0, 50.0, 57.3, 90.9), (51.5, 79.4, 60.0, 50.0, 57.3, 72.7),
        (61.5, 84.8, 60.0, 50.0, 57.3, 72.7), (58.3, 87.6, 60.0, 50.0, 57.3, 72.7),
        (64.9, 93.1, 100.0, 50.0, 80.7, 72.7),
    ]
    expected = [77.6, 63.6, 66.4, 66.2, 75.9]
    assert totals(spark, rows) == pytest.approx(expected, abs=0.06)


def test_rounding_is_that_of_python(spark):
    rng = random.Random(1)
    values = [2.675, 0.125, 0.375, 1.005, 77.65, 0.0, 100.0, 99.995, 0.285]
    values += [rng.randrange(20001) / 200 for _ in range(500)]
    values += [rng.uniform(0, 100) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", round_half_even(F.col("v"), 2).alias("two"),
        round_half_even(F.col("v"), 1).alias("one"), round_half_even(F.col("v"), 4).alias("four"),
        percent_text(F.col("v") / 100).alias("percent"),
    )
    for r in df.collect():
        assert (r.two, r.one, r.four) == (round(r.v, 2), round(r.v, 1), round(r.v, 4))
        assert r.percent == f"{r.v / 100:.0%}"


def test_bars_levels_and_sizes(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 49.9, 50.0, 65.0, 80.0, 100.0)], "v double")
    rows = df.select(display.score_bar(F.col("v")), display.score_level(F.col("v"))).collect()
    assert [r[1] for r in rows] == ["LOW", "LOW", "NEEDS WORK", "GOOD", "EXCELLENT", "EXCELLENT"]
    assert [r[0].count("#") for r in rows] == [0, 10, 10, 13, 16, 20]
    size = spark.range(1).select(display.megapixel_text(F.lit(720), F.lit(540))).first()[0]
    assert size == "720 x 540 px (0.39 MP)"


def test_room_phrases(spark):
    df = spark.createDataFrame(
        [("bedroom", 0.2), ("living", 0.46), (None, None), ("other", 0.9)],
        "room string, sure double",
    )
    found = [r[0] for r in df.select(display.room_phrase(F.col("room"), F.col("sure"))).collect()]
    assert found == [
        "room guess: unknown room (top guess bedroom, 20% classifier confidence)",
        "room guess: living room (46% classifier confidence)",
        "room guess unavailable",
        "room guess: unknown room (top guess other, 90% classifier confidence)",
    ]


def test_room_from_file_name(spark):
    names = {
        "x/Master-Bedroom.jpg": "bedroom", "living_room_1.png": "living", "overview.jpg": "view",
        "cover.jpg": "exterior", "dummy.jpg": "other", "bath-room.jpg": "other",
        "pool/none.jpg": "other",
    }
    df = rooms.with_room(spark.createDataFrame([(n,) for n in names], "path string"))
    assert {r.path: r.room for r in df.collect()} == names


def test_room_below_confidence_is_not_covered(spark):
    df = spark.createDataFrame([("bedroom", 0.2)], "room string, room_confidence double")
    row = df.agg(rooms.room_aggregate(), F.count("*").alias("photo_count")).withColumns(
        rooms.coverage_columns()
    ).first()
    assert row.covered_rooms == [] and "bedroom" in row.missing_rooms
    assert row.room_coverage == 0.0


def test_amenity_aliases(spark):
    items = {"Wi-Fi": "wifi", "Pool": "pool", "Terrace": "air_conditioning",
             "Jacuzzi": "air_conditioning", "Parking space": "air_conditioning", "": "pool",
             "WiFi, Pool": "pool", "zzz": None}
    df = spark.createDataFrame([([i],) for i in items], "a array<string>")
    found = [r[0] for r in df.select(amenities.declared_keys(F.col("a"))).collect()]
    assert found == [[k] if k else [] for k in items.values()]
    both = spark.createDataFrame([(["Wi-Fi", "Pool"],)], "a array<string>")
    assert both.select(amenities.declared_keys(F.col("a"))).first()[0] == ["pool", "wifi"]


def explain(spark, **lists):
    names = (*scoring.PHOTO_REASONS, "text_reasons", "completeness_reasons", "missing_rooms",
             "undeclared")
    rows = spark.range(1).select(
        *[F.array(*[F.lit(x) for x in lists.get(n, [])]).cast("array<string>").alias(n)
          for n in names],
        F.lit(lists.get("blurry_count", 0)).alias("blurry_count"),
        F.array().cast("array<struct<path:string,reason:string,width:int,height:int>>")
        .alias("bad_photos"),
    )
    return scoring.with_explanation(rows).first().explanation


def test_reason_lists(spark):
    found = explain(
        spark, technical_reasons=["3 blurry photo(s)"],
        aesthetic_reasons=["Photo aesthetics could be improved"],
        room_reasons=["No photos for room coverage"],
        amenity_reasons=["Wifi declared but not visually confirmed",
                         "Visual amenity detection unavailable; neutral score used",
                         "Tv detected but not declared", "Amenity information available"],
        text_reasons=["Arabic description missing", "Good description length"],
        completeness_reasons=["title present", "Missing or weak: city"],
        undeclared=["parking_spot"], blurry_count=3, missing_rooms=["kitchen"],
    )
    assert found.positive == ["No photos for room coverage", "Good description length"]
    assert found.issues == [
        "3 blurry photo(s)", "Wifi declared but not visually confirmed",
        "Visual amenity detection unavailable; neutral score used",
        "Tv detected but not declared", "Arabic description missing", "Missing or weak: city",
    ]
    assert found.suggestions == [
        "Replace 3 blurry photo(s)", "Add a clear kitchen photo",
        "Consider declaring the visually detected parking spot", "Add an Arabic description",
    ]


def test_lists_are_cut_after_the_arabic_check(spark):
    found = explain(
        spark, technical_reasons=[f"{i} blurry" for i in range(12)],
        text_reasons=["Arabic description missing"], missing_rooms=list("abcdefg"),
    )
    assert len(found.issues) == 10 and "Arabic description missing" not in found.issues
    assert found.suggestions == [
        *[f"Add a clear {c} photo" for c in "abcdefg"], "Add an Arabic description",
    ]


def listing(i, listing_id, **values):
    base = dict(
        row_key=i, listing_id=listing_id, vertical="stay", name="Quiet loft at the river",
        description="Two floors, a stove and a long table.", city="Porto", capacity=3,
        bedrooms=1, base_price=310.0, instant_booking=True, is_calendar_synced=True,
        has_active_ical=False, pricing_days_180=60, amenities=["Wi-Fi", "Kitchen", "Pool"],
        photo_count=0,
    )
    return tuple({**base, **values}.values())


def photo(i, entity, file, seq=0, **values):
    base = dict(
        entity_id=entity, file=file, seq=seq, width=2000, height=1500, sharpness=120.0,
        colorfulness=30.0, contrast=50.0, brightness=120.0, valid=True, phash=i << 40 | i * 977,
        path=file, row_key=i,
    )
    return tuple({**base, **values}.values())


def test_completeness_ignores_amenity_minimum(spark):
    df = spark.createDataFrame([listing(0, "l1", amenities=["a"], capacity=9)], LISTING)
    row = with_completeness(df).first()
    assert "amenities" in row.filled_fields and row.missing_fields == ["photos"]
    assert row.completeness == pytest.approx(1000 / 11)
    assert row.completeness_reasons[:2] == ["title present", "description present"]
    assert row.completeness_reasons[-1] == "Missing or weak: photos"


def test_whole_job_matching_and_order(spark):
    listings = spark.createDataFrame([
        listing(0, "lst_7"), listing(1, "lst_0007"), listing(2, "nodigits"),
        listing(3, "lst_55"), listing(4, "lst_9", vertical="car"), listing(5, "lst_404"),
    ], LISTING)
    blurry = dict(sharpness=10.0)
    photos = spark.createDataFrame([
        photo(0, "b_7", "p/b/kitchen.jpg", 2, **blurry), photo(1, "a_7", "p/a/x.jpg", 9, **blurry),
        photo(2, "b_7", "p/b/cover.jpg", 1, **blurry), photo(3, "a_7", "p/a/y.jpg", 9, **blurry),
        photo(4, "none", "p/x_1552.jpg", 0, valid=False), photo(5, "none", "p/55/z.jpg"),
        photo(6, "c_0007", "p/c/bedroom.jpg"),
    ], PHOTO)
    rows = {r.listing_id: r for r in build_features(listings, photos).collect()}
    assert list(next(iter(rows.values())).asDict()) == list(FEATURE_COLUMNS)
    assert set(rows) == {"lst_7", "lst_0007", "nodigits", "lst_55", "lst_404"}
    flagged = json.loads(rows["lst_7"].explanation_json)["bad_photos"]
    assert [f["path"] for f in flagged] == [
        "p/b/cover.jpg", "p/b/kitchen.jpg", "p/a/x.jpg", "p/a/y.jpg",
    ]
    assert flagged[1]["reason"] == (
        "Blurry photo; room guess: kitchen (50% classifier confidence)"
    )
    assert rows["lst_0007"].photo_status == "ok"
    assert rows["nodigits"].photo_status == rows["lst_404"].photo_status == "no_photos"
    assert rows["lst_55"].photo_status == "ok"
    # the invalid photo counts as zero for aesthetics only
    assert rows["lst_55"].photo_technical == pytest.approx(0.35 * 100 + 25 + 25)
    assert rows["lst_55"].photo_aesthetic == pytest.approx(
        100 * (0.35 * 0.75 + 0.35 * 50 / 60 + 0.3 * 0.8) / 2
    )
    assert rows["nodigits"].room_coverage == 0 and rows["nodigits"].amenity_check == 50
    # only the first n listings, before the vertical filter
    first = build_features(listings, photos, limit=5).collect()
    assert {r.listing_id for r in first} == {"lst_7", "lst_0007", "nodigits", "lst_55"}
    # the order of input rows does not matter
    mixed = build_features(
        listings.orderBy(F.rand(3)), photos.orderBy(F.rand(4)).repartition(5)
    ).collect()
    assert {r.listing_id: r for r in mixed} == rows
    # the flag table holds the lists of the scored listings, in their order
    members = scored_members(eligible(listings), photos)
    table = listing_flags(eligible(listings), members, photos).collect()
    assert {r.listing_id for r in table} <= set(rows)
    for name, row in rows.items():
        own = sorted((r for r in table if r.listing_id == name), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        assert [r.path for r in own] == [
            f["path"] for f in json.loads(row.explanation_json)["bad_photos"]]


def test_hot_gallery_and_hot_listing_key(spark):
    # a third of the photos in one gallery, a third of the listings without digits
    listings = spark.createDataFrame(
        [listing(i, "same" if i % 3 == 0 else f"l_{i % 50}") for i in range(90)], LISTING
    ).withColumn("listing_id", F.concat("listing_id", F.lit("")))
    photos = spark.createDataFrame(
        [photo(i, "e_1" if i % 3 == 0 else f"e_{i % 50}", f"p/{i}x.jpg", i % 5,
               phash=(i % 40) << 20) for i in range(900)], PHOTO
    )
    rows = build_features(listings, photos).collect()
    assert len(rows) == 90
    counts = photos.groupBy(matching.id_digits(F.col("entity_id"))).count().collect()
    assert sum(r["count"] for r in counts) == 900


def test_fallback_equals_contains(spark):
    rng = random.Random(4)
    files = [f"p{rng.randrange(10**rng.randint(1, 7))}/x_{rng.randrange(3000)}.jpg"
             for _ in range(300)]
    photos = spark.createDataFrame([("e", f) for f in files], "entity_id string, file string")
    targets = sorted({str(rng.randrange(2000)) for _ in range(60)} | {"٣", "007"})
    listings = spark.createDataFrame([(f"l_{t}",) for t in targets], "listing_id string")
    unmatched = matching.unmatched_galleries(matching.wanted_galleries(listings), photos)
    found = {(r.gallery, r.file) for r in matching.fallback_members(unmatched, photos).collect()}
    assert found == {(t, f) for t in targets for f in files if t in f}


def test_vision_off_and_on(spark):
    listings = spark.createDataFrame([listing(0, "l_1")], LISTING)
    photos = spark.createDataFrame([photo(0, "e_1", "p/img.jpg")], PHOTO).withColumn(
        "v", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).cast("array<float>")
    )
    eye = [[1.0, 0.0, 0.0]] + [[0.0, 1.0, 0.0]] * 7
    ten = [[0.0, 1.0, 0.0]] * 4 + [[1.0, 0.0, 0.0]] + [[0.0, 0.0, 1.0]] * 5
    off = build_features(listings, photos).first()
    on = build_features(listings, photos, Vision("v", eye, ten)).first()
    assert (off.room_coverage, off.amenity_check) == (0.0, 50.0)
    assert on.room_coverage == 20.0
    # balcony seen, not declared; three declared keys unconfirmed
    assert on.amenity_check == 0.0
    assert "Consider declaring the visually detected balcony" in json.loads(
        on.explanation_json)["suggestions"]


def test_folder_to_feature_table(spark, tmp_path):
    data = tmp_path / "data"
    (data / "photos" / "adv_0001").mkdir(parents=True)
    (data / "photos" / "adv_0001" / "bedroom.png").write_bytes(
        _png(40, 30, bytes(range(256)) * 14 + bytes(16))
    )
    (data / "photos" / "adv_0001" / "broken.jpg").write_bytes(b"no image")
    (data / "listings.csv").write_text(
        "listing_id,vertical,name,description,city,amenities,capacity\n"
        'lst_0001,stay,Cozy apartment,"Nice, kitchen\nand pool",Agadir,"[""Wi-Fi""]",4\n'
        "lst_0002,car,Car,none,Agadir,,1\n"
    )
    (data / "photos.csv").write_text(
        "entity_id,file,seq\nadv_0001,photos/adv_0001/bedroom.png,2\n"
        "adv_0001,photos/adv_0001/broken.jpg,1\nadv_0001,photos/adv_0001/absent.jpg,3\n"
    )
    out = str(tmp_path / "out" / "features.parquet")
    assert score_folder(spark, str(data), out)
    [row] = spark.read.parquet(out).collect()
    assert (row.listing_id, row.photo_status) == ("lst_0001", "ok")
    assert row.room_coverage == 20.0
    flags = json.loads(row.explanation_json)["bad_photos"]
    assert [(f["width"], f["height"]) for f in flags] == [(40, 30)]
    assert spark.read.parquet(out + "_photo_flags").count() == 1
    (data / "listings.csv").write_text("listing_id,vertical\nx,car\n")
    other = str(tmp_path / "none.parquet")
    assert not score_folder(spark, str(data), other)
    assert not (tmp_path / "none.parquet").exists()
