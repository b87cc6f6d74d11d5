"""Loaders and cell cleaning."""

import pytest
from pyspark.sql import functions as F

from hostlens.functions import clean
from hostlens.functions import text as tx
from hostlens.operators.listing import with_text_quality
from hostlens.sources.tables import (
    clean_listings, eligible, first_listings, read_labels, read_listings, read_photos,
    read_ratings,
)


def one(spark, values, convert, kind="string"):
    rows = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in rows.select(convert(F.col("v"))).collect()]


def test_numbers(spark):
    cells = ["", None, " ", "4", "4.9", "-2.7", "1e1", " 7 "]
    assert one(spark, cells, clean.as_int) == [0, 0, 0, 4, 4, -2, 10, 7]
    assert one(spark, cells, clean.as_float) == [0, 0, 0, 4, 4.9, -2.7, 10, 7]


@pytest.mark.parametrize("junk", ["abc", "4,5"])
def test_junk_number_is_an_error(spark, junk):
    with pytest.raises(Exception, match="not a number"):
        one(spark, [junk], clean.as_int)
    assert one(spark, [junk], lambda c: clean.as_int(c, strict=False)) == [None]


def test_booleans(spark):
    yes, no = ["true", " YES ", "1", "y", "On"], ["false", "0", "no", "N", "off", "", None]
    assert all(one(spark, yes, clean.as_bool))
    assert not any(one(spark, no, clean.as_bool))
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, ["t"], clean.as_bool)


def test_missing_words(spark):
    cells = ["NA", "null", "None", "N/A", "nan", "x", "na"]
    assert one(spark, cells, clean.missing_to_null) == [None] * 5 + ["x", "na"]


def test_amenity_lists(spark):
    cells = {
        '["Wi-Fi", "Kitchen"]': ["Wi-Fi", "Kitchen"],
        "['Pool', \"TV\", True, None]": ["Pool", "TV", "True", "None"],
        r"['it\'s', 'b']": ["it's", "b"],
        '["a", true, null, 3, "true"]': ["a", "True", "None", "3", "true"],
        '["télévision", "x]y"]': ["télévision", "x]y"],
        "A | B |  | C": ["A", "B", "C"],
        "WiFi, Pool": ["WiFi, Pool"],
        "[broken": ["[broken"],
        "[]": [],
        "": [],
    }
    found = one(spark, list(cells), clean.parse_list)
    assert found == list(cells.values())
    assert one(spark, [None], clean.parse_list) == [[]]


def test_blanks_get_defaults(spark, tmp_path):
    path = tmp_path / "listings.csv"
    path.write_text(
        "listing_id,vertical,capacity,bedrooms,bathrooms,base_price,instant_booking,"
        "is_calendar_synced\nlst_0002,,,,,,False,\n,stay,,,,,,\n0001,stay,,,,,,\n"
    )
    rows = {r.listing_id: r for r in read_listings(spark, str(path)).collect()}
    assert set(rows) == {"lst_0002", "0001"}
    row = rows["lst_0002"]
    assert (row.vertical, row.capacity, row.bedrooms) == ("", 0, 0)
    assert (row.bathrooms, row.base_price) == (0.0, 0.0)
    assert row.instant_booking is False and row.is_calendar_synced is False
    assert row.amenities == [] and row.name == ""


def test_photo_defaults_and_line_breaks(spark, tmp_path):
    photos = tmp_path / "photos.csv"
    photos.write_text(
        "entity_id,file,seq,is_cover,width,height,bytes\n"
        "adv_0002,photos/adv_0002/cover.jpg,,False,,,\n,x.jpg,1,,,,\nadv_1,,1,,,,\n"
    )
    [photo] = read_photos(spark, str(photos)).collect()
    assert (photo.seq, photo.width, photo.height, photo.bytes) == (0, 0, 0, 0)
    assert photo.is_cover is False
    listings = tmp_path / "l.csv"
    listings.write_text('listing_id,description\na1,"two\nlines ""quoted"""\n')
    [row] = read_listings(spark, str(listings)).collect()
    assert row.description == 'two\nlines "quoted"'


def test_first_listings_then_vertical(spark, tmp_path):
    path = tmp_path / "l.csv"
    body = "".join(f"l{i},{v}\n" for i, v in enumerate(["car", "", "stay", "Stay", " ", "stay"]))
    path.write_text("listing_id,vertical\n" + body)
    listings = read_listings(spark, str(path))
    assert [r.listing_id for r in eligible(first_listings(listings, 3)).collect()] == ["l1", "l2"]
    assert eligible(listings).count() == 3
    with pytest.raises(ValueError):
        first_listings(listings, -1)


def test_label_and_rating_columns(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("file,label\na,b\n")
    with pytest.raises(ValueError, match="photo_file"):
        read_labels(spark, str(bad))
    with pytest.raises(ValueError, match="photo_file"):
        read_ratings(spark, str(bad))
    one_rater = tmp_path / "one.csv"
    one_rater.write_text("photo_file,rater1\na,3\n")
    with pytest.raises(ValueError, match="rater2"):
        read_ratings(spark, str(one_rater))


TEXTS = [
    ("Bel appartement avec deux chambres مرحبا", (True, True, False)),
    ("modèle lesà une", (False, True, False)),
    ("lesson theory", (False, False, False)),
    ("THE Kitchen", (False, False, True)),
    ("leſ", (False, True, False)),
    ("été_le le_x", (False, False, False)),
    ("", (False, False, False)),
]


def test_language_markers_and_words(spark):
    rows = spark.createDataFrame([(t,) for t, _ in TEXTS], "t string").select(
        tx.has_arabic(F.col("t")), tx.has_french(F.col("t")), tx.has_english(F.col("t")),
        tx.word_count(F.col("t")), "t",
    ).collect()
    for row, (text, marks) in zip(rows, TEXTS, strict=True):
        assert tuple(row[:3]) == marks, text
        assert row[3] == len(text.split())


def test_word_count_is_unicode_split(spark):
    blanks = [c for c in map(chr, range(0x3001)) if c.isspace()]
    texts = [f"{b}a{b}{b}b{b}" for b in blanks] + ["a b\tc\nd", " ", "日本 語", "a​b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in rows.select(tx.word_count(F.col("t"))).collect()]
    assert found == [len(t.split()) for t in texts]
    trimmed = [r[0] for r in rows.select(clean.strip(F.col("t"))).collect()]
    assert trimmed == [t.strip() for t in texts]


def test_text_scores(spark):
    cases = [("", ""), ("x" * 9, "w " * 49), ("x" * 10, "the " * 299), ("Title here", "le " * 300)]
    rows = spark.createDataFrame(
        [(str(i), n, d) for i, (n, d) in enumerate(cases)],
        "listing_id string, name string, description string",
    )
    found = {r.listing_id: r for r in with_text_quality(rows).collect()}
    assert found["0"].text_quality == pytest.approx(0.4 * 30)
    assert "Title is empty" in found["0"].text_reasons
    assert found["1"].text_quality == pytest.approx(0.4 * 60 + 0.2 * 40)
    assert "Title is very short" in found["1"].text_reasons
    assert found["2"].text_quality == pytest.approx(0.4 * 100 / 3 + 0.4 * 95 + 20)
    assert found["3"].text_quality == pytest.approx(0.4 * 100 / 3 + 0.4 * 95 + 20)
    assert found["2"].text_reasons == [
        "Arabic description missing", "French description missing",
        "English content detected", "Good description length",
    ]


def test_published_text_and_completeness_values():
    assert 0.4 * 100 / 3 + 0.4 * 60 + 0.2 * 100 == pytest.approx(57.3, abs=0.05)
    assert 0.4 * 200 / 3 + 0.4 * 85 + 0.2 * 100 == pytest.approx(80.7, abs=0.05)


def test_typed_columns_pass_through(spark):
    rows = spark.createDataFrame(
        [(" a1 ", 3, None, ["x"])],
        "listing_id string, capacity bigint, instant_booking boolean, amenities array<string>",
    )
    [row] = clean_listings(rows).collect()
    assert (row.listing_id, row.capacity, row.instant_booking) == ("a1", 3, False)
    assert row.amenities == ["x"]


def test_numbers_in_other_spellings_are_junk(spark):
    from hostlens.functions.clean import number

    cells = {"1d": None, "1.0f": None, "0x1p3": None, "12": 12.0, " -2.5 ": -2.5, ".5e1": 5.0,
             "3.": 3.0, "": None, "1_0": None, "Infinity": float("inf"), "-inf": float("-inf")}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(number(F.col("c"))).collect()] == list(cells.values())
