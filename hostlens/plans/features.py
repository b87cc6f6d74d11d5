"""The scoring job: listings and photos in, one feature row per listing out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hostlens.functions.explanation import to_json_cell
from hostlens.operators import amenities, listing, matching, rooms, scoring, technical
from hostlens.operators.duplicates import duplicate_groups
from hostlens.operators.ordering import position_in_group
from hostlens.session import cut
from hostlens.settings import DEFAULTS, FEATURE_COLUMNS, Settings
from hostlens.sources import sinks
from hostlens.sources.images import existing_files, measured_files
from hostlens.sources.replace import replace_tables
from hostlens.sources.tables import (
    eligible, first_listings, read_listings, read_photos,
)

# per-gallery values of a listing without photos
_NO_GALLERY = {
    "photo_count": "bigint", "valid_count": "bigint", "blurry_count": "bigint",
    "low_resolution_count": "bigint", "duplicate_groups": "bigint",
}
_FLAGS = "array<struct<path:string,reason:string,width:int,height:int>>"
_UNKNOWN = {
    "avg_sharpness": "double", "avg_exposure": "double", "avg_resolution": "double",
    "avg_aesthetic": "double", "room_mask": "int", "detected_mask": "int",
    "bad_photos": _FLAGS,
}
@dataclass(frozen=True)
class Vision:
    """Prompt vectors of the two classifiers; None switches a classifier off.

    `embedding` names the photo column with the image embedding. Rooms then fall
    back to file names, amenities to the neutral score.
    """

    embedding: str | None = None
    room_prompts: list | None = None
    amenity_prompts: list | None = None

    @property
    def sees_rooms(self) -> bool:
        return self.embedding is not None and self.room_prompts is not None

    @property
    def sees_amenities(self) -> bool:
        return self.embedding is not None and self.amenity_prompts is not None


def listing_rows(listings: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """What the scores need from a listing; long texts stay behind."""
    scored = listing.with_completeness(listing.with_text_quality(listings, s), s)
    return scored.select(
        "listing_id", matching.id_digits(F.col("listing_id")).alias("gallery"),
        amenities.declared_keys(F.col("amenities")).alias("declared"),
        "text_quality", "text_reasons", "completeness", "completeness_reasons",
    )


def photo_rows(photos: DataFrame, vision: Vision, s: Settings = DEFAULTS) -> DataFrame:
    """Existing photos with metrics -> per-photo scores, room and amenities."""
    seen = rooms.with_room(
        photos, "path", vision.embedding if vision.sees_rooms else None, vision.room_prompts
    )
    if vision.sees_amenities:
        seen = amenities.with_detected(seen, vision.embedding, vision.amenity_prompts, s)
    else:
        seen = seen.withColumn("amenity_mask", F.lit(0))
    return technical.with_photo_scores(seen, s)


def flat_keys(df: DataFrame, name: str) -> list[Column]:
    """Columns that order rows as the named one does: the fields of a struct, one by one.

    Comparing structs inside structs makes a new comparison for every pair of rows.
    """
    kind = df.schema[name].dataType
    if not isinstance(kind, StructType):
        return [F.col(name)]
    # a missing struct comes before one of missing fields
    return [F.col(name).isNotNull(), *[F.col(name)[f.name] for f in kind.fields]]


def entity_starts(members: DataFrame, photos: DataFrame) -> DataFrame:
    """(gallery, entity_id, entity_first) of the galleries and entities of members.

    An entity that names its gallery needs no look at the members.
    """
    first = matching.entity_order(photos)
    named = first.withColumn("gallery", matching.id_digits(F.col("entity_id")))
    others = members.select("gallery", "entity_id").filter(
        F.col("gallery") != matching.id_digits(F.col("entity_id"))
    ).distinct().join(first, "entity_id")
    return named.filter("gallery <> ''").unionByName(others)


def gallery_flags(members: DataFrame, photos: DataFrame, s: Settings) -> DataFrame:
    """All flagged photos of each gallery as one ordered array.

    The array is one cell of the feature table by contract, whatever its size; the
    flag table has the same rows one by one. Flagged photos are shuffled once, by gallery,
    together with the first photos of the entities, and without what can be made afterwards:
    the list of an entity meets its first photo there, which orders the lists of a gallery.
    """
    flagged = scoring.flagged_rows(members).filter("entity_id is not null")
    # written: few rows are left of the shuffle, which goes
    starts = cut(entity_starts(flagged, photos), "starts").withColumn("_there", F.lit(True))
    minor = [key for c in ("seq", "row_key") for key in flat_keys(flagged, c)]
    order = [f"_{i}" for i in range(len(minor))]
    small = flagged.withColumns(dict(zip(order, minor, strict=True))).drop("seq", "row_key")
    met = small.unionByName(starts, allowMissingColumns=True).repartition("gallery")
    lists = met.groupBy("gallery", "entity_id").agg(
        F.collect_list(F.when(F.col("_there").isNull(), F.struct(
            *order, "path", scoring.photo_flag(s).alias("reason"),
            F.col("width").cast("int").alias("width"),
            F.col("height").cast("int").alias("height"),
        ))).alias("_flags"),
        F.max("entity_first").alias("entity_first"), F.max("_there").alias("_there"),
    ).filter(F.col("_there") & (F.size("_flags") > 0))
    return lists.groupBy("gallery").agg(F.transform(
        F.flatten(F.transform(
            F.sort_array(F.collect_list(F.struct(
                *[key.alias(f"_{i}") for i, key in enumerate(flat_keys(lists, "entity_first"))],
                F.sort_array("_flags").alias("_flags"),
            ))),
            lambda entity: entity["_flags"],
        )),
        lambda flag: F.struct(
            flag["path"].alias("path"), flag["reason"].alias("reason"),
            flag["width"].alias("width"), flag["height"].alias("height"),
        ),
    ).alias("bad_photos"))


def gallery_rows(
    members: DataFrame, photos: DataFrame, s: Settings = DEFAULTS,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Everything the scores need from a gallery, one row each.

    Unwanted galleries are left out here where `wanted` is given. Steps that shuffle much
    for few rows are written, so that their shuffles do not lie beside that of the flags.
    """
    counted = members.groupBy("gallery").agg(
        *technical.technical_aggregates(), rooms.room_aggregate(s),
        amenities.amenity_aggregate(),
    )
    hashes = matching.only_wanted(members.select("gallery", "phash"), wanted)
    stats = cut(technical.with_duplicate_groups(
        matching.only_wanted(counted, wanted), duplicate_groups(hashes, s.hash_threshold)
    ), "stats")
    flags = gallery_flags(members, photos, s)
    return stats.join(flags, "gallery", "left")


def score_rows(
    listings: DataFrame, galleries: DataFrame | None, vision: Vision = Vision(),
    calibrator: tuple[float, float] | None = None, s: Settings = DEFAULTS,
) -> DataFrame:
    """Join finished gallery rows to the listings and compute all components.

    Without galleries every listing counts as having no photos.
    """
    if galleries is None:
        rows = listings.withColumns({
            name: F.lit(None).cast(kind) for name, kind in {**_NO_GALLERY, **_UNKNOWN}.items()
        })
    else:
        keyed = listings.withColumn("gallery", matching.spread_key(
            F.col("gallery"), F.col("listing_id")
        ))
        rows = keyed.join(galleries, "gallery", "left")
    rows = rows.withColumns({
        name: F.coalesce(F.col(name), F.lit(0).cast(kind)) for name, kind in _NO_GALLERY.items()
    })
    rows = rows.withColumns({
        "photo_technical": technical.technical_score(s),
        "technical_reasons": technical.technical_reasons(),
        "photo_aesthetic": technical.aesthetic_score(calibrator),
        "photo_status": F.when(F.col("photo_count") > 0, "ok").otherwise("no_photos"),
        "bad_photos": F.coalesce(
            "bad_photos", F.array().cast(_FLAGS)
        ),
        **rooms.coverage_columns(),
    })
    rows = rows.withColumn(
        "aesthetic_reasons", technical.aesthetic_reasons(F.col("photo_aesthetic"))
    )
    rows = amenities.with_amenity_check(rows, vision.sees_amenities, s)
    return scoring.with_explanation(scoring.with_quality_score(rows, s))


def contract_rows(rows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The 13 columns of the feature table."""
    return rows.withColumns({
        "version": F.lit(s.schema_version),
        "quality_engine_version": F.lit(s.engine_version),
        "config_version": F.lit(s.config_version),
        "explanation_json": to_json_cell(F.col("explanation")),
    }).select(*FEATURE_COLUMNS)


def scored_members(listings: DataFrame, photos: DataFrame, vision: Vision = Vision(),
                   s: Settings = DEFAULTS, records: DataFrame | None = None) -> DataFrame:
    """Members of the listings' galleries with per-photo scores.

    `photos` are the existing photos; `records` all photo records, which decide
    whether a gallery is named by an entity. They are the same by default.
    """
    known = photos if records is None else records
    members = matching.gallery_members(listings, photos, known)
    return photo_rows(members, vision, s)


def build_features(
    listings: DataFrame, photos: DataFrame, vision: Vision = Vision(),
    calibrator: tuple[float, float] | None = None, limit: int | None = None,
    s: Settings = DEFAULTS, records: DataFrame | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """Feature rows of all eligible listings.

    `photos` holds one row per existing photo with `path` and the raw metrics;
    `records` the photo records before the existence check, when they differ;
    `members` the scored gallery members, when they are made already.
    """
    chosen = listings if limit is None else first_listings(listings, limit)
    chosen = eligible(chosen)
    known = photos if records is None else records
    wanted = None
    if members is None:
        members, wanted = matching.open_members(chosen, photos, known)
        members = photo_rows(members, vision, s)
    galleries = gallery_rows(members, known, s, wanted)
    return contract_rows(
        score_rows(listing_rows(chosen, s), galleries, vision, calibrator, s), s
    )


def score_folder(
    spark: SparkSession, data_dir: str, output: str, limit: int | None = None,
    vision: Vision = Vision(), embeddings: DataFrame | None = None,
    calibrator_path: str | None = None, image_folders: list[str] | None = None,
    s: Settings = DEFAULTS,
) -> bool:
    """Score a folder with listings.csv, photos.csv and image files.

    Images are read below `data_dir`; name further folders in `image_folders`
    when photos also lie beside it (a photo is looked up below the data folder,
    then below its parent).

    Only images of photos in the galleries of the scored listings are opened, by name.

    Writes the feature table to `output` and beside it the flag table: one row for
    each flag in an explanation cell, with its listing and its place in the list.
    Returns False, writing nothing, when no listing is eligible. Embeddings come
    as a table (`path`, vector column named by `vision.embedding`).
    """
    listings = read_listings(spark, f"{data_dir}/listings.csv")
    records = read_photos(spark, f"{data_dir}/photos.csv")
    chosen = eligible(listings if limit is None else first_listings(listings, limit))
    if chosen.isEmpty():
        return False
    calibrator = load_line(spark, calibrator_path)
    folders = [data_dir] if image_folders is None else image_folders
    pruned = records.drop("width", "height", "bytes", "is_cover")
    there = matching.existing_photos(pruned, existing_files(spark, folders), data_dir)
    # the galleries are matched on paths first, so that only their images are decoded
    placed = cut(matching.gallery_members(chosen, there, records), "placed")
    # each once; all later branches read the written metrics
    metrics = measured_files(placed.select("path"))
    photos = placed.join(metrics, "path")
    if embeddings is not None:
        photos = photos.join(embeddings, "path", "left")
    photos = cut(photos, "photos")
    members = photo_rows(photos, vision, s)
    features = build_features(
        listings, photos, vision, calibrator, limit, s, records=records, members=members
    )
    # both are written whole before either takes the place of an earlier one
    replace_tables({
        output: features,
        f"{output.rstrip('/')}_photo_flags": listing_flags(chosen, members, records, s),
    })
    return True


def listing_flags(listings: DataFrame, members: DataFrame, records: DataFrame,
                  s: Settings = DEFAULTS) -> DataFrame:
    """(listing_id, position, path, reason, width, height): the flags of every listing.

    The position is the place in the listing's explanation, from 0.
    """
    ordered = matching.with_entity_order(scoring.flagged_photos(members, s), records)
    placed = position_in_group(
        ordered, "gallery", [F.col("entity_first"), F.col("seq"), F.col("row_key"), F.col("path")],
        kept=["gallery", "path", "reason", "width", "height"])
    keyed = listings.select("listing_id", matching.id_digits(F.col("listing_id")).alias("gallery"))
    return keyed.filter("gallery <> ''").join(placed, "gallery").select(
        "listing_id", (F.col("position") - 1).alias("position"), "path", "reason",
        F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))


def load_line(spark: SparkSession, path: str | None) -> tuple[float, float] | None:
    return None if path is None else sinks.load_calibrator(spark, path)
