"""Matching photos to listings by the digits of their ids.

A listing and a photo entity belong together when their ids end in the same
digits. Every listing with the same digits sees the same photos, so photos are
organised in *galleries* keyed by those digits: all photo work is aggregated per
gallery first, and listings join the finished gallery rows many-to-one. The
listings x photos product is never built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.operators.sizing import broadcast_if_small, lookup_side
from hostlens.session import cut, shuffles_removed


def id_digits(c: Column) -> Column:
    """The digits an id ends in; empty when there are none."""
    return F.regexp_extract(c, r"(\p{Nd}+)$", 1)


def spread_key(gallery: Column, listing_id: Column) -> Column:
    """Join key of a listing: its gallery, or a key of its own without digits.

    Listings without digits match nothing; giving each its own key keeps them
    from meeting in one shuffle partition.
    """
    return F.when(gallery == "", F.concat(F.lit("none:"), listing_id)).otherwise(gallery)


def wanted_galleries(listings: DataFrame) -> DataFrame:
    return (
        listings.select(id_digits(F.col("listing_id")).alias("gallery"))
        .filter(F.col("gallery") != "")
        .distinct()
    )


def direct_members(photos: DataFrame) -> DataFrame:
    """Photos with the gallery their entity id names; one row per photo."""
    return photos.withColumn("gallery", id_digits(F.col("entity_id"))).filter(
        F.col("gallery") != ""
    )


def unmatched_galleries(wanted: DataFrame, photos: DataFrame) -> DataFrame:
    """Wanted galleries that no entity id names.

    Each different entity id is taken apart once. An id without digits names the empty
    gallery, which is never wanted: a filter on it would move below the distinct ids.
    """
    ids = photos.select("entity_id").distinct()
    named = ids.select(F.coalesce(id_digits(F.col("entity_id")), F.lit("")).alias("gallery"))
    return wanted.join(named.distinct(), "gallery", "left_anti")


def digit_pieces(path: Column, lengths: list[int]) -> Column:
    """Distinct digit substrings of a path that have one of the given lengths."""
    # looking ahead from every place finds pieces that overlap, in one pass for a length
    return F.array_distinct(F.concat(*[
        F.regexp_extract_all(path, F.lit(rf"(?=(\p{{Nd}}{{{n}}}))"), F.lit(1)) for n in lengths
    ]))


def fallback_members(unmatched: DataFrame, photos: DataFrame) -> DataFrame | None:
    """Photos whose path contains the digits of an unmatched gallery.

    The digits lie inside one run of digits of the path, so "contains" becomes
    an equality join on the exploded digit substrings; only lengths that occur
    among the unmatched galleries are cut out. Returns None when every wanted
    gallery is matched already.
    """
    unmatched = cut(unmatched)
    # one row per distinct length of an id's digits: at most the longest id
    with shuffles_removed(unmatched.sparkSession):
        lengths = [
            row["n"] for row in unmatched.groupBy(F.length("gallery").alias("n")).count().collect()
        ]
    if not lengths:
        return None
    pieces = digit_pieces(F.col("file"), sorted(lengths))
    exploded = photos.withColumn("gallery", F.explode(pieces))
    return exploded.join(broadcast_if_small(unmatched), "gallery", "left_semi")


def only_wanted(rows: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """Rows whose gallery is wanted; None stands for galleries that are left out already."""
    return rows if wanted is None else rows.join(lookup_side(wanted), "gallery", "left_semi")


def open_members(
    listings: DataFrame, photos: DataFrame, records: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Photo rows with their gallery: named by the entity, else found in the path.

    `records` are all photo records; an entity without any existing photo still
    counts as a match, so it is they that decide who falls back to the paths.
    Photos of galleries that no listing wants are left out before any work on them, as far
    as the wanted ones are few enough to travel. Else leaving them out would shuffle all
    photos whole, and they stay: the second frame then holds the wanted galleries, for
    `only_wanted` on rows that are shuffled by gallery anyway. It is None otherwise.
    """
    wanted = cut(wanted_galleries(listings), "wanted")
    sure = broadcast_if_small(wanted)
    named = direct_members(photos)
    if sure is not wanted:
        named = named.join(sure, "gallery", "left_semi")
    known = photos if records is None else records
    found = fallback_members(unmatched_galleries(wanted, known), photos)
    # written once: several aggregates read it, and finding it scans every path
    members = named if found is None else named.unionByName(cut(found, "fallback"))
    return members, wanted if sure is wanted else None


def gallery_members(
    listings: DataFrame, photos: DataFrame, records: DataFrame | None = None,
) -> DataFrame:
    """Photo rows of the wanted galleries alone, as `open_members` finds them."""
    return only_wanted(*open_members(listings, photos, records))


def entity_order(photos: DataFrame) -> DataFrame:
    """The row key of the first photo of every entity."""
    return photos.groupBy("entity_id").agg(F.min("row_key").alias("entity_first"))


def with_entity_order(members: DataFrame, photos: DataFrame) -> DataFrame:
    """Add the row key of the entity's first photo, the major gallery order."""
    return members.join(entity_order(photos), "entity_id")


def file_keys(files: DataFrame, data_root: str) -> DataFrame:
    """The photo `file` values an existing file answers to, best candidate first.

    A photo is looked up below the data folder, then below its parent, so a file
    is known under its path relative to each. Building the keys on the file side
    keeps the photo side to one join.
    """
    root = data_root.rstrip("/")
    parent = root.rsplit("/", 1)[0] if "/" in root else ""

    def below(folder: str) -> Column:
        prefix = f"{folder}/" if folder else ""
        return F.when(
            F.col("path").startswith(prefix), F.col("path").substr(
                F.lit(len(prefix) + 1), F.length("path"))
        )

    candidates = F.array(
        F.struct(below(root).alias("file"), F.lit(0).alias("choice")),
        F.struct(F.when(F.col("path").startswith("/"), F.col("path")).alias("file"),
                 F.lit(0).alias("choice")),
        F.struct(below(parent).alias("file"), F.lit(1).alias("choice")),
    )
    keyed = files.select("*", F.inline(candidates)).filter(F.col("file").isNotNull())
    others = [c for c in keyed.columns if c not in ("file", "choice")]
    best = keyed.groupBy("file").agg(
        F.min_by(F.struct(*others), F.col("choice")).alias("hit")
    )
    return best.select("file", "hit.*")


def existing_photos(photos: DataFrame, files: DataFrame, data_root: str) -> DataFrame:
    """Photos whose file exists, with the columns of the file table."""
    plain = F.regexp_replace("file", r"(?<=^|/)(?:\./|/)+", "")
    key = F.when(F.col("file").startswith("/"), F.col("file")).otherwise(plain)
    return (
        photos.withColumn("file_key", key)
        .join(file_keys(files, data_root).withColumnRenamed("file", "file_key"), "file_key")
        .drop("file_key")
    )
