"""Listings, photos and other inputs derived from the given tables.

The same SELECT text runs in Spark and in DuckDB. Every view has one row per row
of its base table, so the work of a query grows with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def _padded(number: str) -> str:
    digits = f"CAST({number} AS STRING)"
    return f"lpad({digits}, CAST(greatest(6, length({digits})) AS INT), '0')"


# one listing per document, cells as typed values but the amenities as raw text
V_LISTINGS = f"""
SELECT 'lst_' || {_padded('d.doc_id')} AS listing_id,
       CASE d.doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'car' ELSE 'stay' END AS vertical,
       CASE WHEN d.doc_id % 13 = 0 THEN ''
            ELSE split_part(d.text, chr(10), 1) END AS name,
       d.text AS description, n.n_name AS city, r.r_name AS country,
       d.doc_id % 9 AS capacity, d.doc_id % 5 AS bedrooms,
       CAST(d.doc_id % 4 AS DOUBLE) * 0.5 AS bathrooms,
       CASE WHEN d.doc_id % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE p.p_retailprice END AS base_price,
       'MAD' AS currency,
       d.doc_id % 2 = 0 AS instant_booking, d.doc_id % 3 = 0 AS is_calendar_synced,
       d.doc_id % 7 = 0 AS has_active_ical, d.doc_id % 181 AS pricing_days_180,
       d.doc_id % 31 AS blocked_days_180,
       CASE d.doc_id % 6 WHEN 0 THEN '["Wi-Fi","Kitchen","Pool"]'
            WHEN 1 THEN 'TV | Terrace | Parking space' WHEN 2 THEN '["Jacuzzi"]'
            WHEN 3 THEN '' WHEN 4 THEN 'Climatisation|Balcon|Cuisine|Garage' END AS amenities,
       d.doc_id % 6 AS photo_count, d.source AS property_type, d.lang AS status, d.doc_id
FROM (SELECT doc.*, doc.doc_id % (SELECT count(*) FROM @part) AS part FROM @documents doc) d
LEFT JOIN @nation n ON n.n_nationkey = d.doc_id % 25
LEFT JOIN @region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN @part p ON p.p_partkey = d.part
"""

# one photo per line item, with the raw metrics a decoded image would have;
# every 20th gallery has no entity of its own and is found through the path
V_PHOTOS = f"""
SELECT CASE WHEN l.g % 20 = 0 THEN 'misc'
            WHEN l.l_suppkey % 3 = 0 THEN 'alt_' || {_padded('l.g')}
            ELSE 'adv_' || {_padded('l.g')} END AS entity_id,
       'photos/adv_' || {_padded('l.g')} || '/' ||
       CASE l.l_partkey % 10 WHEN 0 THEN 'bedroom' WHEN 1 THEN 'bath-room'
            WHEN 2 THEN 'kitchen' WHEN 3 THEN 'living_room' WHEN 4 THEN 'exterior'
            WHEN 5 THEN 'pool' WHEN 6 THEN 'overview' WHEN 7 THEN 'cover'
            WHEN 8 THEN 'bathroom' ELSE 'img' END
       || '_' || CAST(l.l_orderkey AS STRING) || '_' || CAST(l.l_linenumber AS STRING)
       || '_' || CAST(l.l_partkey AS STRING) || '.jpg' AS file,
       CAST(l.l_linenumber AS BIGINT) AS seq, l.l_linenumber = 1 AS is_cover,
       CAST(l.l_quantity * 40 AS INT) AS width, CAST(l.l_quantity * 30 AS INT) AS height,
       l.l_extendedprice / 500 AS sharpness, l.l_quantity * 1.3 AS colorfulness,
       l.l_discount * 900 AS contrast, l.l_quantity * 5.1 AS brightness,
       l.l_suppkey % 17 <> 0 AS valid,
       -- equal for equal part classes; the low bits fill up with the line number
       CASE WHEN l.l_suppkey % 17 <> 0 THEN
         ((l.l_partkey % 97 * 2654435761 % 4294967296) * 4194304
          + (l.l_partkey % 97 * 40503 + 12345) * 69069 % 4194304) * 256
         + CAST(pow(2, l.l_linenumber) AS BIGINT) - 1 END AS phash,
       l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_quantity,
       l.l_discount
FROM (SELECT li.*, li.l_orderkey % (SELECT count(*) FROM @documents) AS g FROM @lineitem li) l
"""

# embeddings as photos of small galleries; 64 sign bits make a hash
V_EMBEDDINGS = """
SELECT vec_id, embedding, label, 'photos/adv_' || CAST(g AS STRING) || '/img_'
       || CAST(vec_id AS STRING) || '.jpg' AS path, CAST(g AS STRING) AS gallery
FROM (SELECT e.*, e.vec_id % (SELECT CAST(greatest(1, floor(count(*) / 25)) AS BIGINT)
                              FROM @embeddings) AS g FROM @embeddings e)
"""

# uncleaned text cells of every spelling the loaders must handle
V_RAW = f"""
SELECT CASE doc_id % 23 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN NULL
            WHEN 3 THEN ' lst_' || CAST(doc_id AS STRING) || ' '
            ELSE 'lst_' || {_padded('doc_id')} END AS listing_id,
       CASE doc_id % 5 WHEN 0 THEN 'stay' WHEN 1 THEN '' WHEN 2 THEN 'Stay' WHEN 3 THEN ' '
            END AS vertical,
       CASE doc_id % 13 WHEN 0 THEN '' WHEN 1 THEN 'N/A'
            ELSE split_part(text, chr(10), 1) END AS name,
       text AS description,
       CASE doc_id % 7 WHEN 0 THEN 'NA' WHEN 1 THEN 'null' WHEN 2 THEN ' ' ELSE source END AS city,
       CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN 'NA' WHEN 3 THEN '4'
            WHEN 4 THEN '4.9' WHEN 5 THEN '-2.7' WHEN 6 THEN '1e1' WHEN 7 THEN NULL
            ELSE ' 7 ' END AS capacity,
       CASE doc_id % 6 WHEN 0 THEN '120.50' WHEN 1 THEN '' WHEN 2 THEN 'nan' WHEN 3 THEN '0'
            WHEN 4 THEN ' 99 ' ELSE '1e3' END AS base_price,
       CASE doc_id % 12 WHEN 0 THEN 'True' WHEN 1 THEN 'false' WHEN 2 THEN 'YES' WHEN 3 THEN 'no'
            WHEN 4 THEN '1' WHEN 5 THEN '0' WHEN 6 THEN 'on' WHEN 7 THEN 'off' WHEN 8 THEN 'y'
            WHEN 9 THEN ' N ' WHEN 10 THEN '' END AS instant_booking,
       CASE doc_id % 8 WHEN 0 THEN '["Wi-Fi", "Kitchen"]' WHEN 1 THEN '[''Pool'', ''TV'']'
            WHEN 2 THEN 'A | B |  | C' WHEN 3 THEN '' WHEN 5 THEN '[broken'
            WHEN 6 THEN 'WiFi, Pool' WHEN 7 THEN '["spa", true, null, 3]' END AS amenities,
       doc_id
FROM @documents
"""

# uncleaned photo records
V_RAW_PHOTOS = f"""
SELECT CASE l_partkey % 29 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN NULL
            ELSE ' adv_' || {_padded('l_orderkey')} END AS entity_id,
       CASE l_suppkey % 31 WHEN 0 THEN ' ' ELSE 'photos/' || CAST(l_orderkey AS STRING) || '_'
            || CAST(l_partkey AS STRING) || '.jpg ' END AS file,
       CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN '3.0'
            ELSE CAST(l_linenumber AS STRING) END AS seq,
       CASE WHEN l_linenumber = 1 THEN 'True' WHEN l_linenumber = 2 THEN '' ELSE 'False' END
            AS is_cover,
       CAST(l_quantity * 40 AS STRING) AS width, 'NA' AS height
FROM @lineitem
"""

# labelled photos: the true room, sometimes wrong, against the file name
V_LABELS = """
SELECT file AS photo_file,
       CASE WHEN l_suppkey % 7 = 0 THEN ' kitchen ' WHEN l_suppkey % 11 = 0 THEN 'sauna'
            WHEN l_partkey % 10 IN (0) THEN 'bedroom' WHEN l_partkey % 10 IN (1, 8) THEN 'bathroom'
            WHEN l_partkey % 10 = 2 THEN 'kitchen' WHEN l_partkey % 10 = 3 THEN 'living'
            WHEN l_partkey % 10 IN (4, 7) THEN 'exterior' WHEN l_partkey % 10 = 5 THEN 'pool'
            WHEN l_partkey % 10 = 6 THEN 'view' ELSE 'other' END AS label,
       CASE l_suppkey % 5 WHEN 0 THEN 'Blurry' WHEN 1 THEN 'sharp' WHEN 2 THEN ' yes '
            WHEN 3 THEN '0' END AS blur_label,
       l_quantity * 2 AS rater1,
       CASE WHEN l_suppkey % 9 <> 0 THEN l_discount * 1000 END AS rater2,
       CASE WHEN l_suppkey % 13 <> 0 THEN l_quantity * 2 END AS avg_rating
FROM v_photos
"""

# explanation cells, good and broken in every way the contract check must see
V_CELLS = f"""
SELECT CASE doc_id % 37 WHEN 0 THEN ' ' WHEN 1 THEN NULL WHEN 2 THEN 'lst_same'
            ELSE 'lst_' || {_padded('doc_id')} END AS listing_id,
       CASE doc_id % 41 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN -1e0 WHEN 2 THEN 101e0
            WHEN 3 THEN CAST('Infinity' AS DOUBLE) ELSE doc_id % 100 * 1e0 END AS quality_score,
       CASE doc_id % 43 WHEN 0 THEN CAST('Infinity' AS DOUBLE) WHEN 1 THEN -5e0
            ELSE doc_id % 90 * 1e0 END AS photo_technical,
       CASE doc_id % 47 WHEN 0 THEN CAST('NaN' AS DOUBLE) ELSE doc_id % 80 * 1e0 END
            AS photo_aesthetic,
       20e0 AS room_coverage, 50e0 AS amenity_check,
       CASE doc_id % 53 WHEN 0 THEN 100.5e0 ELSE 60e0 END AS text_quality,
       doc_id % 101 * 1e0 AS completeness,
       'ok' AS photo_status, 'quality-v1' AS version, '1.0.0' AS quality_engine_version,
       'quality-config-v1' AS config_version,
       CASE doc_id % 19
         WHEN 0 THEN 'not json'
         WHEN 1 THEN '{{{{"positive":[NaN],"issues":[],"suggestions":[]}}}}'
         WHEN 2 THEN '{{{{"positive":[],"issues":[],"suggestions":[]}}}} x'
         WHEN 3 THEN '{{{{"positive":[],"issues":[]}}}}'
         WHEN 4 THEN '{{{{"positive":"a","issues":[],"suggestions":[]}}}}'
         WHEN 5 THEN '[1,2]' WHEN 6 THEN NULL WHEN 7 THEN ''
         WHEN 8 THEN '{{{{"positive":[],"issues":[],"suggestions":[]}}}}{{{{}}}}'
         WHEN 9 THEN '{{{{"positive":null,"issues":[],"suggestions":[]}}}}'
         WHEN 10 THEN ' {{{{"suggestions":["a"],"issues":[{{{{"k":[1]}}}}],"positive":[],"n":-1.5e3}}}} '
         ELSE '{{{{"positive":["' || source || '"],"issues":[],"suggestions":["b"]}}}}'
       END AS explanation_json,
       doc_id
FROM @documents
"""

# a row order every engine can rebuild from the values themselves
ROW_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
           "l_quantity")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, spread over the cores when it has fewer splits than cores.

    The small test files hold one row group each, which one task would read and
    derive from alone. A table with enough splits is not shuffled.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("region", "nation", "part", "supplier"):
        return rows
    cores = spark.sparkContext.defaultParallelism
    splits = rows.rdd.getNumPartitions()
    return rows.repartition(cores, rows.columns[0]) if splits < cores else rows


def select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a SELECT over the given tables (written @name) in Spark."""
    used = set(re.findall(r"@(\w+)", sql))
    frames = {name: table(spark, sf_dir, name) for name in used}
    return spark.sql(re.sub(r"@(\w+)", r"{\1}", sql), **frames)


def plain(sql: str) -> str:
    """The same SELECT for an engine that knows the tables by name."""
    return sql.replace("@", "").replace("{{", "{").replace("}}", "}")


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, V_LISTINGS)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed listings; the amenity cell parsed, the document id as row key."""
    from hostlens.functions.clean import parse_list

    raw = raw_listings(spark, sf_dir)
    return raw.withColumn("amenities", parse_list(F.col("amenities"))).withColumnRenamed(
        "doc_id", "row_key"
    )


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo records with metrics, their path and row key."""
    rows = select(spark, sf_dir, V_PHOTOS)
    return rows.select(
        "entity_id", "file", "seq", "is_cover", "width", "height", "sharpness",
        "colorfulness", "contrast", "brightness", "valid", "phash",
        F.col("file").alias("path"), F.struct(*ROW_KEY).alias("row_key"),
    )


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, V_RAW)


def raw_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, V_RAW_PHOTOS)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Room and blur labels and ratings, one row per photo."""
    return spark.sql(
        V_LABELS.replace("v_photos", "{photos}"), photos=select(spark, sf_dir, V_PHOTOS)
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature table with defects."""
    return select(spark, sf_dir, V_CELLS)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, V_EMBEDDINGS)
