"""Table schemas: inputs, photo facts, and the explanation struct."""

from __future__ import annotations

from pyspark.sql import types as T

# input column -> target type; every column but the key may be absent
LISTING_FIELDS = {
    "listing_id": "text",
    "vertical": "text",
    "name": "text",
    "description": "text",
    "city": "text",
    "country": "text",
    "capacity": "int",
    "bedrooms": "int",
    "bathrooms": "float",
    "base_price": "float",
    "currency": "text",
    "instant_booking": "bool",
    "is_calendar_synced": "bool",
    "has_active_ical": "bool",
    "pricing_days_180": "int",
    "blocked_days_180": "int",
    "amenities": "list",
    "photo_count": "int",
    "property_type": "text",
    "status": "text",
}

PHOTO_FIELDS = {
    "entity_id": "text",
    "file": "text",
    "seq": "int",
    "is_cover": "bool",
    "width": "int",
    "height": "int",
    "bytes": "int",
}

EXPLANATION = T.StructType([
    T.StructField("positive", T.ArrayType(T.StringType())),
    T.StructField("issues", T.ArrayType(T.StringType())),
    T.StructField("suggestions", T.ArrayType(T.StringType())),
    T.StructField("bad_photos", T.ArrayType(T.StructType([
        T.StructField("path", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
    ]))),
])

# one row per decoded photo; what the pixel job emits
PHOTO_METRICS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("valid", T.BooleanType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("sharpness", T.DoubleType()),
    T.StructField("colorfulness", T.DoubleType()),
    T.StructField("contrast", T.DoubleType()),
    T.StructField("brightness", T.DoubleType()),
    T.StructField("phash", T.LongType()),
])
