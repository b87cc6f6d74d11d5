"""Scoring configuration: weights, thresholds, labels and word lists.

One immutable `Settings` object is passed to the operators; its values enter the
plans as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from types import MappingProxyType

# --- fixed values: names, words, numbers and prompts the scores are defined by ---
COMPONENTS = (
    "photo_technical",
    "photo_aesthetic",
    "room_coverage",
    "amenity_check",
    "text_quality",
    "completeness",
)

WEIGHTS = {
    "photo_technical": 20,
    "photo_aesthetic": 15,
    "room_coverage": 10,
    "amenity_check": 10,
    "text_quality": 15,
    "completeness": 30,
}

EXPECTED_ROOMS = ("bedroom", "bathroom", "kitchen", "living", "exterior", "pool", "view")
ALWAYS_REQUIRED_ROOMS = ("bathroom", "kitchen", "living", "exterior")
ROOM_LABELS = (
    "bedroom", "bathroom", "kitchen", "living", "exterior", "pool", "view", "other",
)
ROOM_PROMPTS = {
    "bedroom": "a photo of a bedroom in a vacation rental",
    "bathroom": "a photo of a bathroom in a vacation rental",
    "kitchen": "a photo of a kitchen in a vacation rental",
    "living": "a photo of a living room in a vacation rental",
    "exterior": "a photo of the exterior of a building or house",
    "pool": "a photo of a swimming pool",
    "view": "a photo of a scenic view from a window or balcony",
    "other": "a photo of an interior or exterior space",
}
# file-name keyword -> room, first hit wins
ROOM_KEYWORDS = (
    ("bedroom", "bedroom"),
    ("bathroom", "bathroom"),
    ("kitchen", "kitchen"),
    ("living room", "living"),
    ("living", "living"),
    ("exterior", "exterior"),
    ("pool", "pool"),
    ("view", "view"),
)

AMENITY_LABELS = (
    "pool", "air_conditioning", "tv", "washing_machine", "balcony",
    "wifi", "parking", "kitchen", "heating", "hot_tub",
)
AMENITY_PROMPTS = {
    "pool": "a swimming pool",
    "air_conditioning": "an air conditioning unit",
    "tv": "a television screen",
    "washing_machine": "a washing machine",
    "balcony": "a balcony or terrace",
    "wifi": "a wifi router",
    "parking": "a parking space or garage",
    "kitchen": "a fully equipped kitchen",
    "heating": "a radiator or heating system",
    "hot_tub": "a hot tub or jacuzzi",
}
# amenity key -> aliases, first key wins
AMENITY_ALIASES = {
    "pool": ("pool", "swimming pool", "piscine"),
    "air_conditioning": ("air conditioning", "ac", "climatisation", "clim"),
    "tv": ("tv", "television", "télévision"),
    "washing_machine": ("washing machine", "washer", "lave-linge", "laundry"),
    "balcony": ("balcony", "terrace", "balcon", "terrasse"),
    "wifi": ("wifi", "wi-fi", "internet"),
    "parking": ("parking", "garage"),
    "kitchen": ("kitchen", "cuisine"),
    "heating": ("heating", "heater", "chauffage"),
    "hot_tub": ("hot tub", "jacuzzi", "spa"),
}

FRENCH_WORDS = (
    "le", "la", "les", "des", "une", "un", "et", "dans", "pour", "avec",
    "chambre", "appartement",
)
ENGLISH_WORDS = (
    "the", "and", "with", "room", "bedroom", "apartment", "kitchen", "pool", "wifi",
)
ARABIC_RANGE = ("\u0600", "\u06ff")

# reason text fragments that decide where a reason is listed
POSITIVE_MARKS = ("good", "detected and declared", "coverage")
ISSUE_MARKS = (
    "blurry", "duplicate", "low-resolution", "missing", "no ",
    "not visually confirmed", "detected but not declared", "unavailable",
)
TEXT_ISSUE_MARKS = ("missing", "short", "empty")

FEATURE_COLUMNS = (
    "listing_id", "quality_score", *COMPONENTS, "photo_status", "version",
    "quality_engine_version", "config_version", "explanation_json",
)
# --- end of fixed values ---


@dataclass(frozen=True)
class Settings:
    """All tunable numbers, with their default values."""

    weights: dict = field(default_factory=lambda: MappingProxyType(dict(WEIGHTS)))
    # evaluation gates
    room_accuracy_gate: float = 0.85
    blur_precision_gate: float = 0.90
    # photo metrics
    sharp_threshold: float = 100.0
    blurry_threshold: float = 50.0
    dark_threshold: float = 60.0
    bright_threshold: float = 200.0
    min_megapixels: float = 0.3
    good_megapixels: float = 2.0
    low_resolution_score: float = 40.0
    hash_threshold: int = 5
    # text
    min_description_words: int = 50
    good_description_words: int = 100
    excellent_description_words: int = 300
    min_title_length: int = 10
    # rooms and amenities
    room_confidence: float = 0.25
    amenity_probability: float = 0.22
    unconfirmed_penalty: float = 0.3
    # completeness
    min_calendar_days: int = 30
    # versions
    schema_version: str = "quality-v1"
    engine_version: str = "1.0.0"
    config_version: str = "quality-config-v1"


DEFAULTS = Settings()


def check_weights(weights=None) -> float:
    """Refuse weights that are not exactly the six components, finite, >= 0, sum 100."""
    weights = WEIGHTS if weights is None else weights
    unknown = sorted(set(weights).symmetric_difference(COMPONENTS))
    if unknown:
        raise ValueError(f"weights must cover exactly {list(COMPONENTS)}; differs in {unknown}")
    for name, value in weights.items():
        usable = isinstance(value, (int, float)) and math.isfinite(value) and value >= 0
        if not usable:
            raise ValueError(f"weight of {name} must be a finite number >= 0, got {value!r}")
    total = sum(weights.values())
    if abs(total - 100) > 1e-6:
        raise ValueError(f"weights must add up to 100, got {total}")
    return total
