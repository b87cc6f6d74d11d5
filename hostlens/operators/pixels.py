"""Photo metrics from decoded pixels: one pass per image, in Arrow batches.

Input rows have the layout of Spark's image source (`height, width, nChannels,
data`, pixels as blue-green-red bytes, row by row); an unreadable file has a
negative height. Decoding, splitting and scheduling are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hostlens.schemas import PHOTO_METRICS

HASH_SIDE = 8
HASH_INPUT = 32

# --- fixed values: integer luma weights (blue, green, red), their scale in bits ---
METRIC_LUMA = ((3735, 19235, 9798), 15)
HASH_LUMA = ((7471, 38470, 19595), 16)
# --- end of fixed values ---


def grey_level(pixels: np.ndarray, luma=METRIC_LUMA) -> np.ndarray:
    """Rounded weighted sum of the channels, as whole levels 0..255."""
    weights, bits = luma
    total = pixels.astype(np.int64) @ np.array(weights, dtype=np.int64)
    return (total + (1 << bits - 1)) >> bits


def laplacian_variance(grey: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian; borders mirror inside."""
    def mirrored(axis: int) -> np.ndarray:
        if grey.shape[axis] == 1:
            return grey + grey
        pad = [(0, 0), (0, 0)]
        pad[axis] = (1, 1)
        wide = np.pad(grey, pad, mode="reflect")
        size = grey.shape[axis]
        return wide.take(range(size), axis) + wide.take(range(2, size + 2), axis)

    return float((mirrored(0) + mirrored(1) - 4 * grey).var())


def colour_spread(pixels: np.ndarray) -> float:
    blue, green, red = (pixels[..., i].astype(np.float64) for i in range(3))
    warm = np.mean((red - green) ** 2)
    cool = np.mean((0.5 * (red + green) - blue) ** 2)
    return float(np.sqrt(warm + cool))


def _resampling(source: int, target: int) -> np.ndarray:
    """Weights of a three-lobed windowed sinc that resizes a line of pixels."""
    scale = source / target
    stretch = max(scale, 1.0)
    centres = (np.arange(target) + 0.5) * scale
    distance = (np.arange(source)[None, :] + 0.5 - centres[:, None]) / stretch
    weights = np.where(np.abs(distance) < 3, np.sinc(distance) * np.sinc(distance / 3), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def _shrink(grey: np.ndarray, side: int) -> np.ndarray:
    """Resize to side x side, rounding to whole levels after each direction."""
    height, width = grey.shape
    lines = grey.astype(np.float64)
    if width != side:
        lines = np.clip(np.floor(lines @ _resampling(width, side).T + 0.5), 0, 255)
    if height != side:
        lines = np.clip(np.floor(_resampling(height, side) @ lines + 0.5), 0, 255)
    return lines


def _cosines(side: int, kept: int) -> np.ndarray:
    steps = np.arange(side)
    return 2 * np.cos(np.pi * np.arange(kept)[:, None] * (2 * steps + 1) / (2 * side))


def perceptual_hash(pixels: np.ndarray) -> int:
    """64 bits: which low frequencies of the small grey image exceed their median."""
    small = _shrink(grey_level(pixels, HASH_LUMA), HASH_INPUT)
    basis = _cosines(HASH_INPUT, HASH_SIDE)
    low = basis @ small @ basis.T
    bits = (low > np.median(low)).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def _three_channels(data: np.ndarray, height: int, width: int, channels: int) -> np.ndarray:
    image = data.reshape(height, width, channels)
    return np.repeat(image, 3, axis=2) if channels == 1 else image[..., :3]


def measure(data: np.ndarray, height: int, width: int, channels: int) -> dict:
    """All metrics of one decoded image; any defect makes it invalid."""
    unusable = {"valid": False, "width": 0, "height": 0, "sharpness": 0.0,
                "colorfulness": 0.0, "contrast": 0.0, "brightness": 0.0, "phash": None}
    if height < 1 or width < 1 or channels not in (1, 3, 4):
        return unusable
    if len(data) != height * width * channels:
        return unusable
    pixels = _three_channels(data, height, width, channels)
    grey = grey_level(pixels)
    return {
        "valid": True,
        "width": width,
        "height": height,
        "sharpness": laplacian_variance(grey),
        "colorfulness": colour_spread(pixels),
        "contrast": float(grey.std()),
        "brightness": float(grey.mean()),
        "phash": perceptual_hash(pixels),
    }


def photo_metrics(images: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """One metrics row per image row (`path, height, width, channels, data`).

    Arrow batches are cut by bytes (spark.sql.execution.arrow.maxBytesPerBatch),
    so large pictures do not pile up in a Python worker. The columns named in `kept`
    come along unchanged, so that who needs them does not decode the images again.
    """
    schema = pa.schema([
        ("path", pa.string()), ("valid", pa.bool_()), ("width", pa.int32()),
        ("height", pa.int32()), ("sharpness", pa.float64()), ("colorfulness", pa.float64()),
        ("contrast", pa.float64()), ("brightness", pa.float64()), ("phash", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n) for n in ("path", "height", "width", "channels", "data")]
            rows = []
            for path, height, width, channels, data in zip(*columns, strict=True):
                raw = data.as_buffer() if data.is_valid else b""
                found = measure(
                    np.frombuffer(raw, dtype=np.uint8),
                    height.as_py() or -1, width.as_py() or -1, channels.as_py() or -1,
                )
                rows.append({"path": path.as_py(), **found})
            made = pa.RecordBatch.from_pylist(rows, schema=schema)
            yield pa.RecordBatch.from_arrays(
                [*made.columns, *[batch.column(n) for n in kept]], names=[*schema.names, *kept]
            )

    result = StructType([*PHOTO_METRICS.fields, *[images.schema[n] for n in kept]])
    return images.select("path", "height", "width", "channels", "data", *kept).mapInArrow(
        run, result
    )


def flat_images(images: DataFrame) -> DataFrame:
    """Columns of Spark's image source, flattened for `photo_metrics`."""
    return images.select(
        F.col("image.origin").alias("path"), F.col("image.height").alias("height"),
        F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )
