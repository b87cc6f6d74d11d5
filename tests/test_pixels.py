"""Pixel metrics and image files."""

import math

import numpy as np
import pytest

from hostlens.catalog.inputs import _png
from hostlens.operators import pixels
from hostlens.operators.matching import existing_photos
from hostlens.operators.pixels import photo_metrics
from hostlens.sources.images import existing_files, read_images


def picture(kind, height=40, width=60):
    y, x = np.mgrid[0:height, 0:width]
    grey = {
        "flat": np.full((height, width), 90), "ramp": x * 255 // (width - 1),
        "checker": (x // 4 + y // 4) % 2 * 255, "dark": (x + y) % 20,
        "bright": 235 + (x + y) % 20,
    }[kind]
    image = np.stack([grey, grey, grey], axis=2)
    if kind == "ramp":
        image[..., 0] = 255 - image[..., 0]
    return image.astype(np.uint8)


def slow_metrics(image):
    """The same numbers by plain loops over pixels."""
    height, width, _ = image.shape
    grey = [[(3735 * int(b) + 19235 * int(g) + 9798 * int(r) + 16384) >> 15
             for b, g, r in line] for line in image]

    def at(y, x):
        y = -y if y < 0 else 2 * height - 2 - y if y >= height else y
        x = -x if x < 0 else 2 * width - 2 - x if x >= width else x
        return grey[y][x]

    edges = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x)
             for y in range(height) for x in range(width)]
    levels = [v for line in grey for v in line]

    def variance(values):
        mean = sum(values) / len(values)
        return sum((v - mean) ** 2 for v in values) / len(values)

    flat = [(int(b), int(g), int(r)) for line in image for b, g, r in line]
    warm = sum((r - g) ** 2 for b, g, r in flat) / len(flat)
    cool = sum((0.5 * (r + g) - b) ** 2 for b, g, r in flat) / len(flat)
    return {
        "sharpness": variance(edges), "contrast": math.sqrt(variance(levels)),
        "brightness": sum(levels) / len(levels), "colorfulness": math.sqrt(warm + cool),
    }


@pytest.mark.parametrize("kind", ["flat", "ramp", "checker", "dark", "bright"])
def test_metrics_equal_plain_loops(kind):
    image = picture(kind)
    found = pixels.measure(image.ravel(), *image.shape)
    for name, value in slow_metrics(image).items():
        assert found[name] == pytest.approx(value, abs=1e-9), name


def test_hash_of_copies_and_scaled_copies():
    rng = np.random.default_rng(5)
    coarse = rng.integers(0, 255, (8, 8, 3))
    image = np.kron(coarse, np.ones((12, 12, 1))).astype(np.uint8)
    other = np.kron(rng.integers(0, 255, (8, 8, 3)), np.ones((12, 12, 1))).astype(np.uint8)
    touched = image.copy()
    touched[0:6, 0:6] = 128
    def distance(a, b):
        a, b = pixels.perceptual_hash(a), pixels.perceptual_hash(b)
        return bin((a ^ b) & (1 << 64) - 1).count("1")

    assert distance(image, image.copy()) == 0
    assert distance(image, touched) <= 8
    assert distance(image, image[::2, ::2]) <= 8
    assert distance(image, other) > 12


def test_resampling_rows_sum_to_one_and_identity():
    assert np.allclose(pixels._resampling(100, 32).sum(axis=1), 1)
    assert np.allclose(pixels._resampling(32, 32), np.eye(32))


def test_unusable_pixels_are_invalid():
    assert not pixels.measure(np.zeros(0, np.uint8), -1, -1, -1)["valid"]
    assert not pixels.measure(np.zeros(5, np.uint8), 2, 2, 3)["valid"]
    single = pixels.measure(np.array([1, 2, 3], np.uint8), 1, 1, 3)
    assert single["valid"] and single["sharpness"] == 0.0
    grey = pixels.measure(np.full(16, 7, np.uint8), 4, 4, 1)
    assert grey["brightness"] == 7.0


def test_image_files(spark, tmp_path):
    folder = tmp_path / "data" / "photos"
    folder.mkdir(parents=True)
    image = picture("ramp")
    (folder / "a b+c.png").write_bytes(_png(60, 40, image.tobytes()))
    (folder / "broken.jpg").write_bytes(b"not-a-real-image")
    rows = {r.path.rsplit("/", 1)[1]: r for r in
            photo_metrics(read_images(spark, str(tmp_path))).collect()}
    good, bad = rows["a b+c.png"], rows["broken.jpg"]
    assert (good.valid, good.width, good.height) == (True, 60, 40)
    assert good.path == str(folder / "a b+c.png")
    assert good.sharpness == pytest.approx(slow_metrics(image)["sharpness"])
    assert not bad.valid and bad.phash is None
    assert existing_files(spark, str(tmp_path)).count() == 2


def test_photo_lookup_prefers_the_data_folder(spark):
    files = spark.createDataFrame(
        [("/w/data/p/a.jpg",), ("/w/p/a.jpg",), ("/w/p/b.jpg",), ("/abs/c.jpg",), ("/x/d.jpg",)],
        "path string",
    )
    photos = spark.createDataFrame(
        [("p/a.jpg",), ("p/b.jpg",), ("/abs/c.jpg",), ("d.jpg",), ("./p//a.jpg",)], "file string"
    )
    found = {r.file: r.path for r in existing_photos(photos, files, "/w/data").collect()}
    assert found == {
        "p/a.jpg": "/w/data/p/a.jpg", "p/b.jpg": "/w/p/b.jpg", "/abs/c.jpg": "/abs/c.jpg",
        "./p//a.jpg": "/w/data/p/a.jpg",
    }
