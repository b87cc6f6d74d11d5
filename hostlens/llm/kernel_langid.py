"""Language of texts by an n-gram string kernel, Nystrom landmarks and ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from hostlens.llm.common import pieces

ORDERS = (1, 2, 3, 4)  # the spectrum is blended from n-grams of these lengths
GRAM_BITS = 17
GRAMS = 1 << GRAM_BITS  # n-grams are told apart by a hash of this many values
TRAIN_ROWS = 4_000  # bound of the sample that the classifier is fitted on, over all languages
LANDMARKS = 128  # of those rows, over all languages
RIDGE = 1e-3  # penalty, as a share of the training rows
ROWS = 64  # texts whose presence vectors are held at once
SPAN = 1 << 20  # characters of one text that are read at once
SPREAD = 4  # rows that are drawn for the sample, to those wanted
UNKNOWN = "und"

_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)


def _letters() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane; 0 for other characters."""
    table = np.zeros(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        char = chr(c)
        if char.isalpha():
            low = char.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_LETTERS = _letters()


def letter_points(text: str) -> np.ndarray:
    """Lower-case code points of the letters of a text; each run of others is one 0, both ends too."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    wide = points >= len(_LETTERS)
    out = np.concatenate(([0], _LETTERS[np.where(wide, 0, points)], [0])).astype(np.uint64)
    if wide.any():
        for at in np.flatnonzero(wide):
            char = chr(points[at])
            out[at + 1] = ord(char.lower()) if char.isalpha() else 0
    return out[np.concatenate(([True], (out[1:] != 0) | (out[:-1] != 0)))]


def add_grams(row: np.ndarray, text: str) -> bool:
    """Mark the n-grams of a whole text in a presence vector; whether it has a letter."""
    points = letter_points(text)
    for at in range(0, max(1, len(points)), SPAN):
        part = points[at: at + SPAN + max(ORDERS) - 1]
        code = np.zeros(len(part), dtype=np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if n > len(part):
                break
            code = (code[: len(part) - n + 1] + part[n - 1:] + np.uint64(n)) * _STEP
            if n in ORDERS:
                row[((code ^ (code >> np.uint64(32))) * _ODD) >> np.uint64(64 - GRAM_BITS)] = 1
    return len(points) > 1 and bool(points.any())


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(presence of each n-gram, whether there is a letter) of each text; null counts as empty."""
    rows = np.zeros((len(texts), GRAMS), dtype=np.uint8)
    lettered = np.array([add_grams(row, t or "") for row, t in zip(rows, texts, strict=True)],
                        dtype=bool)
    return rows, lettered


@dataclass
class KernelModel:
    """Landmarks' presence vectors over the n-grams that any of them has, and the solution.

    `column` has the place of an n-gram among those, or -1; `landmarks` is n-grams by
    landmarks, `norms` the number of n-grams of each landmark, `weights` landmarks by
    languages: the inverse root of the landmarks' kernel times the ridge solution.
    """

    languages: list[str]
    used: np.ndarray
    landmarks: np.ndarray
    norms: np.ndarray
    weights: np.ndarray

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        """Shared n-grams of each text and landmark over the root of both their numbers."""
        size = np.maximum(rows.sum(axis=1, dtype=np.int64), 1)
        shared = rows[:, self.used].astype(np.float32) @ self.landmarks
        return shared / np.sqrt(size[:, None] * np.maximum(self.norms, 1)[None, :])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for at in range(0, len(texts), ROWS):
            rows, lettered = presence(texts[at: at + ROWS])
            if not self.languages:
                names += [UNKNOWN] * len(rows)
                scores += [0.0] * len(rows)
                continue
            values = self.kernel(rows) @ self.weights
            best = values.argmax(axis=1)
            # regression on 0 and 1: the value is cut to that range
            top = np.clip(values[np.arange(len(rows)), best], 0, 1)
            names += [self.languages[b] if ok else UNKNOWN
                      for b, ok in zip(best, lettered, strict=True)]
            scores += np.where(lettered, top, 0.0).tolist()
        return names, scores


def _packed(sample: DataFrame) -> DataFrame:
    """Presence vectors of the sample's texts as bits, with the place in the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            for at in range(0, len(texts), ROWS):
                rows, lettered = presence(texts[at: at + ROWS])
                part = batch.slice(at, ROWS)
                bits = [np.packbits(r).tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(bits, pa.binary()),
                     pa.array(lettered)], ["lang", "place", "bits", "lettered"])

    return sample.select("lang", "place", "text").mapInArrow(
        run, "lang string, place int, bits binary, lettered boolean")


def fit_languages(docs: DataFrame, train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS,
                  id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang") -> KernelModel:
    """Learn from rows with an id, a text with a letter, and a language.

    The sample has at most `train_rows` rows: the same number for each language, those with
    the smallest hashes of their ids; of more languages than rows, the most frequent. Their
    first rows are the landmarks, at least one for each language. What reaches the driver is
    one bit vector of GRAMS bits for each sample row, however long its text is.

    The kernel of two texts is the number of n-grams that both have, over the root of the
    product of their numbers. Ridge regression of one-versus-rest targets runs on the
    Nystrom features of the sample.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang")).filter(
        r"doc_id is not null and lang is not null and text rlike '\\p{L}'")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "lang").limit(min(train_rows, landmarks)).collect()
    languages = sorted(r["lang"] for r in sizes)
    none = np.zeros((0, 0))
    empty = KernelModel([], np.zeros(0, dtype=np.int64), none, none, none)
    if not languages:
        return empty
    share = train_rows // len(languages)
    # the smallest hashes lie below a bound that a few times the wanted rows stay under
    bounds = docs.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, (SPREAD * share + 100) / r["n"])) for r in sizes],
        "lang string, bound double")
    hashed = rows.withColumn("h", F.xxhash64("doc_id"))
    drawn = hashed.join(F.broadcast(bounds), "lang").filter(
        F.pmod("h", F.lit(1 << 40)) < F.col("bound") * float(1 << 40)).dropDuplicates(
        ["lang", "doc_id", "text"])
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "doc_id", "text")
    sample = drawn.select("lang", "text", F.row_number().over(order).alias("place")).filter(
        F.col("place") <= share)
    found = sorted((r["lang"], r["place"], bytes(r["bits"]), r["lettered"])
                   for r in _packed(sample).collect())
    found = [r for r in found if r[3]]
    if not found:
        return empty
    languages = sorted({r[0] for r in found})
    bits = np.stack([np.frombuffer(r[2], dtype=np.uint8) for r in found])
    target = np.array([[float(r[0] == lang) for lang in languages] for r in found])
    each = max(1, landmarks // len(languages))
    chosen = np.array([r[1] <= each for r in found])
    if not chosen.any():
        chosen[:] = True
    mark = np.unpackbits(bits[chosen], axis=1)
    used = np.flatnonzero(mark.any(axis=0))
    model = KernelModel(languages, used, mark[:, used].T.astype(np.float32),
                        mark.sum(axis=1, dtype=np.int64).astype(np.float64), none)
    kernel = np.concatenate([model.kernel(np.unpackbits(bits[at: at + ROWS], axis=1))
                             for at in range(0, len(bits), ROWS)]).astype(np.float64)
    own = kernel[chosen]
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    strong = values > 1e-8 * values.max()
    root = vectors[:, strong] / np.sqrt(values[strong])
    features = kernel @ root
    ridge = RIDGE * len(found) * np.eye(features.shape[1])
    solved = np.linalg.solve(features.T @ features + ridge, features.T @ target)
    model.weights = root @ solved
    return model


def predict_languages(docs: DataFrame, model: KernelModel, text_col: str = "text",
                      lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """The rows with the language of their whole texts and the score of that language, 0 to 1.

    A text that is null or has no letter is `und` with score 0, as all texts are when no
    language was learned. Ties go to the first language by name. Only the text is read; no
    row depends on another. Columns of the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in (lang_out, score_out)]
    schema = StructType([*kept, StructField(lang_out, StringType()),
                         StructField(score_out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            names, scores = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
                + [pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[f.name for f in kept] + [lang_out, score_out])

    return docs.mapInArrow(run, schema)


def kept_back(doc_id: Column) -> Column:
    """The rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
