"""Embedding similarity against a small fixed set of prompt vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def prompt_softmax(prompts: list[list[float]]):
    """An Arrow function: embedding -> softmax of 100 * cosine to every prompt.

    The prompts are one vector per configured label, so they travel with the
    function; a batch of embeddings is one matrix product.
    """
    matrix = np.asarray(prompts, dtype=np.float64)
    matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    labels, width = matrix.shape

    @F.arrow_udf("array<double>")
    def softmax(batch: pa.Array) -> pa.Array:
        lengths = batch.value_lengths().to_numpy(zero_copy_only=False)
        usable = np.asarray(lengths == width)
        flat = batch.filter(pa.array(usable)).flatten()
        vectors = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        vectors = vectors.reshape(-1, width)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            logits = 100.0 * ((vectors / norms) @ matrix.T)
        logits -= logits.max(axis=1, keepdims=True)
        weights = np.exp(logits)
        probabilities = weights / weights.sum(axis=1, keepdims=True)
        # rows without a usable vector become null
        good = ~np.isnan(probabilities).any(axis=1)
        present = np.zeros(len(batch), dtype=bool)
        present[np.flatnonzero(usable)[good]] = True
        offsets = np.concatenate([[0], np.cumsum(present) * labels]).astype(np.int32)
        values = pa.array(probabilities[good].ravel())
        result = pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~present))
        return result

    return softmax


def top_label(probabilities: Column, labels: tuple[str, ...]) -> Column:
    """Label of the first highest probability."""
    position = F.array_position(probabilities, F.array_max(probabilities))
    names = F.array(*[F.lit(label) for label in labels])
    return F.get(names, (position - 1).cast("int"))


def labels_above(probabilities: Column, threshold: float, labels: tuple[str, ...]) -> Column:
    """Bit mask of the labels whose probability reaches the threshold."""
    mask = F.lit(0)
    for i, _ in enumerate(labels):
        hit = F.get(probabilities, F.lit(i)) >= threshold
        mask = mask + F.when(hit, F.lit(1 << i)).otherwise(F.lit(0))
    return mask
