"""What several operators share: reading tables, A-Z lower-casing, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# a word is a maximal run of other bytes; these are ASCII, so UTF-8 bytes can be searched for them
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 1 << 20  # bytes of text that are hashed at once

_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused_names(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that the frame does not have, in any case of letters."""
    taken = {name.lower() for name in df.columns}
    found = []
    for stem in stems:
        while stem.lower() in taken:
            stem = f"_{stem}"
        found.append(stem)
        taken.add(stem.lower())
    return found


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_B
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_ODD, CHUNK + 1)
_DOWN = _powers(_INVERSE, CHUNK + 1)


def _hash_words(data: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word in the bytes; at most CHUNK bytes unless one word is longer."""
    gap = _SPACE[data]
    inner = ~gap
    starts = np.flatnonzero(inner & np.concatenate(([True], gap[:-1])))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    ends = np.flatnonzero(inner & np.concatenate((gap[1:], [True]))) + 1
    up, down = (_UP, _DOWN) if len(data) <= CHUNK else (
        _powers(_ODD, len(data) + 1), _powers(_INVERSE, len(data) + 1))
    values = _BYTE[_FOLD[data] if fold else data] * up[: len(data)]
    values[gap] = 0
    sums = np.add.reduceat(values, starts) * down[starts]
    return mix(sums + (ends - starts).astype(np.uint64) * _MIX_A), starts


def word_hashes(texts: pa.Array, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch of texts, and the word count of each text.

    Null and blank texts have no words. Works on the UTF-8 bytes, CHUNK bytes at a time, cut
    between texts or, in longer texts, at white space.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[
        texts.offset: texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + CHUNK, "right")) - 1)
        at, end = int(bounds[first]), int(bounds[last])
        if last > first + 1 or end - at <= CHUNK:
            # one blank between texts keeps their words apart
            part = data[at:end]
            inside = bounds[first + 1: last] - at
            spaced = np.insert(part, inside, 32) if len(inside) else part
            if len(spaced) > CHUNK:
                last = max(first + 1, (first + last) // 2)
                end = int(bounds[last])
                inside = bounds[first + 1: last] - at
                spaced = np.insert(data[at:end], inside, 32) if len(inside) else data[at:end]
            found, starts = _hash_words(spaced, fold)
            edges = bounds[first: last] - at + np.arange(last - first)
            owner = np.searchsorted(edges, starts, "right") - 1
            counts[first:last] += np.bincount(owner, minlength=last - first)
            hashes.append(found)
        else:
            while at < end:
                stop = min(end, at + CHUNK)
                if stop < end:
                    blanks = np.flatnonzero(_SPACE[data[at:stop]])
                    if len(blanks):
                        stop = at + int(blanks[-1]) + 1
                    else:
                        ahead = np.flatnonzero(_SPACE[data[stop:end]])
                        stop = stop + int(ahead[0]) if len(ahead) else end
                found, _ = _hash_words(data[at:stop], fold)
                counts[first] += len(found)
                hashes.append(found)
                at = stop
        first = last
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)), counts


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive words; the runs may cross text bounds."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, factor = np.zeros(n, dtype=np.uint64), 1
    for k in range(size):
        factor = factor * int(_ODD) % (1 << 64)
        total += words[k: k + n] * np.uint64(factor)
    return mix(total)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about CHUNK bytes of text, at least one row."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        length = np.diff(np.frombuffer(sizes.buffers()[1], dtype=np.int64)[
            sizes.offset: sizes.offset + len(sizes) + 1])
        total, first = np.cumsum(length + 64), 0
        while first < batch.num_rows:
            base = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, base + CHUNK, "right")))
            yield batch.slice(first, last - first)
            first = last
