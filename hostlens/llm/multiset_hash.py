"""Fingerprints of documents as homomorphic hashes of their multiset of paragraphs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import mix, pieces, window_hashes, word_hashes
from hostlens.session import cut

WIDE = 32  # lanes modulo 2**32 that tell whether two multisets are equal
LIKE = 128  # lanes modulo 2**32 that tell how alike they are
SHINGLE = 3
_FIELDS = np.uint64(0x0001000100010001)
_MOST = 32768  # shingles added at once, so that no 16-bit field runs into the next
ROWS_PER_BUCKET, MOST_BUCKETS = 2000, 100_000


class Fingerprints:
    """Fingerprints of some texts: `wide` (n x WIDE) and `like` (n x LIKE).

    A paragraph (a line that isn't empty) is hashed to a vector: WIDE lanes from the
    SHAKE-128 of its bytes, and LIKE lanes with the sum of a random sign vector for each of
    its three-word shingles (a shorter paragraph counts as one shingle). A text is the sum
    of its paragraphs' vectors, lane by lane, modulo 2**32. So the order of
    paragraphs has no influence, and paragraphs can be added and taken away.
    """

    def __init__(self, wide: np.ndarray, like: np.ndarray) -> None:
        self.wide, self.like = wide, like

    @classmethod
    def of(cls, texts: list[str]) -> Fingerprints:
        paragraphs, owner = [], []
        for k, text in enumerate(texts):
            own = [p for p in text.split("\n") if p]
            paragraphs += own
            owner += [k] * len(own)
        owners = np.array(owner, dtype=np.int64)
        n = len(texts)
        digests = b"".join(hashlib.shake_128(p.encode()).digest(4 * WIDE) for p in paragraphs)
        wide = _sums(np.frombuffer(digests, dtype="<u4").reshape(-1, WIDE), owners, n)
        words, counts = word_hashes(pa.array(paragraphs, pa.large_string()), fold=False)
        starts = np.cumsum(counts) - counts
        inside = np.arange(len(words)) - np.repeat(starts, counts)
        whole = inside <= np.repeat(counts, counts) - SHINGLE
        of_word = np.repeat(owners, counts)
        units = window_hashes(words, SHINGLE)[whole[: max(0, len(words) - SHINGLE + 1)]]
        like = _signs(units, of_word[whole], n)
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        first, last = words[starts[short]], words[starts[short] + counts[short] - 1]
        alone = mix(first * np.uint64(3) + last + counts[short].astype(np.uint64))
        return cls(wide, like + _signs(alone, owners[short], n))

    def __add__(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints(self.wide + other.wide, self.like + other.like)

    def __sub__(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints(self.wide - other.wide, self.like - other.like)

    def __getitem__(self, rows) -> Fingerprints:
        return Fingerprints(self.wide[rows], self.like[rows])

    @staticmethod
    def joined(parts: list[Fingerprints]) -> Fingerprints:
        return Fingerprints(np.concatenate([p.wide for p in parts]),
                            np.concatenate([p.like for p in parts]))

    def texts(self) -> list[str]:
        """As lower-case hex, little-endian lanes."""
        rows = np.concatenate((np.ascontiguousarray(self.wide).view(np.uint8),
                               np.ascontiguousarray(self.like).view(np.uint8)), axis=1)
        return [row.tobytes().hex() for row in rows]

    @classmethod
    def parse(cls, texts: list[str]) -> Fingerprints:
        rows = np.frombuffer(bytes.fromhex("".join(texts)), dtype=np.uint8)
        rows = rows.reshape(-1, 4 * WIDE + 4 * LIKE)
        return cls(np.ascontiguousarray(rows[:, : 4 * WIDE]).view("<u4"),
                   np.ascontiguousarray(rows[:, 4 * WIDE:]).view("<u4"))

    def likeness(self, other: Fingerprints) -> np.ndarray:
        """0 to 1 for each row: an estimate of one minus the squared distance of the shingle
        counts over the sum of their squared lengths; 1 for equal multisets. Lanes are read
        as signed numbers, which they are up to 2**31 shingles."""
        def squares(x):
            return (x.view(np.int32).astype(np.float64) ** 2).sum(axis=1)

        apart = squares(self.like - other.like)
        whole = squares(self.like) + squares(other.like)
        near = np.clip(1 - apart / np.maximum(whole, 1), 0, 1)
        near[(self.wide == other.wide).all(axis=1)] = 1
        return near


def _sums(values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Sums by owner (ascending), modulo the values' type."""
    out = np.zeros((n, *values.shape[1:]), dtype=values.dtype)
    if len(values):
        starts = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
        out[owners[starts]] = np.add.reduceat(values, starts, axis=0, dtype=values.dtype)
    return out


def _signs(units: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Sums of sign vectors by owner (ascending), modulo 2**32: twice the set bits less all."""
    out = np.zeros((n, LIKE), dtype=np.uint32)
    for first in range(0, len(units), _MOST):
        part, own = units[first: first + _MOST], owners[first: first + _MOST]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        counts = np.diff(np.append(starts, len(own))).astype(np.uint32)
        fields = np.empty((len(starts), LIKE), dtype=np.uint32)
        for half in range(LIKE // 64):
            bits = mix(part + np.uint64(half + 1))
            for shift in range(16):
                added = np.add.reduceat((bits >> np.uint64(shift)) & _FIELDS, starts)
                at = half * 64 + shift * 4
                fields[:, at: at + 4] = added.view("<u2").reshape(-1, 4)
        out[own[starts]] += fields * np.uint32(2) - counts[:, None]
    return out


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; a null text has no paragraphs, like an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            prints = Fingerprints.of([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.texts(), pa.string())],
                names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, "
                                "fingerprint string")


def _order() -> list[Column]:
    """Descending ids, null ones last; rows of one id by a hash of their text."""
    return [F.desc_nulls_last("doc_id"), F.asc("text_hash")]


def _borders(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(null, id, text hash) of the first row of each bucket, in order.

    The keys of all rows are range sorted by sampled borders and written. Each part of the
    sort is cut every so many rows, so that a bucket holds about ROWS_PER_BUCKET rows and
    there are at most about MOST_BUCKETS; their borders are all that reaches the driver.
    """
    keys = cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash")), "print-keys")
    placed = cut(keys.orderBy(*_order()).select(
        "doc_id", "text_hash", F.monotonically_increasing_id().alias("at")), "print-order")
    step = max(ROWS_PER_BUCKET, -(-keys.count() // MOST_BUCKETS))
    firsts = placed.filter(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) % step == 0)
    found = firsts.orderBy("at").select("doc_id", "text_hash").toArrow()
    ids = found.column(0)
    return (ids.is_null().to_numpy(), ids.fill_null(0).to_numpy(),
            found.column(1).to_numpy())


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt to buckets that follow each other; each bucket ends with the row after it.

    Columns: bucket, tail, doc_id, text_hash, text. The row that follows a bucket, the first
    of the next, is also sent to it as its tail; the first row of all follows the last.
    """
    none, ids, hashes = _borders(docs)

    def key(null, doc, text_hash) -> np.ndarray:
        """Ascending where the order of rows is: as unsigned numbers, null ids last."""
        out = np.empty(len(doc), dtype=[("null", "?"), ("id", "<u8"), ("hash", "<i8")])
        down = ~(doc.view(np.uint64) ^ np.uint64(1 << 63))
        out["null"], out["id"], out["hash"] = null, np.where(null, 0, down), text_hash
        return out

    def place(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bucket of each row: how many borders are not behind it, less one."""
        both = np.concatenate((starts, rows))
        order = np.lexsort((np.arange(len(both)), both["hash"], both["id"], both["null"]))
        is_start = order < len(starts)
        found = np.empty(len(rows), dtype=np.int64)
        found[order[~is_start] - len(starts)] = np.cumsum(is_start)[~is_start] - 1
        return np.maximum(found, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = key(none, ids, hashes)
        # rows that are equal in id and text all lie in one bucket
        starts = starts[np.concatenate(([True], starts[1:] != starts[:-1]))[: len(starts)]]
        for batch in batches:
            column = batch.column(0)
            rows = key(column.is_null().to_numpy(zero_copy_only=False),
                       column.fill_null(0).to_numpy(zero_copy_only=False),
                       batch.column(1).to_numpy(zero_copy_only=False))
            bucket = place(rows, starts)
            leads = np.flatnonzero(rows == starts[bucket])
            at = np.concatenate((np.arange(len(rows)), leads))
            tail = np.arange(len(at)) >= len(rows)
            to = np.concatenate((bucket, (bucket[leads] - 1) % len(starts)))
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to), pa.array(tail), *part.columns],
                names=["bucket", "tail", "doc_id", "text_hash", "text"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "bucket bigint, tail boolean, doc_id bigint, text_hash bigint, "
                                "text string")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and likenesses.

    The edited text has its last floor(n_chars / 3) characters replaced by as many first
    characters of the next document in descending id order (or all of it); the first row
    follows the last. Its fingerprint is made by taking away the paragraphs from the cut on
    and adding the new ones.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next). Null ids come last; rows of equal id follow each other by a hash of their
    text; null texts count as empty; a single row is followed by itself. Texts are shuffled
    once, sorted in their bucket and streamed; a task holds about a megabyte of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # bucket, tail, id, text and fingerprint of the row before
        for batch in pieces(batches):
            bucket, tail, ids = (batch.column(k).to_pylist() for k in range(3))
            texts = batch.column(3).to_pylist()
            prints = Fingerprints.of(texts)
            if kept is not None:
                bucket, tail, ids, texts = (
                    [a, *b] for a, b in zip(kept[:4], (bucket, tail, ids, texts), strict=True))
                prints = Fingerprints.joined([kept[4], prints])
            last = len(ids) - 1
            kept = bucket[last], tail[last], ids[last], texts[last], prints[[last]]
            at = [k for k in range(last) if not tail[k]]  # the next row is in the same bucket
            if at:
                yield _edit(ids, texts, prints, at)

    def _edit(ids, texts, prints, at) -> pa.RecordBatch:
        edited, gone, came = [], [], []
        for k in at:
            text, n = texts[k], len(texts[k]) // 3
            cut = len(text) - n
            new = text[:cut] + texts[k + 1][:n]
            start = text.rfind("\n", 0, cut) + 1
            edited.append(hashlib.sha256(new.encode()).hexdigest())
            gone.append(text[start:] if n else "")
            came.append(new[start:] if n else "")
        own, after = prints[at], prints[[k + 1 for k in at]]
        changed = own - Fingerprints.of(gone) + Fingerprints.of(came)
        return pa.RecordBatch.from_arrays([
            pa.array([ids[k] for k in at], pa.int64()),
            pa.array([len(texts[k]) for k in at], pa.int64()),
            pa.array(edited, pa.string()), pa.array(own.texts(), pa.string()),
            pa.array(changed.texts(), pa.string()),
            pa.array(own.likeness(changed)), pa.array(own.likeness(after)),
        ], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next"]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = _with_next(rows).repartition("bucket").sortWithinPartitions(
        "bucket", "tail", *_order()).select("bucket", "tail", "doc_id", "text")
    return dealt.mapInArrow(run, (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"))
