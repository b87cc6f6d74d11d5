"""Removal of passages that repeat across documents, found by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlens.llm.common import mix, pieces, window_hashes, word_hashes

# perfect difference sets: modulo the period, each difference is one of two members
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
WINDOW, PERIOD = 13, 7
LAST_ID = (1 << 63) - 1  # stands for null ids, which come after all others


def _met(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, doc) of a batch, and the smallest and largest doc of each one's key."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
    key, doc = key[new], doc[new]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    start = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    return key, doc, doc[start][group], doc[np.append(start[1:], len(doc)) - 1][group]


def _cover_keys(texts: pa.Array, window: int, period: int):
    """(words, counts, positions, keys): hashes of the windows at cover positions, even."""
    size = window - period + 1
    words, counts = word_hashes(texts, fold=False)
    hashes = window_hashes(words, size)
    at = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    n = np.repeat(counts, counts)
    covered = np.isin(np.arange(period), COVERS[period])
    good = np.flatnonzero(
        (covered[at % period] & (at <= n - size) & (n >= window))[: len(hashes)])
    return words, counts, good, hashes[good] & ~np.uint64(1)


def _anchors(docs: DataFrame, window: int, period: int) -> DataFrame:
    """(key, doc_id) of the anchors of every text.

    Where several documents of a batch have an anchor, only the smallest and the largest of
    them keep its key. The others are known to be matched: they get an odd key of their
    own, with the same lower half.
    """
    low = np.uint64(0xFFFFFFFF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            _, counts, good, keys = _cover_keys(batch.column(1), window, period)
            if not len(good):
                continue
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)[good]
            key, doc, least, most = _met(keys, ids)
            own = (mix(key + mix(doc.view(np.uint64))) & ~low) | (key & low) | np.uint64(1)
            key = np.where((doc != least) & (doc != most), own, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(doc)], names=["key", "doc_id"])

    return docs.mapInArrow(run, "key bigint, doc_id bigint")


def _are_copies(batch: pa.RecordBatch, column: int) -> list[bool]:
    """Whether the digest of each text is listed in its row as that of a copy."""
    listed = batch.column(column).to_pylist()
    return [bool(own) and hashlib.md5(raw).hexdigest() in own for raw, own in zip(
        batch.column(1).cast(pa.binary()).to_pylist(), listed, strict=True)]


def _windows(rows: DataFrame, window: int, period: int) -> DataFrame:
    """(key, doc_id, via): hashes of the windows around matched anchors.

    `via` is set for windows that a smaller document of the batch has, too; those need not
    meet the others of their key.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            batch = batch.filter(pa.array([not c for c in _are_copies(batch, 3)]))
            words, counts, good, keys = _cover_keys(batch.column(1), window, period)
            hashes = window_hashes(words, window)
            owner = np.repeat(np.arange(len(counts)), counts)
            lists = batch.column(2)
            marks = lists.flatten().to_numpy().view(np.uint32).astype(np.uint64)
            marked = np.repeat(np.arange(len(counts)), np.diff(lists.offsets.to_numpy()))
            # a row's marks and anchors meet on (row, lower half of the key)
            tag = np.uint64(32)
            matched = np.isin((owner[good].astype(np.uint64) << tag) | (keys & np.uint64(0xFFFFFFFE)),
                              (marked.astype(np.uint64) << tag) | (marks & np.uint64(0xFFFFFFFE)))
            at = good[matched]
            wanted = np.zeros(len(words), dtype=bool)
            for back in range(period):
                wanted[at[at >= back] - back] = True
            place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
            found = np.flatnonzero(
                (wanted & (place <= np.repeat(counts, counts) - window))[: len(hashes)])
            if not len(found):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)[owner[found]]
            key, doc, least, _ = _met(hashes[found], ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(doc),
                 pa.array(mix(key + mix(doc.view(np.uint64))).view(np.int64), mask=doc == least)],
                names=["key", "doc_id", "via"])

    return rows.mapInArrow(run, "key bigint, doc_id bigint, via bigint")


def _kept(rows: DataFrame, window: int) -> DataFrame:
    """What is left of each text without the windows whose hashes `repeats` lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out, totals, removed = [], [], []
            words, counts = word_hashes(batch.column(1), fold=False)
            hashes = window_hashes(words, window).view(np.int64)
            start = 0
            copies = _are_copies(batch, 3)
            for raw, found, copy, n in zip(batch.column(1).cast(pa.binary()).to_pylist(),
                                           batch.column(2), copies, counts, strict=True):
                own = raw.split()  # of bytes: at \x20 and \x09-\x0D
                if copy and n >= window:
                    own = []
                elif found.is_valid and n >= window:
                    starts = np.flatnonzero(np.isin(
                        hashes[start: start + n - window + 1], found.values.to_numpy()))
                    edge = np.zeros(n + 1, dtype=np.int64)
                    edge[starts] += 1
                    edge[starts + window] -= 1
                    own = [own[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                start += n
                totals.append(n)
                removed.append(n - len(own))
                out.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return rows.mapInArrow(
        run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def _free_id(docs: DataFrame, id_col: str) -> int | None:
    """Where ids are moved up against each other to leave LAST_ID free; None if it is.

    The largest number below LAST_ID that is no id.
    """
    if docs.agg(F.max(id_col)).first()[0] != LAST_ID:
        return None
    reach = 1000
    while True:
        near = {r[0] for r in docs.select(id_col).filter(
            F.col(id_col) >= LAST_ID - reach).distinct().collect()}
        free = next((k for k in range(LAST_ID - 1, LAST_ID - reach, -1) if k not in near), None)
        if free is not None:
            return free
        reach *= 10


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row.

    A run of `window` words that also starts in a document with a smaller id is removed;
    all runs are judged on the input. Words are runs of bytes other than \\x20 and \\x09-\\x0D.

    Runs of (window - period + 1) words are hashed at positions whose remainder by the
    period is in a difference cover (for 7: 0, 1, 3). However two equal windows lie in
    their documents, some offset below the period puts both on a cover position, so they
    share an anchor. Anchors that several documents have are extended: all windows
    around them are hashed whole, and the smallest id of each decides. Windows with no
    shared anchor are never hashed. Hashes have 64 bits.

    Whole copies of a text are found by their digest and skip that. Anchors and windows are
    met within each batch first, so that a passage in very many
    documents is a few rows in the shuffle. Only hashes and ids are shuffled, and texts
    once (the exchange by id serves both joins); positions are found again from the hashes.
    A null text has no words. Null ids come after all others and are returned as null. Rows
    of equal id do not remove each other's words.
    """
    free, own_id = _free_id(docs, id_col), F.col(id_col).cast("bigint")
    if free is not None:  # ids keep their order
        own_id = F.when(own_id > free, own_id - 1).otherwise(own_id)
    texts = docs.select(F.coalesce(own_id, F.lit(LAST_ID)).alias("doc_id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    by_key = Window.partitionBy("key")
    matched = (
        _anchors(texts, window, period)
        .withColumn("low", F.min("doc_id").over(by_key))
        .withColumn("high", F.max("doc_id").over(by_key))
        .filter("low <> high or key % 2 <> 0")
        # as many as the text has, at most
        .groupBy("doc_id").agg(F.collect_list(
            F.expr("cast(shiftright(shiftleft(key, 32), 32) as int)")).alias("anchors"))
    )
    # a whole copy of a text with a smaller id needs no windows: all its words go
    digests = texts.select("doc_id", F.md5("text").alias("digest"))
    firsts = digests.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = digests.join(firsts, "digest").filter("doc_id > first").groupBy("doc_id").agg(
        F.collect_set("digest").alias("copies"))  # one, but for repeated ids
    around = texts.join(matched.join(copies, "doc_id", "left"), "doc_id").select(
        "doc_id", "text", "anchors", "copies")
    own = Window.partitionBy(F.coalesce("via", "key"))
    repeats = (
        _windows(around, window, period).withColumn("low", F.min("doc_id").over(own))
        .filter("via is not null or low < doc_id")
        .groupBy("doc_id").agg(F.collect_list("key").alias("repeats"))
        .join(copies, "doc_id", "full")
    )
    rows = texts.join(repeats, "doc_id", "left").select("doc_id", "text", "repeats", "copies")
    given = F.col("doc_id")
    if free is not None:
        given = F.when(given >= free, F.when(given < LAST_ID, given + 1)).otherwise(given)
    return _kept(rows, window).withColumn("doc_id", F.when(F.col("doc_id") != LAST_ID, given))
