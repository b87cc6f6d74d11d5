"""Divergence between the sources of a language, from bitmaps of term ids by count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.llm.common import LOWER, UPPER, pieces
from hostlens.operators.sizing import broadcast_if_small
from hostlens.session import cut

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
MOST = ((1 << 63) - 1) // UNIT  # counts whose shares are found in 64 bits
ENTRIES = 1 << 20  # counted terms that a task holds before it adds them up or passes them on
PASSED = 1 << 16  # counted terms that are passed on at once
WORD = 64  # term ids of one bitmap word
BLOCK_ENTRIES = 1 << 17  # (source, term) entries that are compared in one task
CELLS = 1 << 21  # pairs of bitmap words that are compared at once

# bytes of terms: letters A-Z lower-cased and all bytes of non-ASCII characters; others separate
_BYTES = bytes.maketrans(
    bytes(c for c in range(128) if chr(c) not in UPPER + LOWER) + UPPER.encode(),
    b" " * (128 - 52) + LOWER.encode())
_TABLE = np.frombuffer(_BYTES, dtype=np.uint8)
COUNTED = ["lang", "source", "term", "n", "docs"]


def _counted(batch: pa.RecordBatch, groups: dict[tuple[str, str], int]) -> pa.Table:
    """(group, term, n, docs) of the texts of one batch; their groups are numbered in `groups`."""
    texts = batch.column(0).cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[
        texts.offset: texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    # one blank after each text keeps their terms apart
    data = _TABLE[np.insert(data[bounds[0]: bounds[-1]], bounds[1:] - bounds[0], 32)]
    inner = data != 32
    edges = np.flatnonzero(np.diff(inner, prepend=False))  # starts and ends in turn
    ahead = np.searchsorted(edges[::2], bounds - bounds[0] + np.arange(len(texts) + 1))
    offsets = np.zeros(len(edges) // 2 + 1, dtype=np.int32)
    np.cumsum(edges[1::2] - edges[::2], out=offsets[1:])
    letters = data[inner]
    del data, inner, edges
    terms = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [
        None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    del offsets, letters
    code, many = terms.indices.to_numpy().astype(np.int64), max(1, len(terms.dictionary))
    pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
    group = np.array([groups.setdefault(pair, len(groups)) for pair in pairs], dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(ahead))
    # terms of a document, then those of a group
    found, n = np.unique(doc * many + code, return_counts=True)
    cell = group[found // many] * many + found % many
    order = np.argsort(cell)
    cell, first = np.unique(cell[order], return_index=True)
    docs = np.diff(np.append(first, len(order)))
    return pa.table({
        "group": pa.array(cell // many), "term": terms.dictionary.take(pa.array(cell % many)),
        "n": pa.array(np.add.reduceat(n[order], first) if len(first) else n),
        "docs": pa.array(docs)})


def _term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; term null for every group.

    Texts are counted as bytes, a group's terms together, before anything is shuffled. Few
    are left to be added up before the shuffle, so Spark adds them up behind it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            found = pa.concat_tables(held).group_by(["group", "term"], use_threads=False).aggregate(
                [("n", "sum"), ("docs", "sum")])
            return found.select(["group", "term", "n_sum", "docs_sum"]).rename_columns(
                ["group", "term", "n", "docs"])

        def packed(found: pa.Table) -> Iterator[pa.RecordBatch]:
            langs, sources = (pa.array([pair[k] for pair in groups], pa.string()) for k in (0, 1))
            zeros = pa.array([0] * len(groups), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [langs, sources, pa.nulls(len(groups), pa.string()), zeros, zeros], COUNTED)
            for part in found.to_batches(max_chunksize=PASSED):
                yield pa.RecordBatch.from_arrays(
                    [langs.take(part.column(0)), sources.take(part.column(0)),
                     part.column(1).cast(pa.string()), part.column(2), part.column(3)], COUNTED)
            groups.clear()
            held.clear()

        for batch in pieces(batches):
            held.append(_counted(batch, groups))
            if sum(t.num_rows for t in held) >= ENTRIES:
                held[:] = [merged()]
                if held[0].num_rows > ENTRIES // 2:
                    yield from packed(held[0])
        if held:
            yield from packed(merged())
        pa.default_memory_pool().release_unused()  # the worker lives on beside later stages

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                         for c in ("text", "lang", "source")])
    parts = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return parts.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + terms)), exactly; null without terms."""
    low = F.nullif(total + terms, F.lit(0))
    # beyond 64 bits only
    large = F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.lit(1) + F.when(
        n < MOST, F.call_function("div", F.lit(UNIT).cast("bigint") * (n + 1), low)).otherwise(
        F.call_function("div", large, low.cast("decimal(20,0)")))


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q) of 64-bit integers."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _joint(bitmaps: DataFrame) -> DataFrame:
    """(lang, source, other, part): what the pairs of levels above zero add to a pair of sources.

    Each row of `bitmaps` has the term ids of one source with one count in one word. In a
    block of words, the words of any two levels are combined by AND; the popcount is the
    joint cell of the two counts. A cell is weighted by f of its counts, less what the
    marginal sums of `source_pairs` take it for: f with either or both counts at zero.
    """
    def run(block: pa.Table) -> pa.Table:
        lang = block.column("lang")[0].as_py()
        names = block.column("source").combine_chunks().dictionary_encode()
        sources = names.dictionary.to_pylist()
        source = names.indices.to_numpy()
        word, bits, p, p0 = (block.column(c).to_numpy() for c in ("word", "bits", "p", "p0"))
        order = np.argsort(word, kind="stable")
        word, bits, p, p0, source = (x[order] for x in (word, bits, p, p0, source))
        bits = bits.view(np.uint64)
        edges = np.append(np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))), len(word))
        total = np.zeros((len(sources), len(sources)), dtype=np.int64)
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            b, g, pa_, pz = bits[first:last], source[first:last], p[first:last], p0[first:last]
            strip = max(1, CELLS // len(b))
            for at in range(0, len(b), strip):
                both = np.bitwise_count(b[at: at + strip, None] & b[None, :])
                i, j = np.nonzero(both)
                n = both[i, j].astype(np.int64)
                i += at
                other = g[i] != g[j]
                i, j, n = i[other], j[other], n[other]
                cell = (_gaps(pa_[i], pa_[j]) - _gaps(pa_[i], pz[j]) - _gaps(pz[i], pa_[j])
                        + _gaps(pz[i], pz[j]))
                np.add.at(total, (g[i], g[j]), n * cell)
        i, j = np.nonzero(total)
        return pa.Table.from_arrays(
            [pa.array([lang] * len(i), pa.string()), pa.array([sources[x] for x in i], pa.string()),
             pa.array([sources[x] for x in j], pa.string()), pa.array(total[i, j])],
            ["lang", "source", "other", "part"])

    return bitmaps.groupBy("lang", "block").applyInArrow(
        run, "lang string, source string, other string, part bigint")


def _total(parts: Column) -> Column:
    return F.sum(parts.cast("decimal(38,0)"))


def _kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """(lang, term, lang_n, block, word, bit) of the terms in enough documents of a language.

    Terms are dealt to blocks by hash; in a block, those of like frequency share words, so
    that a word meets few levels.
    """
    kept = cut(
        counts.filter("term is not null").groupBy("lang", "term").agg(
            F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"),
            F.count(F.lit(1)).alias("spread")).filter(
            F.col("docs") >= least).select("lang", "term", "lang_n", "spread"), "kept-terms")
    sizes = broadcast_if_small(kept.groupBy("lang").agg(
        F.ceil(F.sum("spread") / BLOCK_ENTRIES).alias("blocks")))
    dealt = kept.join(sizes, "lang").select(
        "lang", "term", "lang_n", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))
    # a block is a bounded part of a language, balanced by the hash
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy(
        F.desc("lang_n"), "term")) - 1
    return dealt.withColumn("place", place).select(
        "lang", "term", "lang_n", "block", F.floor(F.col("place") / WORD).cast("int").alias("word"),
        (F.col("place") % WORD).cast("int").alias("bit"))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value",
                       F.row_number().over(by_value).alias("rank"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS,
                      top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's terms are from others'.

    A term is a run of letters A-Z and non-ASCII characters, A-Z lower-cased. Each language
    keeps the V terms in at least `least` of its documents. With N occurrences of kept terms
    in a group, a term that occurs n times there has p = 1 + floor(1e9 (n + 1) / (N + V)).
    Part `pair`: for each other source of the language the sum of f = floor((p - q)^2 / q)
    over all kept terms. Part `term`: f against the whole language for the group's own terms
    with p > q, the `top` largest. Ranks go by value, then by item.

    Since p depends on the count alone, a pair is summed over pairs of counts: their joint
    cells come from bitmaps (`_joint`), those with a zero from marginal sums by complement.

    Null text, lang and source count as empty. Repeated rows count each. A group without
    terms has pairs; a language without kept terms has pairs of value 0; a lone source has
    none. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    counts = cut(_term_counts(docs), "term-counts")
    kept = cut(_kept_terms(counts, least), "term-ids")
    used = cut(counts.filter("term is not null").select("lang", "source", "term", "n").join(
        kept, ["lang", "term"]), "group-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut(
        counts.filter("term is null").select("lang", "source")
        .join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"),
                F.coalesce("v", F.lit(0)).alias("v"), "lang_total")
        .withColumn("p0", _share(F.lit(0), F.col("total"), F.col("v"))), "groups")
    sized = broadcast_if_small(groups)
    shares = used.join(sized, ["lang", "source"]).withColumn(
        "p", _share(F.col("n"), F.col("total"), F.col("v")))

    lang_p = _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    terms = _ranked(
        shares.withColumn("q", lang_p).filter("p > q").select(
            "lang", "source", F.col("term").alias("item"),
            _gap(F.col("p"), F.col("q")).alias("value")), "term").filter(F.col("rank") <= top)

    bitmaps = cut(shares.groupBy("lang", "block", "word", "source", "n", "p", "p0").agg(
        F.bit_or(F.call_function(
            "shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits")), "bitmaps")
    joint = _joint(bitmaps).groupBy("lang", "source", "other").agg(_total(F.col("part")).alias("joint"))
    # terms of each count level of a group
    levels = bitmaps.groupBy("lang", "source", "p", "p0").agg(
        F.sum(F.bit_count("bits")).alias("terms"))
    others = broadcast_if_small(groups.select(
        "lang", F.col("source").alias("other"), F.col("p0").alias("q0")))
    faced = levels.join(others, "lang").filter("source <> other")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    margins = cut(faced.groupBy("lang", "source", "other").agg(
        _total(F.col("terms") * (_gap(p, q0) - _gap(p0, q0))).alias("own"),
        _total(F.col("terms") * (_gap(q0, p) - _gap(q0, p0))).alias("theirs")), "margins")
    pairs = groups.select("lang", "source", "v", "p0").join(others, "lang").filter("source <> other")
    pairs = pairs.join(joint, ["lang", "source", "other"], "left")
    pairs = pairs.join(margins.select("lang", "source", "other", "own"),
                       ["lang", "source", "other"], "left")
    pairs = pairs.join(margins.select(
        "lang", F.col("other").alias("source"), F.col("source").alias("other"), "theirs"),
        ["lang", "source", "other"], "left")
    zero = F.lit(0).cast("decimal(38,0)")
    ground = F.coalesce((F.col("v") * _gap(p0, q0)).cast("decimal(38,0)"), zero)
    value = ground + F.coalesce("joint", zero) + F.coalesce("own", zero) + F.coalesce("theirs", zero)
    pairs = _ranked(pairs.select("lang", "source", F.col("other").alias("item"),
                                 value.cast("bigint").alias("value")), "pair")
    return pairs.unionByName(terms)
