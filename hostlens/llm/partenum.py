"""Exact Jaccard join on word shingles by PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.llm.common import mix, pieces, unused_names, window_hashes, word_hashes
from hostlens.llm.linked import linked_roots
from hostlens.session import cut

SHINGLE = 5
# links: 100 * |A n B| >= 80 * |A u B|, so |A| + |B| >= 9 times the number of differences
PERCENT = 80
BAND = 1.5  # largest to smallest set size of a band
# from this size on, a band's groups are cut into PARTS parts, all but one of which are signed
TWO_LEVELS, PARTS = 64, 3
SPARE_GROUPS = 0.2  # groups of a two-level band, over those that similar sets may disagree in
SPARE = 2.0  # partitions of a smaller band, to those that similar sets may disagree in
# a shingle is taken for common if batches in which so many documents have it hold this
# share of all documents' occurrences; it is looked up in a table of fixed size, by its hash
COMMON_SHARE, COMMON_LEAST, COMMON_SLOTS = 0.00005, 2, 1 << 21


SKETCH = 8  # 64-bit words of a set's parities


def band_starts(most: int) -> np.ndarray:
    """Smallest set size of each band, up to one above `most`."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(max(starts[-1] + 1, int(starts[-1] * BAND) + 1))
    return np.array(starts, dtype=np.int64)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the number of each text.

    A-Z are lower-cased. A text of fewer words than a shingle has them all as one.
    """
    words, counts = word_hashes(texts, fold=True)
    base = np.cumsum(counts) - counts
    place = np.arange(len(words)) - np.repeat(base, counts)
    hashes = window_hashes(words, SHINGLE)
    whole = np.flatnonzero((place <= np.repeat(counts, counts) - SHINGLE)[: len(hashes)])
    owner = np.repeat(np.arange(len(counts)), counts)[whole]
    hashes = hashes[whole]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        alone = np.zeros(len(short), dtype=np.uint64)
        for k in range(SHINGLE - 1):
            has = counts[short] > k
            alone[has] = mix(alone[has] * np.uint64(31) + words[base[short[has]] + k])
        hashes, owner = np.append(hashes, alone), np.append(owner, short)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
        hashes, owner = hashes[new], owner[new]
    return hashes, np.bincount(owner, minlength=len(counts))


def _class_ids(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; the first is the id of the class of equal sets."""
    ids = np.zeros((2, len(sizes)), dtype=np.uint64)
    some = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[some]
    if len(starts):
        for k in range(2):
            ids[k, some] = mix(np.add.reduceat(
                mix(hashes + np.uint64(0x51ED27 + k)), starts) + sizes[some].astype(np.uint64))
    return ids[0].view(np.int64), ids[1].view(np.int64)


def band_layout(last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(groups, parts of a group) of bands by their largest set size."""
    differences = 2 * last // 9
    half = differences // 2 + 1
    two = last >= TWO_LEVELS
    groups = np.where(two, half + np.ceil(SPARE_GROUPS * half),
                      np.ceil(SPARE * (differences + 1))).astype(np.int64)
    return groups, np.where(two, PARTS, 1)


def signatures(
    hashes: np.ndarray, sizes: np.ndarray, common: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) of all sets.

    A set of n shingles signs in its own size band and, where a similar set may be in the
    next band, there too. Linked sets differ in at most k = (|A| + |B|) / 9 shingles. In a
    band the shingle domain is split by hash into g groups, and each group into three parts.
    At most k / 2 groups hold two differences or more; in each of the others, one part at
    most holds a difference. So of the subsets of two parts, enumerated in every group, the
    sets agree on one in g - k / 2 groups at least. A signature is the hash of all shingles in
    such a subset. Small bands have whole groups as signatures; there the sets agree on g - k.

    Sets that agree on t of their signatures may each leave out t - 1, those that come last
    in an order that only depends on content: the first of the t is signed by both. The
    weakest are left out, and strength is the number of shingles that aren't common; which
    ones are taken for common never changes the links.
    """
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    starts = band_starts(int(sizes.max()) * 3 + 10)
    band = np.searchsorted(starts, sizes, "right") - 1
    rare = np.ones(len(hashes))
    if len(common):
        rare[common[(hashes % np.uint64(COMMON_SLOTS)).astype(np.int64)]] = 0
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out_sig, out_set = [], []
    for ahead in (0, 1):
        b = band + ahead
        last = starts[b + 1] - 1
        partner = np.minimum(last, sizes * 100 // PERCENT)
        wanted = (sizes > 0) & (partner >= np.where(ahead, starts[b], 1))
        k = (sizes + partner) // 9
        groups, parts = band_layout(last)
        for each in (1, PARTS):
            chosen = np.flatnonzero(wanted & (parts == each))
            own = (wanted & (parts == each))[owner]
            if not own.any():
                continue
            # sets are numbered anew, 0 to len(chosen) - 1, and so are their slots
            number = np.full(len(sizes), -1)
            number[chosen] = np.arange(len(chosen))
            slots = groups[chosen] * each
            offset = np.cumsum(slots) - slots
            seed = mix(b[chosen].astype(np.uint64) + np.uint64(977))
            o = number[owner[own]]
            mixed = mix(hashes[own] + seed[o])
            slot = offset[o] + (mixed % slots[o].astype(np.uint64)).astype(np.int64)
            total = int(slots.sum())
            content = np.zeros(total, dtype=np.uint64)
            np.add.at(content, slot, mix(mixed))
            count = np.bincount(slot, minlength=total)
            strength = np.bincount(slot, weights=rare[own], minlength=total)
            if each > 1:  # all but one of a group's parts, which lie side by side
                left = [content, count, strength]
                left = [(x.reshape(-1, each).sum(axis=1, keepdims=True) - x.reshape(-1, each)).ravel()
                        for x in left]
                content, count, strength = left
            sets = np.repeat(np.arange(len(chosen)), slots)
            place = np.arange(total) - offset[sets]
            sig = mix(content + mix(seed[sets] + place.astype(np.uint64)))
            order = np.lexsort((sig, -count, -strength, sets))
            rank = np.empty(total, dtype=np.int64)
            rank[order] = place  # a set's signatures are contiguous before and after
            agreed = groups[chosen] - (k[chosen] // 2 if each > 1 else k[chosen])
            signed = rank < (slots - agreed + 1)[sets]
            out_sig.append(sig[signed])
            out_set.append(chosen[sets[signed]])
    if not out_sig:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out_sig), np.concatenate(out_set)


def parities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each set whether the number of its shingles in each of 64 * SKETCH slots is odd.

    As SKETCH words. Sets that differ in d shingles differ in at most d of the bits.
    """
    slots = 64 * SKETCH
    slot = (mix(hashes ^ np.uint64(0xA5A5)) % np.uint64(slots)).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(owner * slots + slot, minlength=len(sizes) * slots) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sizes), SKETCH)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_id, set_check, bits) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, sizes = shingle_sets(batch.column(1))
            ids, checks = _class_ids(hashes, sizes)
            bits = pa.FixedSizeListArray.from_arrays(
                pa.array(parities(hashes, sizes).ravel()), SKETCH).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes.astype(np.int64)),
                 pa.array(ids), pa.array(checks), bits],
                names=["doc_id", "text_hash", "n_shingles", "set_id", "set_check", "bits"])

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, "
                                "set_id bigint, set_check bigint, bits array<bigint>")


def _common(docs: DataFrame) -> np.ndarray:
    """Whether shingles of a slot, the hash modulo COMMON_SLOTS, are common.

    Each batch reports the shingles that COMMON_LEAST of its documents have; a slot is common
    if its reports hold a share of COMMON_SHARE of all documents. The table has a fixed size,
    and no more slots than that reach the driver, however long or many the texts are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, _ = shingle_sets(batch.column(1))
            found, n = np.unique(hashes, return_counts=True)
            often = n >= COMMON_LEAST
            slot = (found[often] % np.uint64(COMMON_SLOTS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(slot, -1)),
                 pa.array(np.append(n[often], batch.num_rows).astype(np.int64))], names=["slot", "n"])

    seen = docs.mapInArrow(run, "slot bigint, n bigint")
    counts = cut(seen.groupBy("slot").agg(F.sum("n").alias("n")), "common-shingles")
    rows = counts.filter("slot < 0").agg(F.sum("n")).first()[0] or 0
    found = counts.filter("slot >= 0").filter(F.col("n") >= COMMON_SHARE * rows).select("slot")
    table = np.zeros(COMMON_SLOTS, dtype=bool)
    table[found.toArrow().column(0).to_numpy()] = True
    return table


def _buckets(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(sig, set_id): members of every signature that several classes of sets share.

    Equal signatures of a batch meet before the shuffle: of those that several classes have
    there, one member goes to the signature's own key and the others, known to have company,
    to keys of their own. So a signature of very many sets is a few rows of one task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, sizes = shingle_sets(batch.column(1))
            ids, _ = _class_ids(hashes, sizes)
            sig, at = signatures(hashes, sizes, shared.value)
            sets = ids[at]
            order = np.lexsort((sets, sig))
            sig, sets = sig[order], sets[order]
            if not len(sig):
                continue
            new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (sets[1:] != sets[:-1])))
            sig, sets = sig[new], sets[new]
            first = np.concatenate(([True], sig[1:] != sig[:-1]))
            company = ~first | np.concatenate((~first[1:], [False]))
            key = np.where(first, sig, mix(sig + mix(sets.view(np.uint64))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(sig.view(np.int64), mask=first),
                 pa.array(sets), pa.array(np.ones(len(sig), dtype=bool), mask=~company)],
                names=["key", "sig", "set_id", "company"])

    rows = docs.mapInArrow(run, "key bigint, sig bigint, set_id bigint, company boolean")
    by_key = Window.partitionBy("key")
    met = rows.withColumn("low", F.min("set_id").over(by_key)).withColumn(
        "high", F.max("set_id").over(by_key)).withColumn(
        "any", F.max("company").over(by_key))
    return met.filter("low <> high or any").select(
        F.coalesce("sig", "key").alias("sig"), "set_id").distinct()


def _sketches(texts: DataFrame, side: str) -> DataFrame:
    """(side, n_side, side0, ...): set size and parity words of each class."""
    return texts.select(F.col("set_id").alias(side), F.col("n").alias(f"n_{side}"), *[
        F.col("bits")[k].alias(f"{side}{k}") for k in range(SKETCH)])


def _may_link() -> Column:
    """Whether sizes and parities of sets a and b leave a link open; they do for every link."""
    apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(SKETCH)),
                F.lit(0))
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return (least * 100 >= most * PERCENT) & (apart * 9 <= F.col("n_a") + F.col("n_b"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids whose texts are linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(pieces(batches, "text_a"), "text_b"):
            sides = []
            for column in (2, 3):  # a text of several pairs is hashed once
                texts = batch.column(column).dictionary_encode()
                hashes, sizes = shingle_sets(texts.dictionary)
                ends = np.cumsum(sizes)
                each = [hashes[e - n: e] for e, n in zip(ends, sizes, strict=True)]
                sides.append([each[k] for k in texts.indices.to_numpy()])
            linked = []
            for a, b in zip(*sides, strict=True):
                both = len(a) + len(b)
                near = min(len(a), len(b)) * 100 >= PERCENT * max(len(a), len(b))
                common = len(np.intersect1d(a, b, assume_unique=True)) if near else 0
                linked.append(near and 100 * common >= PERCENT * (both - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked))

    rows = (
        pairs.join(texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return rows.mapInArrow(run, "a bigint, b bigint")


def _compared(pairs: DataFrame, texts: DataFrame, edges: DataFrame | None,
              ) -> tuple[DataFrame | None, DataFrame | None]:
    """(links, roots) after the candidate pairs are verified; the links are one for each node."""
    found = cut(_verified(pairs, texts), "links")
    if found.isEmpty():
        return edges, None
    roots = cut(linked_roots(found if edges is None else edges.unionByName(found)), "roots")
    return roots.filter("node <> root").select(
        F.col("root").alias("a"), F.col("node").alias("b")), roots


def _pairs(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a before b, of those that may be linked."""
    return pairs.filter(_may_link()).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _class_roots(members: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(node, root) of the classes that links join, from the members of all buckets.

    First every class is compared with one other: the one with company in the most signatures
    of all that lead its buckets. The text that near copies were made from has it in all, so a
    group of copies is mostly joined by as many comparisons as it has members. Buckets with the same
    members as another, told by two hashes, are left out. Then, in each bucket
    that still has members of several components, leaders (one in the first round, then up
    to 64, 4096, ...) are compared with all members that are not yet in the leader's
    component, and leave; buckets go on until all their members are in one component or have
    led. So every candidate pair is either compared or already connected: no link is lost.
    """
    shared = cut(members.groupBy("sig").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set_id")).alias("x"),
        F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("y")), "bucket-sizes")
    # of buckets with the same members, as those of a shared passage, one does for all
    one = shared.groupBy("n", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    # the text that near copies were made from has company in most of its signatures
    weights = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("weight"))
    members = members.join(one, "sig", "left_semi")
    members = cut(members.join(weights, "set_id").select("sig", "set_id", "weight"), "weighted")
    edges = roots = None
    first = members.groupBy("sig").agg(F.max(F.struct("weight", "set_id")).alias("lead"))
    best = members.join(first, "sig").filter("set_id <> lead.set_id").groupBy("set_id").agg(
        F.max("lead").alias("lead"))
    best = best.select(F.col("set_id").alias("a"), F.col("lead.set_id").alias("b"))
    edges, fresh = _compared(_pairs(best.join(_sketches(texts, "a"), "a").join(
        _sketches(texts, "b"), "b")), texts, edges)
    roots = fresh if fresh is not None else roots
    turn = 1
    while True:
        placed = members.withColumn("comp", F.col("set_id")) if roots is None else (
            members.join(roots, members["set_id"] == roots["node"], "left")
            .select("sig", "set_id", "weight", F.coalesce("root", "set_id").alias("comp")))
        open_ = placed.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
        open_ = open_.filter("c0 <> c1").select("sig")
        members = cut(placed.join(open_, "sig"), "open-buckets")
        if members.isEmpty():
            return roots
        # sizes and parities decide inside the join: what they rule out is no row anywhere
        wide = members.withColumnRenamed("set_id", "a").join(_sketches(texts, "a"), "a")
        known = [c for c in wide.columns if c not in ("sig", "weight")]
        leaders = wide.groupBy("sig", F.pmod(F.xxhash64("a"), F.lit(turn)).alias("s")).agg(
            F.max(F.struct("weight", *known)).alias("lead"))
        leaders = leaders.select("sig", *[F.col(f"lead.{c}").alias(
            {"a": "b", "n_a": "n_b", "comp": "lead_comp"}.get(c, f"b{c[1:]}")) for c in known])
        pairs = _pairs(wide.join(leaders, "sig").filter("comp <> lead_comp"))
        members = members.select("sig", "set_id", "weight").join(
            leaders.select("sig", F.col("b").alias("set_id")), ["sig", "set_id"], "left_anti")
        edges, fresh = _compared(pairs, texts, edges)
        roots = fresh if fresh is not None else roots
        turn *= 64


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_id, set_check, root, component_id) of every row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(
        F.col(text_col), F.lit("")).alias("text"))
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    sets = cut(_rows(hashed), "sets")  # later readers skip the bits
    classes = cut(sets.filter("n_shingles > 0").groupBy("set_id", "set_check").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.min("doc_id").alias("least"),
        F.min("n_shingles").alias("n"), F.min("bits").alias("bits")), "classes")
    members = cut(_buckets(rows.filter("text <> ''"), _common(rows)), "buckets")
    wanted = classes.join(members.select("set_id").distinct(), "set_id").select(
        "set_id", "n", "bits", F.col("rep.doc_id").alias("w_id"),
        F.col("rep.text_hash").alias("w_hash"))
    texts = cut(hashed.join(
        wanted, hashed["doc_id"].eqNullSafe(wanted["w_id"]) & (F.col("text_hash") == F.col("w_hash"))
    ).select("set_id", "n", "bits", "text").dropDuplicates(["set_id"]), "class-texts")
    roots = _class_roots(members, texts)
    if roots is None:
        named = classes.select("set_id", "set_check", F.col("set_id").alias("root"),
                               F.col("least").alias("component_id"))
    else:
        named = classes.join(roots, classes["set_id"] == roots["node"], "left").withColumn(
            "root", F.coalesce("root", "set_id"))
        lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
        named = named.join(lowest, "root").select("set_id", "set_check", "root", "component_id")
    return sets.drop("bits").join(named, ["set_id", "set_check"], "left")


def similar_components(docs: DataFrame, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) of every row.

    Rows of equal shingle sets form a class, which is compared once. Classes that share a
    signature are candidates; `_class_roots` compares them. component_id is the smallest
    doc_id that links reach, the own one included. Rows with no words link with nothing. Null
    ids are no component's id unless it has no other. Shingles are compared by 64-bit hashes.
    Texts are shuffled once to fetch one text of each class with company, then only those
    texts move.
    """
    found = _components(docs, id_col, text_col)
    return found.select(
        "doc_id", "text_hash", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        .alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, of each component one: the row with the smallest id.

    Rows without an id come last, then the text hash decides; of rows equal in id and text
    one stays, whichever. Rows without words are no component's and all stay. Other columns
    stay, whatever their names.
    """
    own_id, own_hash = unused_names(docs, "id", "hash")
    found = cut(_components(docs, id_col, text_col).filter("n_shingles > 0").select(
        "doc_id", "text_hash", "set_check", F.coalesce("root", "set_id").alias("root")), "placed")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    best = found.groupBy("root").agg(F.min(order).alias("best"))
    keys = found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    judged = cut(keys.join(best, "root").select(
        F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash),
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
         & (F.col("text_hash") == F.col("best.text_hash"))).alias("stays"), "n"), "judged")
    own = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))

    def same(other: DataFrame) -> Column:
        return docs[id_col].eqNullSafe(other[own_id]) & (own == other[own_hash])

    gone = judged.filter("not stays or n > 1").select(own_id, own_hash)
    left = docs.join(gone, same(gone), "left_anti")
    again = judged.filter("stays and n > 1").select(own_id, own_hash)
    # only rows that are there several times move once more
    copies = docs.join(again, same(again)).dropDuplicates([own_id, own_hash]).select(*docs.columns)
    return left.unionByName(copies)
