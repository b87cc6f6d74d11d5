"""Streaming dedup, PartEnum join, cover anchors, template lines: against brute force."""

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import corpus, edge_rows, frame, lower, prose, words  # noqa: E402

from hostlens.llm import partenum  # noqa: E402
from hostlens.llm.common import CHUNK, lower_az, window_hashes, word_hashes  # noqa: E402
from hostlens.llm.cover_anchors import COVERS, remove_repeats  # noqa: E402
from hostlens.llm.linked import linked_roots  # noqa: E402
from hostlens.llm.partenum import one_of_each, similar_components  # noqa: E402
from hostlens.llm.streaming_dedup import StreamingDedup, streaming_dedup  # noqa: E402
from hostlens.llm.template_lines import drop_recurring_lines  # noqa: E402


def test_words_are_hashed_alike_wherever_they_lie():
    rng = random.Random(1)
    texts = [prose(rng, n, 50) for n in (0, 1, 7, 500)] + ["x" * (CHUNK + 9), None, " a\x0bB  c "]
    texts.append(" ".join(["long"] * (CHUNK // 4)))
    hashes, counts = word_hashes(pa.array(texts), fold=False)
    assert counts.tolist() == [len(words(t)) for t in texts]
    by_word = defaultdict(set)
    for h, w in zip(hashes.tolist(), [w for t in texts for w in words(t)], strict=True):
        by_word[w].add(h)
    assert all(len(x) == 1 for x in by_word.values())
    assert len({h for x in by_word.values() for h in x}) == len(by_word)
    assert len(window_hashes(hashes[:3], 5)) == 0


def _exact(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter(
        (i, best[lower(t)], len(groups[lower(t)])) for i, t, _ in rows), len(groups)


@pytest.mark.parametrize("bits", [None, 1])
def test_streaming_dedup_keeps_state_between_batches(spark, tmp_path, bits):
    rows = edge_rows() + [(100 + i, t, s) for i, t, s in corpus()]
    path, schema = str(tmp_path / "docs"), frame(spark, rows[:1]).schema
    options = {} if bits is None else {
        # a digest of two values: every hit is told apart by its bytes
        "digest": lambda t: F.substring(F.hex(F.crc32(lower_az(t))), -1, 1).cast("string")}
    job = StreamingDedup(spark, path, str(tmp_path / "state"), schema, files_per_batch=1, **options)
    for part in (rows[:20], rows[20:45], rows[45:]):
        frame(spark, part).coalesce(2).write.mode("append").parquet(path)
        job.advance()
    got = job.decisions().collect()
    want, groups = _exact(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == groups
    if bits is None:
        assert {r["digest"] for r in got} == {
            hashlib.sha256(lower(t).encode()).hexdigest() for _, t, _ in rows}


def test_streaming_dedup_of_an_empty_table(spark, tmp_path):
    frame(spark, edge_rows()).limit(0).write.parquet(str(tmp_path / "none"))
    assert streaming_dedup(spark, str(tmp_path / "none")).count() == 0


def _components(rows):
    sets = []
    for _, t, _ in rows:
        w = words(lower(t))
        sets.append({" ".join(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5
                    else {" ".join(w)} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        low.setdefault(find(k), []).append(i)
    return Counter((i, len(s), min((x for x in low[find(k)] if x is not None), default=None))
                   for k, ((i, _, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("seed", [0, 1])
def test_partenum_join_finds_every_link(spark, seed):
    rows = edge_rows() + [(100 + i, t, s) for i, t, s in corpus(seed, 80)]
    got = similar_components(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == _components(rows)
    kept = one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    stays = {(i, t) for (i, _, c), t in zip(
        [(r["doc_id"], 0, r["component_id"]) for r in got], [0] * len(got), strict=True)
        if i is None or i == c}
    assert {(r["doc_id"], 0) for r in kept.collect()} == stays


def test_partenum_signatures_meet_at_every_size():
    """Sets at the bound of similarity share a signature, whatever is taken for common."""
    rng = np.random.default_rng(2)
    for n in [*range(1, 40), *range(55, 75), 99, 128, 500, 2311]:
        for _ in range(6):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            drop = rng.integers(0, n // 5 + 1)
            add = rng.integers(0, max(1, n // 4 - drop + 1))
            b = np.append(a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64))
            both = n - drop
            if 100 * both < 80 * (n + add):
                continue
            common = np.zeros(partenum.COMMON_SLOTS, dtype=bool)
            common[rng.choice(a, n // 3, replace=False) % np.uint64(partenum.COMMON_SLOTS)] = True
            sig, at = partenum.signatures(
                np.concatenate((np.sort(a), np.sort(b))), np.array([len(a), len(b)]), common)
            assert set(sig[at == 0].tolist()) & set(sig[at == 1].tolist()), (n, drop, add)


def test_signatures_are_subsets_of_two_parts():
    """A set of one shingle in a large band has it in just the subsets that hold its part."""
    groups, parts = partenum.band_layout(np.array([63, 64, 900]))
    assert parts.tolist() == [1, 3, 3] and groups.tolist() == [30, 10, 122]
    a = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64))
    sig, _ = partenum.signatures(a, np.array([500]), np.zeros(0, dtype=bool))
    assert len(sig) == len(set(sig.tolist()))
    # a shingle more changes two of the three subsets of one group of each band
    more = np.sort(np.append(a, np.uint64(12345)))
    both, at = partenum.signatures(np.append(a, more), np.array([500, 501]), np.zeros(0, dtype=bool))
    shared = set(both[at == 0].tolist()) & set(both[at == 1].tolist())
    assert len(shared) >= (at == 0).sum() - 12


def test_parities_differ_no_more_than_sets():
    rng = np.random.default_rng(3)
    for n in (1, 5, 80, 700):
        for _ in range(20):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.append(a[rng.integers(0, n):], rng.integers(0, 1 << 63, 7, dtype=np.uint64))
            sets = [np.unique(a), np.unique(b)]
            bits = partenum.parities(np.concatenate(sets), np.array([len(x) for x in sets]))
            apart = int(np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(*sets))
            assert (partenum.parities(sets[0], np.array([len(sets[0])]))[0] == bits[0]).all()


def test_one_row_of_each_component_stays(spark):
    """Null and repeated ids, rows equal in all, and columns with any name."""
    rng = random.Random(4)
    text, other = prose(rng, 60), prose(rng, 50)
    rows = [(None, text, "a"), (None, text, "b"), (7, text, "c"), (7, text, "d"),
            (9, text + " end", "e"), (None, other, "f"), (None, other + " x", "g"),
            (None, other, "f"), (3, "", "h"), (3, "", "h"), (None, None, "i"), (4, None, "j"),
            (11, prose(rng, 40), "k")]
    docs = frame(spark, rows).withColumns({n: F.lit(n) for n in (
        "_id", "_hash", "id", "hash", "root", "set_id", "stays", "n")})
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"], r["source"]) for r in kept.collect()]
    assert sorted(str(f) for f in found if f[2] in "hijk") == sorted(
        str(r) for r in rows if r[2] in "hijk")
    groups = [f for f in found if f[1] and f[1].startswith((text, other))]
    assert len(groups) == 2 and {f[0] for f in groups} == {7, None}
    assert all(r["_hash"] == "_hash" and r["n"] == "n" for r in kept.collect())


def test_a_group_of_near_copies_takes_few_comparisons(spark, monkeypatch):
    """Copies of one text that are similar to it but not to each other."""
    rng = random.Random(6)
    base = prose(rng, 300, 5000).split(" ")
    rows = [(0, " ".join(base), "a")]
    for k in range(1, 150):
        copy = list(base)
        for at in rng.sample(range(300), 6):
            copy[at] = f"edit{k}at{at}"
        rows.append((k, " ".join(copy), "a"))
    compared = []
    plain = partenum._verified
    monkeypatch.setattr(partenum, "_verified", lambda pairs, texts: compared.append(
        pairs.count()) or plain(pairs, texts))
    got = similar_components(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == _components(rows)
    assert compared[0] <= len(rows) and sum(compared) < 3 * len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_linked_roots_are_the_smallest_reachable(spark, seed):
    rng = random.Random(seed)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)]
    links += [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(-5, 60), (7, 7)]
    rng.shuffle(links)
    names = {x for a, b in links if a != b for x in (a, b)}
    names = sorted(names)
    new = dict(zip(names, rng.sample(range(-10**6, 10**6), len(names)), strict=True))
    links = [(new.get(a, 0), new.get(b, 0)) for a, b in links]
    root = {x: x for x in new.values()}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = linked_roots(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()
    assert len(got) == len(root) and all(r["root"] == find(r["node"]) for r in got)
    assert linked_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_partenum_of_an_empty_table(spark):
    assert similar_components(frame(spark, edge_rows()).limit(0)).count() == 0
    assert one_of_each(frame(spark, edge_rows()).limit(0)).count() == 0


def _without_repeats(rows, size=13):
    first = {}
    for i, t, _ in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            first[key] = min(first.get(key, float("inf")), float("inf") if i is None else i)
    out = Counter()
    for i, t, _ in rows:
        w, gone = words(t), set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < (float("inf") if i is None else i):
                gone.update(range(k, k + size))
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


@pytest.mark.parametrize("seed", [0, 4])
def test_cover_anchors_remove_what_brute_force_removes(spark, seed):
    rows = edge_rows() + [(100 + i, t, s) for i, t, s in corpus(seed, 80)]
    got = remove_repeats(frame(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == _without_repeats(rows)
    assert remove_repeats(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("top", [[0], [0, 1, 5]])
def test_the_largest_id_is_no_missing_one(spark, top):
    """Rows with the last ids of the range, and rows without any, keep theirs and their order."""
    last = (1 << 63) - 1
    rng = random.Random(2)
    shared = prose(rng, 40, 3000)
    rows = [(last - k, f"{prose(rng, 3, 3000)} {shared}", "a") for k in top]
    rows += [(None, f"{prose(rng, 2, 3000)} {shared}", "a"), (None, "a b", "c"),
             (-last - 1, prose(rng, 20, 3000), "b"), (last - 3, f"x {shared} y", "a")]
    got = remove_repeats(frame(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == _without_repeats(rows)
    assert sum(r["n_removed"] > 0 for r in got) == len(top) + 1


def test_covers_are_difference_covers():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_recurring_templates_go_and_copies_stay(spark):
    rng = random.Random(7)
    rows = []

    def plain(n):  # words without digits, which would be fields
        return prose(rng, n, 5000).translate(str.maketrans("0123456789", "abcdefghij"))

    for i in range(30):
        rows.append((i, "\n".join([plain(40), f"Copyright of this text is held by owner{i} until {1990 + i}",
                                   "All rights are reserved here", plain(30)]), "a"))
    copied = "\n".join(plain(15) for _ in range(4))
    rows += [(100 + i, copied, "b") for i in range(40)]
    near = [copied.split(" ") for _ in range(40)]
    for k, parts in enumerate(near):
        parts[5 + k % 40] = "changed"
        rows.append((200 + k, " ".join(parts), "b"))
    rows += [(300, None, "c"), (301, "", "c"), (302, "All rights are reserved here", None),
             (302, "All rights are reserved here", None)]
    docs = frame(spark, rows)
    got = drop_recurring_lines(docs)
    assert got.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_dropped"]
    assert got.count() == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got.collect():
        if r["doc_id"] < 30:
            assert r["text"].split("\n") == [texts[r["doc_id"]].split("\n")[k] for k in (0, 3)]
            assert (r["n_lines"], r["n_dropped"]) == (4, 2)
        elif r["doc_id"] == 302:
            assert r["text"] == ""
        else:
            assert r["text"] == texts[r["doc_id"]] and r["n_dropped"] == 0
    assert drop_recurring_lines(docs.limit(0)).count() == 0


def _plain(rng, n):
    """Words without digits, which would be fields."""
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


def test_copies_never_keep_a_recurring_line(spark):
    """A footer of unrelated documents goes, however many near copies one of them has."""
    rng, footer = random.Random(8), "Please read our terms of use before writing"
    bodies = [[_plain(rng, 40), _plain(rng, 40)] for _ in range(40)]
    for k in range(400):
        parts = bodies[0][k % 2].split(" ")
        parts[10 + k % 25] = f"edit{k}"
        bodies.append([" ".join(parts), bodies[0][1 - k % 2]])
    rows = [(i, "\n".join([*b, footer]), "a") for i, b in enumerate(bodies)]
    for r in drop_recurring_lines(frame(spark, rows)).collect():
        left = r["text"].split("\n") if r["text"] else []  # a text may lose all its lines
        assert footer not in left and set(left) <= set(bodies[r["doc_id"]])
        assert not 0 < r["doc_id"] < 40 or left == bodies[r["doc_id"]]


def test_short_blank_free_and_numbered_lines_go(spark):
    """Lines of one or two tokens, of scripts without blanks, and templates mostly of fields."""
    rng, rows = random.Random(9), []
    for i in range(25):
        rows.append((i, "\n".join([
            _plain(rng, 40), "Read more", "Subscribe", "\u7248\u6743\u6240\u6709", f"\u7b2c{i}\u9875", "",
            f"Page {i} of {i + 10}", f"Error code {i}", f"{i} {i * 7} {i + 5}",
            f"2024-01-{i + 1} 10:00:{i} {i * 3} INFO started", _plain(rng, 30)]), "a"))
    texts = {i: t.split("\n") for i, t, _ in rows}
    for r in drop_recurring_lines(frame(spark, rows)).collect():
        assert r["text"].split("\n") == [texts[r["doc_id"]][k] for k in (0, 5, 8, 10)]


def test_templates_of_log_like_documents_recur(spark):
    """One-line documents, documents of numbered lines, and short bodies under long boilerplate."""
    rng = random.Random(10)
    licence = [f"Clause {'abcdefghijklmnopqrst'[k]} {_plain(rng, 12)}" for k in range(20)]
    texts = [f"Connection to host{i} closed after {i} seconds" for i in range(25)]
    texts += ["\n".join(f"{i}:{k} {i * 31 + k} INFO worker started" for k in range(5)) for i in range(25)]
    bodies = [_plain(rng, 17) for _ in range(1000)]
    texts += ["\n".join([b, *licence]) for b in bodies]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    for r in drop_recurring_lines(frame(spark, rows)).collect():
        assert r["text"] == ("" if r["doc_id"] < 50 else bodies[r["doc_id"] - 50]), r["doc_id"]


FREE = "[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]"


def _brute_lines(rows, least=10):
    """Texts without their recurring lines, by the rules of `recurring_lines`."""
    def key(x):
        return hashlib.md5(x.encode()).hexdigest()[:16]

    def tokens(line):
        return re.sub(f"([0-9])({FREE})", r"\1 \2", re.sub(f"({FREE})([0-9])", r"\1 \2", line)).split(" ")

    def chunk(line):
        return min(map(key, re.findall("[^ ]+(?: +[^ ]+){0,3}", line)))

    def leaf(line):
        t = tokens(line)
        return len(t), tuple("<*>" if re.search("[0-9]", x) else x for x in t[:3])

    lines = []
    for at, (_, text, _) in enumerate(rows):
        own = [x for x in (text or "").split("\n") if re.search(r"[^ \t\n\x0b\f\r]", x)]
        for k, line in enumerate((text or "").split("\n")):
            if line in own:
                others = [chunk(x) for x in own if (chunk(x), x) != (chunk(line), line)]
                top = min((chunk(x), x) for x in own)
                family = min(others, default=key(text)) if line == top[1] else top[0]
                lines.append((at, k, line, leaf(line), family))

    def many(pairs):
        found = defaultdict(set)
        for k, family in pairs:
            found[k].add(family)
        return {k for k, families in found.items() if len(families) >= least}

    leaves = many((x, f) for *_, x, f in lines)
    lines = [x for x in lines if x[3] in leaves]
    same = many((x, f) for _, _, x, _, f in lines)
    varied = [x for x in lines if x[2] not in same]
    constant = many(((lf, i, t), f) for _, _, x, lf, f in varied for i, t in enumerate(tokens(x))
                    if not re.search("[0-9]", t))

    def template(line, lf):
        t = tokens(line)
        shape = tuple(x if (lf, i, x) in constant else None for i, x in enumerate(t))
        fixed = sum(x is not None for x in shape)
        words = sum(not re.search("[0-9]", x) or any(c.isalpha() for c in x) for x in t)
        return shape if 4 * fixed >= 3 * words and 5 * fixed >= 2 * len(t) else None

    shapes = [(at, k, template(x, lf), f) for at, k, x, lf, f in varied]
    often = many((s, f) for _, _, s, f in shapes if s is not None)
    gone = {(at, k) for at, k, s, _ in shapes if s in often}
    gone |= {(at, k) for at, k, x, _, _ in lines if x in same}
    return [None if text is None else "\n".join(
        x for k, x in enumerate(text.split("\n")) if (at, k) not in gone)
        for at, (_, text, _) in enumerate(rows)]


@pytest.mark.parametrize("seed", range(3))
def test_recurring_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    shapes = ["Page {n} of {n}", "the {w} of the {w} and the", "code {c} {c} {c}", "see {w}{n}",
              "a {w} b {w} c d e f g", "第{n}页 {w}", "total {n} {n}", "x", "{n}", "{c}"]

    def fill(shape):
        return re.sub(r"\{(.)\}", lambda m: {
            "n": str(rng.randint(0, 99)), "w": rng.choice("pqrstuv"),
            "c": f"{rng.choice('kmn')}{rng.randint(1, 9)}"}[m.group(1)], shape)

    rows = []
    for i in range(2000, 2120):
        body = [_plain(rng, rng.randint(1, 8)) for _ in range(rng.randint(0, 2))]
        text = body + [fill(rng.choice(shapes)) for _ in range(rng.randint(0, 5))]
        rng.shuffle(text)
        rows.append((i, "\n".join(text), "a"))
    rows += [(3000 + i, rows[7][1], "b") for i in range(20)]
    rows += [r for r in edge_rows() if r[0] not in (5, None)]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"])
           for r in drop_recurring_lines(frame(spark, rows)).collect()}
    want = _brute_lines(rows)
    assert any(t != w for (_, t, _), w in zip(rows, want, strict=True))
    for (i, text, _), left in zip(rows, want, strict=True):
        assert got[i][0] == left, (i, text)
        assert got[i][1] == (0 if text is None else text.count("\n") + 1)


def test_documents_of_numbers_and_codes_stay(spark):
    """Lines never go by the pattern of their numbers or codes."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randint(0, 399)}" for _ in range(40)) for _ in range(60)]
    texts += [" ".join(f"the wo{rng.randint(0, 99)}" for _ in range(12)) for _ in range(60)]
    texts += [" ".join(f"{rng.choice('abcdefgh')}{rng.randint(1, 8)}" for _ in range(30))
              for _ in range(60)]
    texts += [" ".join(f"{rng.randrange(256):02x}" for _ in range(16)) for _ in range(60)]
    texts += [f"ABC-{rng.randint(1000, 9999)}-{i}" for i in range(60)]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    for r in drop_recurring_lines(frame(spark, rows)).collect():
        assert r["text"] == texts[r["doc_id"]] and r["n_dropped"] == 0


def test_a_template_needs_its_shares_of_constants(spark):
    """At SIMILAR and CONSTANT a template goes, just under them it stays."""
    rng = random.Random(12)

    def rows(shape, n=20):
        return [(k, "\n".join([_plain(rng, 30), shape.format(
            w=_plain(rng, 1), v=_plain(rng, 1), n=rng.randint(10, 99))]), "a") for k in range(n)]

    for shape, goes in [("a b c {w}", True), ("a b c {w} {v}", False), ("a b {n} {n} {n}", True),
                        ("a b {n} {n} {n} {n}", False), ("a b c x{n}", True), ("a b x{n}", False)]:
        docs = rows(shape)
        left = [r["n_dropped"] for r in drop_recurring_lines(frame(spark, docs)).collect()]
        assert left == [int(goes)] * len(docs), shape


def test_very_long_lines_and_clashing_names(spark):
    rng = random.Random(13)
    long = " ".join(rng.choices("abcdefgh", k=1_000_000))
    many = "\n".join(["same footer line here", *(str(k) for k in range(20_000))] * 2)
    rows = [(1, long, "a"), (2, many, "b")] + [(10 + k, f"{_plain(rng, 20)}\nsame footer line here", "c")
                                               for k in range(12)]
    docs = frame(spark, rows).withColumns({n: F.lit(n) for n in (
        "_id", "_hash", "_gone", "id", "hash", "gone", "lines", "leaf", "at", "family", "template")})
    got = {r["doc_id"]: r for r in drop_recurring_lines(docs).collect()}
    assert got[1]["text"] == long and got[2]["n_dropped"] == 2 and got[10]["gone"] == "gone"
    assert got[2]["text"] == many.replace("same footer line here\n", "") and got[10]["n_dropped"] == 1
