"""Centroid search, divergence of sources, language ID."""

import hashlib
import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import corpus, edge_rows, lower, prose  # noqa: E402

from hostlens.llm import kernel_langid as langid  # noqa: E402
from hostlens.llm import source_divergence as divergence  # noqa: E402
from hostlens.llm.centroid_search import LIMIT, CentroidSearch, cluster_vectors  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, cluster string, codes string, distance string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], VECTORS).repartition(3)


def brute_clusters(rows, k, rounds, size):
    kept = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if v is not None
            and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept
                   if i is not None)
    centroids = [v for _, v in drawn[:k]]
    if not centroids:
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n)
                   for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        centroids = [tuple(sum(x) // len(members[n]) for x in zip(*members[n], strict=True))
                     if members[n] else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in found:
        inertia[n] += d
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(
        ",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found), key=str)


def test_clusters_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [float(np.float32(rng.gauss(i % 5, 1))) for _ in range(6)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 400)]  # a very frequent vector
    rows += [(5, rows[5][1]), (None, rows[7][1]), (None, None), (401, []), (402, [1.0] * 5),
             (403, [1.0] * 5 + [None]), (404, [float("nan")] * 6), (405, [float("inf")] + [0.0] * 5),
             (406, [-1e-9, 0.0, -0.0, 0.5, -0.5, 1.0])]
    for k, rounds in [(16, 3), (1, 2), (40, 1), (1000, 2)]:
        got = cluster_vectors(vectors(spark, rows), k=k, rounds=rounds, size=6).collect()
        assert sorted(map(tuple, got), key=str) == brute_clusters(rows, k, rounds, 6)
    assert cluster_vectors(vectors(spark, rows).limit(0), size=6).count() == 0
    alone = cluster_vectors(vectors(spark, [(None, [1.0] * 6)]), size=6)
    assert alone.count() == 0 and len(alone.columns) == 6


def test_huge_components_stay_defined(spark):
    big = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]
    got = {r["vec_id"]: r for r in cluster_vectors(vectors(spark, big), k=1, rounds=0).collect()}
    assert {r["distance"] for r in got.values()} <= {0, 64 * LIMIT ** 2, 64 * (2 * LIMIT) ** 2}
    assert len(got) == 3


@pytest.mark.parametrize("seed", range(3))
def test_pruned_search_is_exact_and_prunes(seed):
    rng = np.random.default_rng(seed)
    centroids = rng.integers(-3, 3, (200, 8)) + rng.integers(-40, 40, (200, 1))
    rows = rng.integers(-3, 3, (3000, 8)) + rng.integers(-50, 50, (3000, 1))
    centroids[50] = centroids[10]  # ties go to the smaller number
    search = CentroidSearch(centroids)
    found, distance = search.nearest(rows)
    every = ((rows[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (found == every.argmin(axis=1)).all()
    assert search.compared < 0.2 * every.size
    wide = CentroidSearch(centroids * (LIMIT // 64))
    found, distance = wide.nearest(rows[:500] * (LIMIT // 64))
    assert (found == every[:500].argmin(axis=1)).all()
    assert (distance == every[:500].min(axis=1) * (LIMIT // 64) ** 2).all()


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute_divergence(rows, least=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(lower(text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = [s for k, s in groups if k == lang]

        def share(n, total):
            return 1 + 10 ** 9 * (n + 1) // (total + len(kept))

        def of(c):
            total = sum(c[t] for t in kept)
            return {t: share(c[t], total) for t in kept}

        p = {s: of(counts[lang, s]) for s in mine}
        whole = of(sum((counts[lang, s] for s in mine), Counter()))
        own = p[source]
        parts = {"pair": [(-sum((own[t] - p[s][t]) ** 2 // p[s][t] for t in kept), s.encode(), s)
                          for s in mine if s != source],
                 "term": [(-((own[t] - whole[t]) ** 2 // whole[t]), t.encode(), t) for t in kept
                          if counts[lang, source][t] and own[t] > whole[t]]}
        for part, found in parts.items():
            for rank, (value, _, item) in enumerate(sorted(found), 1):
                if part == "pair" or rank <= top:
                    out.append((lang, source, part, item, -value, rank))
    return sorted(out)


def sources(spark, rows):
    return spark.createDataFrame(
        [(t, k, s, "x", 1) for t, k, s in rows],
        "text string, lang string, source string, term string, n int").repartition(4)


@pytest.mark.parametrize("entries,cells", [(200_000, 1 << 21), (40, 300)])
def test_divergence_equals_brute_force(spark, monkeypatch, entries, cells):
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "BLOCK_ENTRIES", entries)
    rng = random.Random(1)
    names = ["a", "b", "c", None, "Ü", "B"]
    rows = [("".join(c if c != "3" else "é" for c in t.replace("w", " ").translate(
        str.maketrans("012456789", "abcdEfgHi"))), rng.choice(["en", "de", None]),
        rng.choice(names)) for _, t, _ in corpus(4, 250)]
    rows += [("hot term " * 30, "en", "a")] * 40  # copies in one group
    rows += [(t, "fr", "x" * ((i or 0) % 2)) for i, t, _ in edge_rows()]
    rows += [(None, "empty", "a"), ("", "empty", "b"), ("one two", "lone", "a"),
             (None, None, None), ("rare once", "few", "a"), ("other", "few", "b")]
    got = sorted(map(tuple, divergence.source_divergence(sources(spark, rows)).collect()))
    assert got == brute_divergence(rows)
    assert divergence.source_divergence(sources(spark, rows).limit(0)).count() == 0


def test_divergence_keeps_the_top_terms_only(spark):
    rows = [(" ".join("t" + chr(97 + i) + chr(97 + j) for i in range(6) for j in range(5)),
             "en", "a")] * 3 + [("u v w " * 3, "en", "b")] * 3
    got = divergence.source_divergence(sources(spark, rows), top=7).collect()
    assert sorted(map(tuple, got)) == brute_divergence(rows, top=7)
    plan = divergence.source_divergence(sources(spark, rows))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_divergence_shuffles_terms_as_tasks_counted_them(spark):
    # a task's terms are added up already; Spark hashed all of them once more before the shuffle
    counts = divergence._term_counts(sources(spark, [("a b", "en", "x")]))
    below = counts._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)[1]
    assert "MapInArrow" in below and "Aggregate" not in below


@pytest.mark.parametrize("entries", [3_000, 30_000])
def test_divergence_adds_up_the_terms_of_many_batches(spark, monkeypatch, entries):
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    rng = random.Random(2)
    names = ["".join(rng.choice("abcdé") for _ in range(6)) for _ in range(2_000)]
    rows = [("\x00".join(rng.choices(names, k=1_500)), "en", rng.choice("xyz")) for _ in range(300)]
    rows += [("\U0001f600\x7f" + "Z" * 1_300_000 + " tail", "en", "x"), ("", "en", "none")]
    got = divergence.source_divergence(sources(spark, rows).coalesce(1)).collect()
    assert sorted(map(tuple, got)) == brute_divergence(rows)


def test_divergence_shares_are_exact_beyond_64_bits(spark):
    most = divergence.MOST
    rows = [(n, total, 7) for n in (0, 5, most - 1, most, most + 1, 10 ** 15)
            for total in (n, 3 * n + 1)] + [(4, 0, 0), (most, 0, 0)]
    got = spark.createDataFrame(rows, "n long, total long, v long").select(
        "n", "total", "v", divergence._share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    for n, total, v, p in got.collect():
        assert p == (1 + 10 ** 9 * (n + 1) // (total + v) if total + v else None)


def _speech(rng, lang, n):
    endings = {"xx": ["ung", "heit", "chen"], "yy": ["ción", "ado", "mente"], "zz": ["eau", "aux"]}
    return " ".join("".join(rng.choice("abdegiklmnorst") for _ in range(rng.randint(1, 4)))
                    + rng.choice(endings[lang]) for _ in range(n))


def _languages(spark, n=300):
    rng = random.Random(3)
    rows = [(i, _speech(rng, lang, rng.randint(1, 60)), lang) for i in range(n)
            for lang in [rng.choice(["xx", "yy", "zz"])]]
    rows += [(i, rows[0][1], rows[0][2]) for i in range(n, n + 60)]  # a group of copies
    return rows, spark.createDataFrame(
        [(i, t, k, "p", "q") for i, t, k in rows],
        "doc_id long, text string, lang string, lang_pred string, place string").repartition(3)


def test_languages_are_told_on_rows_held_out(spark):
    rows, docs = _languages(spark)
    model = langid.fit_languages(docs.filter(~langid.kept_back(F.col("doc_id"))), landmarks=30)
    assert model.languages == ["xx", "yy", "zz"] and model.landmarks.shape[1] <= 30
    found = langid.predict_languages(docs, model).collect()
    held = [r for r in found if _crc(r["doc_id"]) % 4 == 2]
    assert len(held) > 40 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["lang_score"] <= 1 for r in found)
    assert found[0]["place"] == "q" and set(docs.columns) <= set(found[0].asDict())
    again = langid.fit_languages(docs.filter(~langid.kept_back(F.col("doc_id"))), landmarks=30)
    assert (again.weights == model.weights).all()  # the same sample, whatever the partitions


def _crc(i):
    import zlib

    return zlib.crc32(str(i).encode())


def test_language_edges(spark):
    rows, docs = _languages(spark)
    model = langid.fit_languages(docs)
    long = _speech(random.Random(1), "yy", 200_000)
    tests = [(1, None), (2, ""), (3, "12 34 !!"), (4, "\n\t"), (5, long), (None, "chung"),
             (5, long), (6, "中文"), (7, "𝒳 𐐀"), (8, "ung" * 300_000), (9, "x\x00ung")]
    frame = spark.createDataFrame(tests, "doc_id long, text string").repartition(3)
    got = langid.predict_languages(frame, model).collect()
    assert len(got) == len(tests)
    by = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in got}
    assert by[1] == by[2] == by[3] == by[4] == ("und", 0.0)
    assert by[5][0] == "yy" and by[8][0] == "xx" and by[6][0] != "und" and by[7][0] != "und"
    assert langid.predict_languages(frame.limit(0), model).count() == 0
    none = langid.fit_languages(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict_languages(frame, none).collect()} == {"und"}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.fit_languages(unlabelled).languages == []
    one = langid.fit_languages(docs.withColumn("lang", F.lit("")))
    assert {r["lang_pred"] for r in langid.predict_languages(frame.filter("doc_id = 5"), one).collect()} == {""}


def test_kernel_counts_shared_grams():
    texts = ["Die Zeitung, 12 Lied", "die   lied", "été à la mer", "x", "", "a" * 50]

    def grams(text):
        points = langid.letter_points(text).tolist()
        return {tuple(points[k: k + n]) for n in langid.ORDERS for k in range(len(points) - n + 1)}

    assert grams("Ab1-c") == grams("ab c") == {
        *[(x,) for x in (0, 97, 98, 99)], (0, 97), (97, 98), (98, 0), (0, 99), (99, 0),
        (0, 97, 98), (97, 98, 0), (98, 0, 99), (0, 99, 0), (0, 97, 98, 0), (97, 98, 0, 99), (98, 0, 99, 0)}
    marks, lettered = langid.presence(texts)
    assert lettered.tolist() == [True, True, True, True, False, True]
    model = langid.KernelModel(["k"], np.flatnonzero(marks.any(axis=0)),
                               marks[:, marks.any(axis=0)].T.astype(np.float32),
                               marks.sum(axis=1, dtype=np.int64).astype(float), np.zeros((6, 1)))
    sets = [grams(t) for t in texts]
    want = [[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    assert np.allclose(model.kernel(marks), want, atol=1e-6)


def test_long_texts_are_read_in_parts(monkeypatch):
    text = prose(random.Random(2), 400).translate(str.maketrans("0123456789", "abcdefghij"))
    whole, _ = langid.presence([text])
    monkeypatch.setattr(langid, "SPAN", 37)
    assert (langid.presence([text])[0] == whole).all()
