"""Mixing, shards, link trust, toxicity, piece codec, multiset hash, and the pipeline."""

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import corpus, edge_rows, frame, prose, words  # noqa: E402

from hostlens.llm import link_trust, sharding  # noqa: E402
from hostlens.llm.deobfuscation import (  # noqa: E402
    SYMBOLS, Costs, Reader, character_costs, choose_features, decode, decode_doubles, fit_toxicity, moves_of,
    score_toxicity, symbols, trigram_counts)
from hostlens.llm.link_trust import judge_urls  # noqa: E402
from hostlens.llm.mixing import mix_documents, mix_plan  # noqa: E402
from hostlens.llm.multiset_hash import Fingerprints, edited_fingerprints, fingerprint_documents  # noqa: E402
from hostlens.llm.piece_codec import (  # noqa: E402
    Decoder, Encoder, Vocabulary, decode_documents, encode_documents)
from hostlens.llm.sharding import minimax_cuts, shard_documents  # noqa: E402


def test_mix_keeps_all_documents_and_the_limit(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(1, 30)), rng.choice("aaaaaaaabc")) for i in range(300)]
    rows += [(i, t, s) for i, t, s in edge_rows() if i != 7 and i != 8]
    docs = frame(spark, rows)
    plan, placed = mix_plan(docs, target_entropy=0.99, repetition_limit=1.5)
    plan = {r["source"]: r for r in plan.collect()}
    times = defaultdict(int)
    for r in placed.collect():
        times[r["source"]] += r["n_tokens"]
        assert r["token_offset"] < plan[r["source"]]["budget_tokens"]
    for source, p in plan.items():
        assert p["tokens"] == sum(len(words(t)) + 1 for _, t, s in rows if s == source)
        assert p["budget_tokens"] <= 1.5 * p["tokens"] + 1
        assert p["budget_tokens"] <= times[source]
    mixed = mix_documents(docs, target_entropy=0.99, repetition_limit=1.5)
    assert mixed.columns == docs.columns
    counts = Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    assert set(counts) == set(rows)
    assert Counter((r["doc_id"], r["source"]) for r in placed.collect()) == sum(
        (Counter({(i, s): n}) for (i, _, s), n in counts.items()), Counter())
    assert mix_documents(docs.limit(0), target_entropy=0.9).count() == 0


def test_mix_meets_its_entropy_and_budget(spark):
    rows = [(i, "x " * 9, s) for i, s in enumerate("a" * 90 + "b" * 9 + "c")]
    plan, placed = mix_plan(frame(spark, rows), budget=500, target_entropy=0.8)
    plan = plan.collect()
    share = np.array([r["tokens"] for r in plan]) ** plan[0]["exponent"]
    share = share / share.sum()
    assert -(share * np.log(share)).sum() / np.log(3) == pytest.approx(0.8, abs=1e-4)
    assert sum(r["budget_tokens"] for r in plan) == pytest.approx(500, abs=2)
    # a partial epoch follows whole ones, each row at most once per epoch
    seen = Counter((r["doc_id"], r["epoch"]) for r in placed.collect())
    assert max(seen.values()) == 1


@pytest.mark.parametrize("seed", range(4))
def test_minimax_cuts_equal_those_of_greedy_on_the_whole_list(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(sharding, "FIRST_BINS", rng.choice([4, 50]))
    monkeypatch.setattr(sharding, "BINS", rng.choice([3, 30]))
    sizes = [rng.randint(1, rng.choice([3, 1000])) for _ in range(rng.choice([1, 60, 800]))]
    shards = rng.choice([1, 3, 24])

    def greedy(capacity):
        cuts, at, used = [], 0, 0
        for size in sizes:
            if used + size > capacity:
                cuts.append(at)
                used = 0
            used, at = used + size, at + size
        return [*cuts, *[at] * (shards - len(cuts))] if len(cuts) < shards else None

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if greedy(c))
    ends = spark.createDataFrame([(int(e),) for e in np.cumsum(sizes)], "end_bytes long")
    assert minimax_cuts(ends, shards, sum(sizes), max(sizes)) == (best, greedy(best))


def test_shards_hold_whole_groups_without_gaps(spark):
    rows = edge_rows()[:7] + [(100 + i, t, s) for i, t, s in corpus(1, 90)] + [
        (1000 + i, "copy " * 40, "a") for i in range(200)]
    got = shard_documents(frame(spark, rows), shards=5).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(5))
    assert len({r["shard"] for r in got if r["doc_id"] and r["doc_id"] >= 1000}) == 1
    assert shard_documents(frame(spark, rows).limit(0)).count() == 0


def test_urls_are_judged_by_rules_then_trust(spark):
    pages = spark.createDataFrame([
        (1, "http://A.com/x?q#f", '<a href="//good.org/1">'), (2, "http://bad.net/es/1", None),
        (3, "https://good.org", ""), (4, "http://links.org/p#x", "<A HREF='http://bad.net/'>"),
        (5, None, None), (6, "nourl", "x"), (7, "http://bad.net/en", "y"), (8, "http://lone.org/", ""),
        (8, "http://lone.org/", ""), (None, "http://sub.a.com?x://y/", "<img src=http://good.org/i>"),
    ], "page_id long, url string, html string")
    rules = spark.createDataFrame([("com", "/", "allow"), ("net", "/es/", "block")],
                                  "rule_host string, rule_path string, verdict string")
    got = judge_urls(pages, rules).collect()
    assert len(got) == 10
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[1] == ("a.com", "/x", "com/", "allow")
    assert by[2] == ("bad.net", "/es/1", "net/es/", "block")
    assert by[3] == ("good.org", "", None, "allow")
    assert by[4] == ("links.org", "/p", None, "block")
    assert by[5] == by[6] == ("", "", None, "allow")
    assert by[7][3] == "block" and by[8][3] == "allow"
    assert by[None] == ("sub.a.com", "", None, "allow")
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert judge_urls(pages, rules.limit(0)).filter("verdict = 'block'").count() == 0


def _toxic_rows(n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        text = prose(rng, rng.randint(5, 80)).replace("w", "the wo")
        bad = i % 5 == 0
        if bad:
            text += rng.choice([" what an idiot he is", " complete moron", " you stupidest lot"])
        rows.append((i, text, "a"))
        labels.append((i, int(bad)))
    return rows, labels


def test_obfuscated_words_are_restored_and_scored(spark):
    rows, labels = _toxic_rows()
    docs = frame(spark, rows)
    labels = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    tests = [(1, "you 1d10t", 1), (2, "an i d i o t", 1), (3, "m-o-r-o-n", 1), (4, "iiidiooot!!", 1),
             (5, "M0R0N", 1), (6, "stup1d", 1), (7, "the good wo12 3 times", 0), (8, "", 0),
             (9, None, 0), (10, "a b c d e", 0), (11, "x" * 300_000, 0), (12, "1 " * 3000, 0),
             (None, "id!ot", 1), (1, "you 1d10t", 1)]
    got = score_toxicity(frame(spark, [t for t in tests]), model, out_col="low").collect()
    assert Counter((r["text"], int(r["low"] >= 0.5)) for r in got) == Counter(
        (t, y) for _, t, y in tests)
    assert all(0 <= r["low"] <= 1 for r in got)
    assert score_toxicity(docs.limit(0), model).count() == 0
    empty = fit_toxicity(docs.limit(0), labels.limit(0))
    assert score_toxicity(docs, empty).filter("toxicity >= 0.5").count() == 0 or empty.base >= 0.5


def test_trigrams_count_all_texts(spark):
    rows = [(i, t, s) for i, t, s in corpus(2, 30)]
    counts = trigram_counts(frame(spark, rows))
    letters = sum(c.isalpha() for _, t, _ in rows for c in t.lower())
    assert counts.reshape(64, 64, 64)[:, :, 1:].sum() == letters
    assert Reader(character_costs(counts)).token("plain") == ("plain",)


def test_copies_of_a_toxic_text_teach_nothing_more():
    rows = [(True, 1, ["rare", "insult"])] * 20 + [(True, k, ["insult"]) for k in range(2, 12)] + [
        (False, k, ["fine"]) for k in range(20, 60)]
    weights, base = choose_features(rows)
    assert set(weights) == {"insult"} and base < 0.1


@pytest.fixture(scope="module")
def model():
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    import sentencepiece

    return Vocabulary.load(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_codec_equals_the_library(model):
    vocabulary, library = model
    encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
    rng = random.Random(1)
    letters = "abcdeilnorst ABE▁ .,-=_*#\n日本éü①́😀0123  "
    tokens = [p.replace("▁", " ") for p in vocabulary.pieces[259:]]
    texts = ["", " ", "  ", "   a", " 日", "x▁y", "▁▁ x", "a\x00b", "<s>hi</s>", "-" * 3000, "a" * 300,
             " " * 33 + "q", "﻿ ⁇", "x" * 70 + "é" * 90]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    texts += ["".join(rng.choice(tokens) for _ in range(rng.randint(1, 30))) for _ in range(500)]
    for text in texts:
        ids = np.frombuffer(encoder.encode(text), dtype=np.int32)
        assert ids.tolist() == library.encode(text)
        assert decoder.decode(ids).decode() == library.decode(ids.tolist())
    for _ in range(1000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999)])
               for _ in range(rng.randint(1, 8))]
        assert decoder.decode(np.array(ids)).decode() == library.decode(ids)


def test_codec_of_a_table(spark, model):
    vocabulary, library = model
    rows = edge_rows()
    coded = encode_documents(frame(spark, rows), vocabulary)
    got = decode_documents(coded, vocabulary, out_col="low").collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["low"]) for r in got) == Counter(
        (i, tuple(library.encode(t or "")), library.decode(library.encode(t or "")))
        for i, t, _ in rows)
    assert decode_documents(coded.limit(0), vocabulary).count() == 0


def test_multiset_hash_adds_and_takes_away():
    rng = random.Random(4)
    parts = [" ".join(f"v{rng.randint(0, 9999)}" for _ in range(n)) for n in (1, 2, 3, 40, 40, 200)]
    whole = Fingerprints.of(["\n".join(parts)])
    shuffled = parts[::-1]
    assert Fingerprints.of(["\n\n".join(shuffled)]).texts() == whole.texts()
    less = whole - Fingerprints.of([parts[3]])
    assert less.texts() == Fingerprints.of(["\n".join(parts[:3] + parts[4:])]).texts()
    assert (less + Fingerprints.of([parts[3]])).texts() == whole.texts()
    assert Fingerprints.parse(whole.texts()).texts() == whole.texts()
    assert Fingerprints.of(["\n".join([*parts, parts[0]])]).texts() != whole.texts()
    assert whole.likeness(whole)[0] == 1 and whole.likeness(Fingerprints.of([prose(rng, 300)]))[0] < 0.4


def test_edited_fingerprints_follow_the_id_order(spark, monkeypatch):
    from hostlens.llm import multiset_hash

    monkeypatch.setattr(multiset_hash, "ROWS_PER_BUCKET", 5)
    rng = random.Random(6)
    rows = [(rng.randint(-10**12, 10**12), "\n".join(prose(rng, rng.randint(0, 30)) for _ in range(4)),
             "a") for _ in range(60)] + [(None, "last one of all", "b"), (3, None, "a"), (4, "", "a")]
    order = sorted(rows, key=lambda r: -1e18 if r[0] is None else r[0], reverse=True)
    got = {r["doc_id"]: r for r in edited_fingerprints(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, (i, text, _) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert [got[i]["fingerprint"], got[i]["edited_fingerprint"]] == Fingerprints.of(
            [text, edited]).texts()
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
    assert edited_fingerprints(frame(spark, rows).limit(0)).count() == 0
    one = edited_fingerprints(frame(spark, [(1, "a b c d e f", "x")])).collect()
    assert len(one) == 1
    tied = edited_fingerprints(frame(spark, edge_rows())).count()
    assert tied == len(edge_rows())
    assert fingerprint_documents(frame(spark, edge_rows())).count() == len(edge_rows())


def test_pipeline_stages_follow_each_other(spark, tmp_path):
    import corpus_pipeline

    rows, labels = _toxic_rows()
    near = rows[1][1] + " " + prose(random.Random(1), 60)
    rows += [(1000, near, "b"), (1001, near + " end", "b"), (1002, near, "b"), (1003, None, "c"),
             (1004, "", None), (1005, "i-d-i-o-t", "c")]
    boiler = "All rights of this text are reserved"
    letters = str.maketrans("0123456789", "abcdefghij")  # digits would be fields
    rows += [(2000 + i, "\n".join([prose(random.Random(i), 40, 5000).translate(letters), boiler,
                                   prose(random.Random(-i), 30, 5000).translate(letters)]), "d")
             for i in range(1, 30)]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows],
                          "doc_id long, text string, lang string, source string, n_chars int"
                          ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    left = {r["doc_id"] for r in clean.collect()}
    assert 1005 not in left and not left & {i for i, y in labels if y}
    assert {i for i, _, _ in rows} - left == {i for i, y in labels if y} | {1005}
    whole = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in whole}
    assert 1000 in ids and not ids & {1001, 1002, 1005} and {1003, 1004} <= ids
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {i: t for i, t, _ in rows}
    for r in whole:
        text = texts[r["doc_id"]] or ""
        if r["doc_id"] > 2000:
            text = text.replace(boiler + "\n", "")
        assert list(r["ids"]) == library.encode(text) and r["n_tokens"] == len(r["ids"])


def _english():
    text = ("\n\nwhat a stupid shit of an ass and idiot cunt fuck moron then better off see the "
            "well known all too good little letter\n\n") * 50
    s = symbols(text)
    return character_costs(np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:],
                                       minlength=SYMBOLS ** 3))


def test_signs_at_the_edges_of_a_word_are_decoded():
    reader = Reader(_english())
    for token, word in [("$hit", "shit"), ("a$$", "ass"), ("$tupid", "stupid"), ("idio+", "idiot"),
                        ("(unt", "cunt"), ("4$$", "ass"), ("@$$", "ass"),
                        ("\"$hit,", "shit"), ("idiot!", "idiot"), ("(then", "then")]:
        assert word in reader.token(token), token
    assert reader.token("then,") == ("then",)


def test_joined_doubled_and_spaced_words_are_read():
    reader = Reader(_english())
    for token, word in [("iddiot", "idiot"), ("id.iot", "idiot"), ("sh-it", "shit"),
                        ("i,d,i,o,t", "idiot"), ("idi" + "o" * 71 + "t", "idiot"), ("f*ck", "fuck"),
                        ("x9" * 90 + "1d10t" + "k7" * 90, None), ("m-o-r-o-n", "moron")]:
        found = reader.token(token)
        assert word in found if word else any("idiot" in w for w in found), (token, found)
    for text in ["you i d i o t", "i\nd\ni\no\nt", "i    d    i    o    t", "i,d,i,o,t", "1 d 1 0 t",
                 "so i.d.i.o.t", "i d i o t " + "a b " * 300]:
        assert "idiot" in reader.words(text), text
    # nothing to decode: plain words, numbers and one price, whatever ends the sentence
    for token, found in [("then!!", ("then",)), ("1,000.50", ()), ("192.168.1.1", ()), ("$100", ()),
                         ("|", ()), ("12:30", ()), ("(12)", ()), ("moron?!", ("moron",))]:
        assert reader.token(token) == found, token


def _exhaustive(span, costs):
    """The cheapest of all paths of the lattice, each spelled out."""
    paths = [(0.0, (0, 0), "")]
    for moves in moves_of(span):
        fresh = []
        for cost, (a, b), text in paths:
            for out, s, price in moves:
                if s < 0 or s == 0 and b == 0:
                    fresh.append((cost + price, (a, b), text))
                else:
                    fresh.append((cost + price + costs[(a * SYMBOLS + b) * SYMBOLS + s], (b, s),
                                  text + out))
        paths = fresh
    return min(cost + costs[(a * SYMBOLS + b) * SYMBOLS] for cost, (a, b), _ in paths), {
        text: cost + costs[(a * SYMBOLS + b) * SYMBOLS] for cost, (a, b), text in sorted(paths, reverse=True)}


def test_decoding_is_exact():
    """As cheap as the best of all paths: no hypothesis is thrown away."""
    costs = Costs(_english())
    rng = random.Random(3)
    for _ in range(400):
        span = "".join(rng.choice("aidotshh1013$!.- *ü") for _ in range(rng.randint(1, 7)))
        if span.count("*") > 2:
            continue
        best, each = _exhaustive(span, costs.flat)
        assert each[decode(span, costs)] == pytest.approx(best, abs=1e-9), span


def test_pairs_of_letters_are_decided_as_by_the_whole_search():
    costs = Costs(_english())
    rng = random.Random(5)
    for _ in range(3000):
        word = "".join(rng.choice("aidotshlefü") for _ in range(rng.randint(1, 9)))
        word = "".join(c * rng.choice([1, 1, 2]) for c in word)
        if not any(a == b == c for a, b, c in zip(word, word[1:], word[2:], strict=False)):
            assert decode_doubles(word, costs) == decode(word, costs), word
    # three stars beside a word decorate it, beside a few letters they mask
    assert {len(m) for m in moves_of("word***")[-3:]} == {2}
    assert {len(m) for m in moves_of("sh***")[-3:]} == {28}
    assert {len(m) for m in moves_of("wo**d")[2:4]} == {28}


def test_toxicity_of_held_out_rows(spark):
    """Area under the ROC curve on rows that were never learned from."""
    folder = Path("/root/testdata/sf0.1")
    if not folder.exists():
        pytest.skip("no test data")
    from hostlens.llm.catalog import QUERIES

    rows = QUERIES["op6_deobfuscation"](spark, str(folder)).filter("held_out").join(
        spark.read.parquet(f"{folder}/labels.parquet").filter("toxic is not null"), "doc_id").collect()
    bad = np.array([r["score"] for r in rows if r["toxic"] == 1])
    good = np.array([r["score"] for r in rows if r["toxic"] == 0])
    area = ((bad[:, None] > good).mean() + (bad[:, None] == good).mean() / 2)
    assert len(bad) > 20 and area > 0.8
    assert (good >= 0.5).mean() < 0.02


def test_long_runs_of_blanks_take_no_time(model):
    import time

    vocabulary, library = model
    encoder = Encoder(vocabulary)
    for n in [*range(0, 70), 999, 4096, 1_000_000]:
        for text in (" " * n, "a" + " " * n + "b"):
            start = time.perf_counter()
            ids = np.frombuffer(encoder.encode(text), dtype=np.int32)
            assert time.perf_counter() - start < 5
            assert ids.tolist() == library.encode(text), n
    for n in range(60):  # the two ways to merge a run
        assert encoder._leftmost_run(n) == encoder._merged_run(n)
        naive = [len(p) for p in encoder.merge("▁" * n, encoder.spaces)]
        assert encoder._merged_run(n) == naive
    encoder.spaces = {"▁" * k: -float(k % 5) for k in (2, 3, 4, 6, 8, 11)}
    for n in range(80):
        assert encoder._merged_run(n) == [len(p) for p in encoder.merge("▁" * n, encoder.spaces)]


def test_fingerprints_take_any_ids(spark, monkeypatch):
    """The ends of the range, an outlier, one id in very many rows, and no ids at all."""
    from hostlens.llm import multiset_hash

    monkeypatch.setattr(multiset_hash, "ROWS_PER_BUCKET", 50)
    low, high = -(1 << 63), (1 << 63) - 1
    few = [(low, "a b c", "x"), (5, "d e f", "x"), (high, "g h i", "x"), (None, "j k l", "x")]
    got = {r["doc_id"]: r for r in edited_fingerprints(frame(spark, few)).collect()}
    assert set(got) == {low, 5, high, None}
    for i, after in [(high, "d"), (5, "a"), (low, "j"), (None, "g")]:
        text = {r[0]: r[1] for r in few}[i]
        assert got[i]["edited_sha256"] == hashlib.sha256((text[:4] + after).encode()).hexdigest()
    rng = random.Random(8)
    for ids in ([*range(3000), 10**18], [None] * 3000, [7] * 2000 + list(range(1000))):
        rows = [(i, f"{prose(rng, 3)} {k}", "x") for k, i in enumerate(ids)]
        docs = frame(spark, rows).selectExpr("doc_id", "text")
        dealt = multiset_hash._with_next(docs).filter("not tail").groupBy("bucket").count().collect()
        assert sum(r["count"] for r in dealt) == len(rows)
        assert max(r["count"] for r in dealt) <= 100 and len(dealt) >= len(rows) / 100
        assert edited_fingerprints(docs).count() == len(rows)


def test_likeness_of_repetitive_texts_follows_their_counts():
    """Counts beyond 16 bits do not wrap."""
    one, other = Fingerprints.of(["word " * 70_540, "word " * 5_000])[[0]], Fingerprints.of(["word " * 5_000])
    a, b = 70_538.0, 4_998.0
    assert one.likeness(other)[0] == pytest.approx(1 - (a - b) ** 2 / (a * a + b * b), abs=1e-9)
    assert Fingerprints.parse(one.texts()).texts() == one.texts()


def test_rows_without_ids_are_permuted_in_blocks(spark):
    """Null and repeated ids are dealt by their texts."""
    rng = random.Random(3)
    rows = [(None if k % 2 else 4, f"{k} {prose(rng, 3)}", "a") for k in range(5000)]
    _, placed = mix_plan(frame(spark, rows), target_entropy=0.9)
    blocks = Counter(r["block_rank"] for r in placed.collect())
    assert len(blocks) >= 65 and max(blocks.values()) < 2 * 5000 / len(blocks)
    assert placed.select("token_offset").distinct().count() == 5000
    mixed = mix_documents(frame(spark, rows), target_entropy=0.9)
    assert Counter(r["text"] for r in mixed.collect()) == Counter(t for _, t, _ in rows)


def test_distrust_goes_all_the_way(spark):
    """Twenty hosts that only lead to a blocked one are blocked; a hot host is one of them."""
    pages = [(k, f"http://h{k}.org/", f'<a href="http://h{k + 1}.org/">') for k in range(19)]
    pages += [(19, "http://h19.org/", '<a href="http://bad.net/es/1">'), (20, "http://bad.net/es/1", "")]
    pages += [(100 + k, "http://h7.org/", "") for k in range(300)]
    pages += [(900, "http://far.org/", '<a href="http://else.org/">'), (901, "http://good.com/", "")]
    rules = spark.createDataFrame([("com", "/", "allow"), ("net", "/es/", "block")],
                                  "rule_host string, rule_path string, verdict string")
    frame_ = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns(
        {n: F.lit(n) for n in ("host", "path", "rule", "rank", "src")})
    got = {r["page_id"]: r for r in judge_urls(frame_, rules).collect()}
    assert all(got[k]["verdict"] == "block" for k in range(21)) and got[250]["verdict"] == "block"
    assert got[900]["verdict"] == got[901]["verdict"] == "allow"
    # the rank has settled: distrust of a host one link further on is 0.85 times as large
    ranks = [got[k]["distrust"] for k in range(20)]
    assert ranks[18] == pytest.approx(0.85 * ranks[19], abs=1e-8)
    assert ranks[0] == pytest.approx(0.85 ** 19 * ranks[19], abs=1e-8)


def test_plans_of_the_ranks_stay_small(spark, monkeypatch):
    """However many steps it takes, none is planned together with others."""
    joins, cut = [], link_trust.cut

    def counted(df, *names, **more):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins.append(plan.count("Join "))
        return cut(df, *names, **more)

    monkeypatch.setattr(link_trust, "cut", counted)
    edges = spark.createDataFrame([("t", f"h{k}", f"h{k + 1}", 2.0) for k in range(30)] + [
        ("t", "h30", "h0", 1.0), ("t", "h0", "h2", 2.0)], "kind string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("t", "h0", 1.0)], "kind string, host string, seed double")
    got = {r["host"]: r["rank"] for r in link_trust.personalised_rank(edges, seeds).collect()}
    assert len(joins) > 24 and max(joins) == 1
    want = {"h0": 1.0}
    for _ in range(400):
        new = Counter({"h0": 0.15})
        for k in range(31):
            for dst in ({0: ["h1", "h2"], 30: ["h0"]}.get(k) or [f"h{k + 1}"]):
                new[dst] += 0.85 * want.get(f"h{k}", 0) / (2 if k == 0 else 1)
        want = new
    assert set(got) == set(want)
    assert all(got[h] == pytest.approx(want[h], abs=1e-5) for h in want)
