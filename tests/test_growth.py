"""Plans and forms whose work may not grow faster than the tables."""

import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_confident_rooms_name_the_path_once(spark, tmp_path):
    from hostlens.catalog.inputs import confident_rooms

    parts = [0, 0, 1, 3, 4, 6, 7, 9, 12, 15, 15, 18]
    spark.createDataFrame(
        [(i, p, 1, 5, 10.0, 100.0, 0.1) for i, p in enumerate(parts)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(3).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    found = confident_rooms(spark, str(tmp_path))
    # "bath-room" is no bathroom, "img" no room; "cover" counts as exterior
    assert {r["room"]: r["n"] for r in found.collect()} == {
        "bedroom": 2, "living": 1, "exterior": 2, "view": 1, "kitchen": 1, "pool": 2, "bathroom": 1}
    assert optimised(found).count("translate(") == 1


def test_flags_are_ordered_without_structs_in_structs(spark):
    from hostlens.plans.features import gallery_flags
    from hostlens.settings import DEFAULTS

    rows = [("g", e, s, (k, s), f"p{e}{s}{k}", True, True, "pool", 0.5, 10, 20)
            for e, s, k in (("b", 2, 5), ("a", 1, 9), ("b", 1, 7), ("a", 1, 3), ("b", None, 1))]
    frame = spark.createDataFrame(rows, (
        "gallery string, entity_id string, seq long, row_key struct<a:long,b:long>, path string, "
        "is_blurry boolean, is_low_resolution boolean, room string, room_confidence double, "
        "width long, height long"))
    flags = gallery_flags(frame, frame, DEFAULTS)
    (got,) = flags.collect()
    assert [f["path"] for f in got["bad_photos"]] == ["pbNone1", "pb17", "pb25", "pa13", "pa19"]
    line = next(x for x in optimised(flags).splitlines() if "collect_list" in x)
    assert "entity_first" in line and "struct(entity_first," not in line


def test_flags_of_a_cell_parse_it_once(spark):
    from hostlens.operators.reporting import photo_flags

    cell = ('{"positive":[],"issues":[],"suggestions":[],"bad_photos":'
            '[{"path":"a","reason":"x_y","width":1000,"height":2000},{"path":null,"reason":"z"}]}')
    rows = [("l1", cell), ("l2", '{"positive":[],"issues":[],"suggestions":[],"bad_photos":[]}'),
            ("l3", None), ("l4", "broken")]
    found = photo_flags(spark.createDataFrame(rows, "listing_id string, explanation_json string"))
    assert sorted(map(tuple, found.collect()), key=str) == [
        ("l1", "a", "x y; 1000 x 2000 px (2.00 MP)"), ("l1", None, "z")]
    assert optimised(found).count("from_json(") == 1


def test_positions_keep_the_rows_in_place(spark):
    from hostlens.operators.ordering import position_in_group

    rows = [(f"g{i % 3}", (i * 7 % 50, i), f"p{i}") for i in range(50)]
    frame = spark.createDataFrame(rows, "g string, k struct<a:long,b:long>, p string").repartition(4)
    placed = position_in_group(frame, "g", [F.col("k")], kept=["p"])
    assert placed.columns == ["g", "p", "position"]
    want = {}
    for g in {r[0] for r in rows}:
        for n, (_, p) in enumerate(sorted((k, p) for h, k, p in rows if h == g), 1):
            want[p] = (g, n)
    assert {r["p"]: (r["g"], r["position"]) for r in placed.collect()} == want
    assert "Exchange hashpartitioning" not in placed._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [3, 1000])
def test_an_alias_table_of_any_size_is_searched_whole(spark, monkeypatch, most):
    import random

    from hostlens.operators import aliases as module

    monkeypatch.setattr(module, "MOST_ALIASES", most)
    rng = random.Random(5)

    def text():
        return "".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 4)))

    table = [(rng.randint(0, 20), rng.choice(["k1", "k2", None]), text()) for _ in range(30)]
    table += [(3, "null", None)] + table[:9]
    words = [text() for _ in range(60)] + [None, "", "zzz", "zzz"]
    aliases = spark.createDataFrame(table, "place long, key string, alias string")
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n int")
    got = module.with_alias_key(frame.repartition(3), aliases, shares=True).collect()
    ranked = sorted((a for a in table if a[2] is not None),
                    key=lambda a: (a[0], a[1] is not None, a[1] or "", a[2]))
    want = [None if w is None else next((k for _, k, a in ranked if a in w or w in a), None)
            for w in words]
    assert [r["key"] for r in sorted(got, key=lambda r: r["n"])] == want


def test_pictures_in_batches_are_those_of_the_formula(spark, tmp_path):
    from hostlens.catalog.photos import derived_images

    rows = [(i, [((i * 31 + k * 17) % 97) / 97 * 3 - 1.5 for k in range(64)]) for i in range(6)]
    rows += [(6, [None] + [0.25] * 63), (7, None), (8, [float("nan")] * 64), (9, [0.1] * 70)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    derived = derived_images(spark, str(tmp_path))
    got = {r["vec_id"]: bytes(r["data"]) for r in derived.collect()}
    import numpy as np
    for vec_id, values in rows:
        want = bytearray()
        for k in range(3 * 32 * 32):
            i, c = divmod(k, 3)
            y, x = divmod(i, 32)
            v = None if values is None else values[(y // 4 * 8 + x // 4 + 21 * c) % 64]
            grain = (x * 7 + y * 13 + c * 5) % 17
            if v is None:
                want.append(0)
                continue
            level = (float(np.float32(v)) + 0.6) * 200.0
            want.append(min(max((0 if level != level else int(level // 1)) + grain, 0), 255))
        assert got[vec_id] == bytes(want), vec_id
    # usual vectors are made by the batch, not pixel by pixel
    assert "ArrowEvalPython" in optimised(derived)


def test_queries_are_read_without_a_session():
    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    found = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, capture_output=True,
                           text=True, timeout=120)
    assert found.returncode == 0, found.stderr[-800:]


def test_pictures_are_decoded_once_in_few_tasks(spark, tmp_path, monkeypatch):
    from hostlens.catalog import inputs

    rows = [(i, [((i * 31 + k * 17) % 97) / 97 - 0.5 for k in range(64)]) for i in range(300)]
    rows += [(7, rows[7][1]), (300, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(inputs, "_FOLDERS", 3)
    found = inputs.image_file_scan(spark, str(tmp_path))
    got = {r["vec_id"]: r for r in found.collect()}
    assert len(got) == found.count() == 301
    assert all(tuple(r)[1:5] == (32, 32, 3, True) for r in got.values())
    for vec_id in (0, 7, 299):
        picture = next(bytes(r["data"]) for r in inputs_pictures(spark, tmp_path, vec_id))
        grey = [(3735 * b + 19235 * g + 9798 * r + 16384) >> 15
                for b, g, r in zip(picture[::3], picture[1::3], picture[2::3], strict=True)]
        assert got[vec_id]["brightness"] == pytest.approx(sum(grey) / 1024, abs=2e-6)
    # one scan of pictures; only the paths of the other are read
    assert len(re.findall(r"Relation .*image", optimised(found))) == 1, optimised(found)


def test_the_driver_lists_a_slice_of_the_pictures_at_a_time(spark, tmp_path, monkeypatch):
    from hostlens.catalog import inputs

    rows = [(i * 64, [((i * 31 + k * 17) % 97) / 97 - 0.5 for k in range(64)]) for i in range(90)]
    rows += [rows[7], (5, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(inputs, "_FOLDERS", 3)
    want = sorted(map(tuple, inputs.image_file_scan(spark, str(tmp_path)).collect()), key=str)
    assert len(want) == 91
    listed = []

    def watched(read):
        def run(spark, folder):
            listed.append(sum(1 for p in Path(folder).rglob("*.png")))
            return read(spark, folder)
        return run

    monkeypatch.setattr(inputs, "read_images", watched(inputs.read_images))
    monkeypatch.setattr(inputs, "existing_files", watched(inputs.existing_files))
    monkeypatch.setattr(inputs, "_SLICE", 30, raising=False)
    got = inputs.image_file_scan(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == want
    # each picture is listed by two scans, in more than one slice
    assert sum(listed) == 2 * 91 and max(listed) < 60


def test_listings_of_files_are_not_kept(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameReader

    from hostlens.sources.images import existing_files, read_images

    (tmp_path / "a.png").write_bytes(b"x")
    size = "spark.sql.hive.filesourcePartitionFileCacheSize"
    before, seen, load = spark.conf.get(size), [], DataFrameReader.load
    monkeypatch.setattr(DataFrameReader, "load", lambda self, *a, **b: (
        seen.append(spark.conf.get(size)), load(self, *a, **b))[1])
    assert existing_files(spark, str(tmp_path)).count() == 1
    assert read_images(spark, str(tmp_path)).count() == 1
    assert seen[0] == seen[-1] == "0" and spark.conf.get(size) == before


def inputs_pictures(spark, path, vec_id):
    from hostlens.catalog.photos import derived_images

    return derived_images(spark, str(path)).filter(F.col("vec_id") == vec_id).collect()


def test_small_pictures_share_a_task(spark):
    from hostlens.sources.images import fewer_tasks

    cores = spark.sparkContext.defaultParallelism
    many, few = spark.range(0, 900, 1, 900), spark.range(0, 9, 1, 3)
    assert fewer_tasks(many).rdd.getNumPartitions() == max(57, 2 * cores)
    assert fewer_tasks(few).rdd.getNumPartitions() == 3
    assert fewer_tasks(many).count() == 900


def test_names_of_files_share_a_task(spark, tmp_path):
    from hostlens.sources.images import existing_files

    cores = spark.sparkContext.defaultParallelism
    for k in range(40 * 2 * cores):
        (tmp_path / f"{k}.png").write_bytes(b"x")
    found = existing_files(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 2 * cores
    assert found.distinct().count() == 40 * 2 * cores


def test_paths_are_taken_apart_without_a_step_for_each_piece(spark):
    from hostlens.operators.matching import digit_pieces

    paths = ["p1234/x_56٣٤.jpg", "12\U0001d7ce\U0001d7cf4", "a7b77c777", "", None, "none"]
    frame = spark.createDataFrame(list(enumerate(paths)), "n int, path string")
    lengths = [1, 2, 4]
    found = frame.select("n", digit_pieces(F.col("path"), lengths).alias("pieces"))
    for n, pieces in found.collect():
        runs = re.findall(r"\d+", paths[n] or "")
        want = {run[i:i + k] for run in runs for k in lengths for i in range(len(run) - k + 1)}
        assert sorted(pieces or []) == sorted(want), paths[n]
    assert "lambda" not in optimised(found)


def test_wanted_galleries_are_hashed_when_they_are_many(spark):
    from hostlens.operators.sizing import lookup_side

    keys = spark.range(50).select(F.col("id").cast("string").alias("gallery"))
    rows = spark.range(200).select((F.col("id") % 70).cast("string").alias("gallery"))
    for most, node in ((10, "ShuffledHashJoin"), (50, "BroadcastHashJoin")):
        found = rows.join(lookup_side(keys, most), "gallery", "left_semi")
        assert node in found._jdf.queryExecution().sparkPlan().toString()
        assert found.count() == sum(i % 70 < 50 for i in range(200))


def test_entity_ids_are_taken_apart_once(spark):
    from hostlens.operators.matching import unmatched_galleries

    wanted = spark.createDataFrame([("1",), ("2",), ("3",), ("03",)], "gallery string")
    photos = spark.createDataFrame([("a_1",), ("a_1",), ("b1",), ("3",), ("x",), ("",), (None,)],
                                   "entity_id string")
    found = unmatched_galleries(wanted, photos)
    assert sorted(r[0] for r in found.collect()) == ["03", "2"]
    assert optimised(found).count("regexp_extract(") == 1


def test_flagged_photos_are_shuffled_once(spark):
    import random

    from hostlens.plans.features import gallery_flags
    from hostlens.settings import DEFAULTS

    rng, rows = random.Random(3), []
    for i in range(120):
        # entities that name their gallery, one found by paths in many, and none
        entity, gallery = rng.choice([("a_7", "7"), ("b7", "7"), ("c_12", "12"), ("misc", "31"),
                                      ("misc", "44"), ("x_9", "44"), (None, "7")])
        rows.append((gallery, entity, rng.choice([None, 1, 2]), (rng.randint(0, 9), i), f"p{i}",
                     rng.random() < 0.4, rng.random() < 0.4, rng.choice(["pool", "other", None]),
                     rng.choice([0.2, 0.5]), 10 + i, 20))
    frame = spark.createDataFrame(rows, (
        "gallery string, entity_id string, seq long, row_key struct<a:long,b:long>, path string, "
        "is_blurry boolean, is_low_resolution boolean, room string, room_confidence double, "
        "width long, height long")).repartition(4)
    flags = gallery_flags(frame, frame, DEFAULTS)
    assert flags._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    got = {r["gallery"]: [f["path"] for f in r["bad_photos"]] for r in flags.collect()}
    first, want = {}, {}
    for _, entity, _, key, *_ in rows:
        first[entity] = min(key, first.get(entity, key))
    for g, e, seq, key, path, blurry, low, *_ in rows:
        if e is not None and (blurry or low):
            want.setdefault(g, []).append((first[e], seq is not None, seq or 0, key, path))
    assert got == {g: [x[-1] for x in sorted(found)] for g, found in want.items()}
    reasons = {f["path"]: f["reason"] for r in flags.collect() for f in r["bad_photos"]}
    assert all(reasons[r[4]].startswith("Blurry" if r[5] else "Below")
               for r in rows if r[1] is not None and (r[5] or r[6]))


def _members(spark):
    rows = [(f"a_{g:02d}" if g % 5 else "misc", f"p/{g:02d}/{i}.jpg", 7 - i % 3, (i, g))
            for i in range(8) for g in range(12)]
    rows += [("b_03", "p/03/x.jpg", 1, (3, 0)), (None, "p/05/y.jpg", 1, (0, 0))]
    photos = spark.createDataFrame(
        rows, "entity_id string, file string, seq long, row_key struct<a:long,b:long>")
    listings = spark.createDataFrame([(f"l_{g:02d}",) for g in range(2, 9)], "listing_id string")
    return listings, photos.repartition(3)


def test_many_wanted_galleries_do_not_shuffle_the_photos(spark, monkeypatch):
    from hostlens.operators import matching

    listings, photos = _members(spark)
    want = sorted(matching.gallery_members(listings, photos).collect(), key=str)
    found, wanted = matching.open_members(listings, photos)
    assert wanted is None and sorted(found.collect(), key=str) == want
    monkeypatch.setattr(matching, "broadcast_if_small", lambda keys: keys)
    found, wanted = matching.open_members(listings, photos)
    assert "Join" not in optimised(found)
    assert sorted(matching.only_wanted(found, wanted).collect(), key=str) == want
    assert sorted(matching.gallery_members(listings, photos).collect(), key=str) == want


def test_features_are_the_same_for_many_wanted_galleries(spark, monkeypatch):
    from hostlens.operators import matching
    from hostlens.plans.features import Vision, gallery_rows, photo_rows

    listings, photos = _members(spark)
    photos = photos.select(
        "*", F.col("file").alias("path"), (F.col("seq") * 300).alias("width"),
        F.lit(700).alias("height"), (F.col("row_key.a") * 40.0).alias("sharpness"),
        F.lit(20.0).alias("colorfulness"), F.lit(30.0).alias("contrast"),
        F.lit(90.0).alias("brightness"), F.lit(True).alias("valid"),
        (F.col("row_key.a") * 4095).alias("phash"))

    def rows():
        members, wanted = matching.open_members(listings, photos)
        members = photo_rows(members, Vision())
        found = gallery_rows(members, photos, wanted=wanted)
        assert wanted is None or found.count() == 7
        return sorted(found.collect(), key=lambda r: r["gallery"])

    want = rows()
    assert len(want) == 7 and any(r["bad_photos"] for r in want)
    monkeypatch.setattr(matching, "broadcast_if_small", lambda keys: keys)
    assert rows() == want


def test_photos_meet_no_table_before_they_are_sorted(spark, monkeypatch):
    from hostlens.operators import matching, ordering
    from hostlens.session import cut

    listings, photos = _members(spark)
    members = matching.gallery_members(listings, photos).collect()
    first, want = {}, {}
    for r in photos.collect():
        first[r.entity_id] = min(r.row_key, first.get(r.entity_id, r.row_key))
    for r in members:
        if r.entity_id is not None:
            want.setdefault(r.gallery, []).append(
                (first[r.entity_id], r.entity_id, r.seq, r.row_key, r.file))
    want = sorted((g, x[-1], n) for g, found in want.items()
                  for n, x in enumerate(sorted(found), 1))
    seen, sort = [], ordering._sorted_rows
    monkeypatch.setattr(ordering, "_sorted_rows",
                        lambda df, *a, **b: (seen.append(optimised(df)), sort(df, *a, **b))[1])
    for small in (True, False):
        if not small:
            monkeypatch.setattr(matching, "broadcast_if_small", lambda keys: keys)
            monkeypatch.setattr(ordering, "broadcast_if_small", lambda keys: keys)
        found, wanted = matching.open_members(listings, photos)
        placed = ordering.position_by_section(
            found, "gallery", "entity_id", cut(matching.entity_order(photos)),
            [F.col("seq"), F.col("row_key")], kept=["gallery", "file"], groups=wanted)
        assert placed.columns == ["gallery", "file", "position"]
        assert sorted(map(tuple, placed.collect())) == want
    assert "Join" not in seen[1] and seen[0].count("Join") <= 2


def test_looks_and_counts_leave_no_shuffle_files(spark):
    import time

    from hostlens.operators.sizing import broadcast_if_small
    from hostlens.session import is_empty

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    groups = spark.range(1000).groupBy((F.col("id") % 300).alias("g")).count()
    before = blocks.getAllBlocks().size()
    assert not is_empty(groups) and is_empty(groups.filter("g < 0"))
    broadcast_if_small(groups, 100)
    for _ in range(50):
        if blocks.getAllBlocks().size() <= before:
            break
        time.sleep(0.2)
    assert blocks.getAllBlocks().size() <= before
