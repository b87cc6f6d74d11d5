"""Forms for inputs that outgrow one row, one plan or one scan."""

import os
import random
import time
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from hostlens import session
from hostlens.catalog.inputs import _png
from hostlens.functions.models import blur_detector, room_predictor
from hostlens.operators import evaluation, profiling
from hostlens.operators.aliases import AliasIndex, with_alias_key
from hostlens.operators.amenities import amenity_key
from hostlens.plans import profile
from hostlens.plans.evaluate import gates_from_files
from hostlens.settings import AMENITY_ALIASES
from hostlens.sources import images, sinks


def pairs(spark, rows):
    return spark.createDataFrame(rows, "truth string, predicted string").repartition(3)


@pytest.mark.parametrize("width,zeros", [(1, True), (3, False), (4, True), (100, True), (7, False)])
def test_confusion_blocks_are_the_matrix(spark, width, zeros):
    rng = random.Random(width)
    names = [f"l{k}" for k in range(9)] + ["", "é"]
    rows = [(rng.choice(names), rng.choice(names[3:])) for _ in range(60)] + [("solo", "l3")] * 4
    rows += [(None, "l3"), ("l3", None)]
    counts = Counter(r for r in rows if None not in r)
    labels = sorted({x for r in counts for x in r}, key=str.encode)
    found = evaluation.confusion_blocks(pairs(spark, rows), width, zeros).collect()
    want = {}
    for i, truth in enumerate(labels):
        line = [counts[truth, p] for p in labels]
        for at in range(0, len(labels), width):
            if zeros or any(line[at: at + width]):
                want[truth, i, at // width] = line[at: at + width]
    assert {(r["truth"], r["row"], r["block"]): r["counts"] for r in found} == want
    assert evaluation.confusion_blocks(pairs(spark, rows).limit(0), width).count() == 0


def test_confusion_of_a_hundred_thousand_labels(spark):
    n = 100_000
    rows = spark.range(2 * n).select(
        (F.col("id") % n).cast("string").alias("truth"),
        F.when(F.col("id") % 3 == 0, "0").otherwise((F.col("id") * 7 % n).cast("string"))
        .alias("predicted"))  # a third of all go to one label
    blocks = evaluation.confusion_blocks(rows, 1000)
    sums = blocks.agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("n"),
        F.max(F.size("counts")).alias("widest"), F.countDistinct("truth").alias("labels"),
        F.max("row").alias("last")).first()
    assert tuple(sums) == (2 * n, 1000, n, n - 1)


def brute_keys(words, aliases):
    return [None if w is None else next(
        (key for _, key, alias in sorted(a for a in aliases if a[2] is not None)
         if alias in w or w in alias), None) for w in words]


@pytest.mark.parametrize("seed", range(4))
def test_aliases_match_both_ways_and_the_first_wins(spark, monkeypatch, seed):
    from hostlens.operators import aliases as module

    monkeypatch.setattr(module, "WORDS", 5)
    monkeypatch.setattr(module, "CACHE", 20)
    rng = random.Random(seed)

    def text():
        return "".join(rng.choice("abcé ") for _ in range(rng.randint(0 if seed else 1, 5)))

    table = [(rng.randint(0, 9), f"k{rng.randint(0, 5)}", text()) for _ in range(12)]
    table += [(3, "null", None)]
    words = [text() for _ in range(200)] + [None, "zzz"]
    frame = spark.createDataFrame([(w, "old", 1) for w in words], "word string, key string, n int")
    got = with_alias_key(frame.repartition(3), spark.createDataFrame(
        table, "place long, key string, alias string"))
    assert got.columns == ["word", "n", "key"]
    want = Counter(zip(words, brute_keys(words, table), strict=True))
    assert Counter((r["word"], r["key"]) for r in got.collect()) == want


def test_alias_tables_agree_with_the_rule_chain(spark):
    rows = [(k, key, alias) for k, (key, names) in enumerate(AMENITY_ALIASES.items()) for alias in names]
    words = ["", "terrace", "jacuzzi", "wi-fi", "parking space", "nothing of it", "po", "ac", "piscine"]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = with_alias_key(frame.withColumn("chain", amenity_key(F.col("word"))), spark.createDataFrame(
        rows, "place long, key string, alias string")).collect()
    assert all(r["chain"] == r["key"] for r in got) and any(r["key"] for r in got)


def test_a_hundred_thousand_aliases(spark, monkeypatch):
    rng = random.Random(1)
    table = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(100_000)})
    index = AliasIndex(table)
    words = [table[500], table[70][2:7], f"xx{table[9]}yy{table[3]}", "qqqqqqqqqq", ""]
    found = index.places(words * 400)[:5]
    inside = [k for k, a in enumerate(table) if table[70][2:7] in a or a in table[70][2:7]]
    assert found == [500, inside[0], 3, -1, 0]
    from hostlens.operators import aliases as module

    monkeypatch.setattr(module, "MOST_ALIASES", 2)
    with pytest.raises(ValueError, match="aliases"):
        with_alias_key(spark.createDataFrame([("a",)], "word string"), spark.createDataFrame(
            [(k, "k", "a") for k in range(3)], "place long, key string, alias string"))


def test_a_model_is_loaded_once_in_a_worker(spark, tmp_path):
    loads = str(tmp_path / "loads")
    os.mkdir(loads)

    def load():
        import os
        import uuid

        open(f"{loads}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return {"pool": SimpleNamespace(label="pool", is_blurry=True)}

    def predict(model, paths):
        return [model.get(p.split("_")[0], "other") for p in paths]

    rows = spark.range(4000, numPartitions=40).select(
        F.when(F.col("id") % 4 == 0, "pool_1.png").otherwise("x_2.png").alias("photo_file"),
        F.when(F.col("id") % 4 == 0, "pool").otherwise("other").alias("label"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        report = evaluation.room_accuracy(evaluation.room_pairs(
            rows, predictor=room_predictor(load, predict))).first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert tuple(report) == (1.0, 4000)
    names = os.listdir(loads)
    # 40 tasks of 10 batches, one load in each of the workers
    assert len(names) == len({n.split("-")[0] for n in names}) < 40
    found = evaluation.blur_pairs(rows, detector=blur_detector(load, predict)).groupBy("predicted").count()
    assert {r["predicted"]: r["count"] for r in found.collect()} == {True: 1000, False: 3000}
    with pytest.raises(Exception, match="predictions"):
        evaluation.room_pairs(rows, predictor=room_predictor(load, lambda m, p: [])).collect()


def test_gates_take_a_predictor_and_a_detector(spark, tmp_path):
    (tmp_path / "rooms.csv").write_text("photo_file,label\na.png,pool\nb.png,view\n")
    (tmp_path / "blur.csv").write_text("photo_file,label\na.png,blurry\nb.png,sharp\n")
    rooms = room_predictor(lambda: None, lambda _, paths: [
        SimpleNamespace(label="pool" if p.endswith("a.png") else "view") for p in paths])
    blur = blur_detector(lambda: None, lambda _, paths: [p.endswith("a.png") for p in paths])
    assert gates_from_files(spark, str(tmp_path / "out"), None, str(tmp_path / "rooms.csv"),
                            str(tmp_path / "blur.csv"), predictor=rooms, detector=blur)


def listings(spark, n, first=0):
    return spark.range(first, first + n).select(
        F.col("id").cast("string").alias("listing_id"),
        F.when(F.col("id") % 7 == 0, "NA").otherwise(F.concat(F.lit("town"), F.col("id") % 5000))
        .alias("city"),
        F.when(F.col("id") % 3 == 0, "stay").otherwise("").alias("vertical"),
        F.when(F.col("id") % 2 == 0, "wifi").alias("amenities"))


def test_the_profile_scans_each_input_once(spark, tmp_path):
    listings(spark, 500).write.parquet(str(tmp_path / "l"))
    rows = spark.read.parquet(str(tmp_path / "l"))
    rows.select(F.col("city").alias("entity_id")).write.parquet(str(tmp_path / "p"))
    photos = spark.read.parquet(str(tmp_path / "p"))
    whole = profiling.data_profile(rows, photos, photos)
    # the listings were counted by city when the plan was made; nothing reads them again
    assert not [f for f in whole.inputFiles() if f"{tmp_path}/l/" in f]
    assert profiling.city_counts(rows).count() < 500
    found = {(r["section"], r["metric"], r["key"]): r["value"] for r in whole.collect()}
    assert found["listings", "total rows", ""] == 500 and found["listings", "stay listings", ""] == 167
    assert found["listings", "missing values", "amenities"] == 250
    assert len([k for k in found if k[1] == "top city"]) == 5
    empty = profiling.listing_counts(rows.limit(0)).collect()
    assert {r["metric"]: r["value"] for r in empty} == {
        "total rows": 0, "stay listings": 0, "unique cities": 0, "with amenities": 0}


def test_a_kept_profile_reads_new_files_only(spark, tmp_path, monkeypatch):
    folder, state = str(tmp_path / "files"), str(tmp_path / "state")
    read = []
    plain = profile.read_files
    monkeypatch.setattr(profile, "read_files", lambda s, f: read.append(sorted(f)) or plain(s, f))

    def merged():
        rows = profile.merged_profile(sinks.read_table(spark, state)).collect()
        return {(r["metric"], r["key"]): r["value"] for r in rows}

    listings(spark, 20_000).coalesce(3).write.parquet(folder)
    assert profile.update_profile(spark, folder, state) == 3
    assert profile.update_profile(spark, folder, state) == 0 and len(read) == 1
    listings(spark, 10_000, 20_000).coalesce(1).write.mode("append").parquet(folder)
    assert profile.update_profile(spark, folder, state) == 1
    assert len(read[1]) == 1 and read[1][0] not in read[0]
    exact = {(r["metric"], r["key"]): r["value"] for r in profiling.listing_counts(
        profile.read_files(spark, read[0] + read[1]).drop("file")).collect()}
    found = merged()
    cities = ("unique cities", "")
    assert found.keys() == exact.keys()
    assert {k: v for k, v in found.items() if k != cities} == {
        k: v for k, v in exact.items() if k != cities}
    # three times the stated error
    assert abs(found[cities] / exact[cities] - 1) < 3 * 1.04 / 2 ** (profile.SKETCH_BITS / 2)
    os.remove(read[1][0])  # a file that is gone
    assert profile.update_profile(spark, folder, state) == 0
    assert merged()["total rows", ""] == 20_000
    monkeypatch.setattr(profile, "read_files", lambda s, f: plain(s, f).withColumn(
        "city", F.raise_error(F.lit("lost"))))
    listings(spark, 10, 50_000).write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="lost"):
        profile.update_profile(spark, folder, state)
    assert merged()["total rows", ""] == 20_000


@pytest.mark.parametrize("per_scan", [1000, 4])
def test_images_are_opened_by_name_and_missing_ones_are_invalid(spark, tmp_path, monkeypatch, per_scan):
    folder = tmp_path / "odd {name} [1]"
    folder.mkdir()
    for k in range(12):
        (folder / f"p {k}.png").write_bytes(_png(4, 3, bytes([k * 20]) * 36))
    (folder / "broken.png").write_bytes(b"no image")
    opened = []
    plain = images.read_images
    monkeypatch.setattr(images, "read_images", lambda s, f: opened.extend(f) or plain(s, f))
    wanted = [str(folder / f"p {k}.png") for k in range(8)] + [str(folder / "broken.png")]
    gone = [str(folder / "gone.png"), str(tmp_path / "nowhere" / "x.png")]

    def measured(paths):
        rows = spark.createDataFrame([(p,) for p in paths], "path string")
        return {r["path"]: r for r in images.measured_files(rows, per_scan).collect()}

    found = measured(wanted + wanted[:2] + [None])
    assert sorted(found) == sorted(wanted) and len(opened) == len(wanted)
    assert [found[p]["valid"] for p in wanted] == [True] * 8 + [False]
    assert found[wanted[3]]["brightness"] == 60 and found[wanted[3]]["width"] == 4
    found = measured(wanted + gone)
    assert [found[p]["valid"] for p in wanted + gone] == [True] * 8 + [False] * 3
    assert all(found[p]["phash"] is None and found[p]["width"] == 0 for p in gone)
    assert not any(r["valid"] for r in measured(gone).values())
    assert measured([]) == {}


def test_shuffle_files_of_a_cut_go_when_it_is_written(spark):
    def files():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {name for folder in disk.localDirs() for _, _, names in os.walk(folder.getPath())
                for name in names if name.startswith("shuffle_") and name.endswith(".data")}

    rows = spark.range(1000).withColumn("k", F.col("id") % 10)
    sums = rows.groupBy("k").agg(F.sum("id").alias("t"))
    before, switch = files(), spark.conf.get(session.CLEANUP)
    found = session.cut(rows.join(sums, "k"), "sums")
    until = time.time() + 20  # they are removed in the background
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(session.CLEANUP) == switch
    assert found.count() == 1000 and found.agg(F.sum("t")).first()[0] == 100 * sum(range(1000))
