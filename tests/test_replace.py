"""Replacing result tables: the old one is readable until the new one is whole."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hostlens.sources import replace, sinks


def values(df):
    return sorted(r[0] for r in df.collect())


def beside(path):
    return sorted(p.name for p in Path(path).parent.iterdir())


def failing(spark, n=1000):
    """Rows that can be written until the last ones raise."""
    return spark.range(n, numPartitions=4).select(F.when(
        F.col("id") > n - 5, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.write_table(spark.range(5), path)
    with pytest.raises(Exception, match="lost"):
        sinks.write_table(failing(spark), path)
    assert values(sinks.read_table(spark, path)) == [0, 1, 2, 3, 4]
    assert beside(path) == ["table"]
    with pytest.raises(Exception, match="lost"):  # also where there was none
        sinks.write_table(failing(spark), str(tmp_path / "fresh"))
    assert beside(path) == ["table"]
    sinks.write_table(spark.range(2), path)
    assert values(spark.read.parquet(path)) == [0, 1] and beside(path) == ["table"]


def test_a_table_may_be_made_from_the_one_it_replaces(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.write_table(spark.range(3), path)
    for _ in range(2):
        old = sinks.read_table(spark, path)
        sinks.write_table(old.unionByName(old.select((F.col("id") + 10).alias("id"))), path)
    assert len(values(sinks.read_table(spark, path))) == 12
    sinks.write_table(spark.range(0), path)
    assert values(sinks.read_table(spark, path)) == []


def test_a_driver_lost_between_the_renames_is_made_good(spark, tmp_path):
    path = str(tmp_path / "table")
    for again in (lambda: values(sinks.read_table(spark, path)) == [0, 1, 2],
                  lambda: sinks.write_table(failing(spark), path)):
        sinks.write_table(spark.range(3), path)
        Path(path).rename(tmp_path / "_table.old")
        (tmp_path / "_table.new-1").mkdir(exist_ok=True)
        try:
            assert again()
        except Exception as error:
            assert "lost" in str(error)
        assert values(sinks.read_table(spark, path)) == [0, 1, 2]
    # left after the switch, before the old folder went
    spark.range(9).write.parquet(str(tmp_path / "_table.old"))
    assert values(sinks.read_table(spark, path)) == [0, 1, 2]
    sinks.write_table(spark.range(4), path)
    assert values(sinks.read_table(spark, path)) == [0, 1, 2, 3]
    assert "_table.old" not in beside(path)


def test_tables_switch_together(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    replace.replace_tables({one: spark.range(1), two: spark.range(2)})
    with pytest.raises(Exception, match="lost"):
        replace.replace_tables({one: spark.range(5), two: failing(spark)})
    assert values(spark.read.parquet(one)) == [0] and values(spark.read.parquet(two)) == [0, 1]
    assert beside(one) == ["one", "two"]


def test_a_short_write_is_noticed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    sinks.write_table(spark.range(5), path)
    monkeypatch.setattr(replace.Observation, "get", {"n": 7})
    with pytest.raises(replace.IncompleteWrite):
        sinks.write_table(spark.range(6), path)
    assert len(values(sinks.read_table(spark, path))) == 5 and beside(path) == ["table"]


def test_reports_and_calibrations_are_replaced_alike(spark, tmp_path):
    path = str(tmp_path / "report")
    sinks.write_report(spark.range(3), path)
    sinks.write_report(spark.range(1).select(F.lit(None).cast("string").alias("x"), "id"), path)
    assert '"x":null' in "".join(p.read_text() for p in Path(path).glob("part-*"))
    line = spark.createDataFrame([(2.0, 3.0)], "slope double, intercept double")
    sinks.save_calibrator(line, str(tmp_path / "line"))
    Path(tmp_path / "line").rename(tmp_path / "_line.old")
    assert sinks.load_calibrator(spark, str(tmp_path / "line")) == (2.0, 3.0)
    with pytest.raises(ValueError, match="format"):
        replace.replace_tables({path: line}, "csv")
