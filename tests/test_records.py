"""CSV files with line breaks in cells, cut into records by many tasks."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from hostlens.sources import records, tables


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few lines, so that most borders lie inside cells."""
    conf = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "0",
            "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def some_rows(rng, n):
    cell = ["plain", "", "two\nlines", 'a "quoted" word', "x,y", "é🏠\n\n\n", '"', "NA", "a" * 40,
            "\n" * 5, '","', "line\nline\n" * 20]
    return [[f"id{k}", *(rng.choice(cell) for _ in range(3))] for k in range(n)]


def written(rows, ends="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    table = csv.writer(out, lineterminator=ends, quoting=quoting)
    table.writerow(["listing_id", "name", "odd `name`", "description"])
    table.writerows(rows)
    return out.getvalue()


def in_order(df):
    return [tuple(r)[:-1] for r in df.orderBy("row_key").collect()]


@pytest.mark.parametrize("ends,quoting", [("\n", csv.QUOTE_MINIMAL), ("\r\n", csv.QUOTE_MINIMAL),
                                          ("\n", csv.QUOTE_ALL)])
def test_split_files_have_the_rows_of_whole_ones(spark, tmp_path, small_ranges, ends, quoting):
    rng = random.Random(len(ends) + quoting)
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"part-{k}.csv").write_text(written(some_rows(rng, 45), ends, quoting), newline="")
    (folder / "part-2.csv").write_text(written([]), newline="")
    whole = tables.read_cells(spark, str(folder), split=False)
    split = tables.read_cells(spark, str(folder))
    assert split.dtypes == whole.dtypes
    assert in_order(split) == in_order(whole) and split.count() == 90
    assert records._lines(spark, str(folder)).rdd.getNumPartitions() > 8
    assert tables.read_listings(spark, str(folder)).count() == 90


def test_one_cell_may_span_many_ranges(spark, tmp_path, small_ranges):
    long = "\n".join(f'line {k} of one cell, "quoted"' for k in range(150))
    rows = [["a", "x", "y", long], ["b", long, "", "z"], ["c", "", "", ""]]
    (tmp_path / "one.csv").write_text(written(rows) + "\n\n")
    path = str(tmp_path / "one.csv")
    assert in_order(tables.read_cells(spark, path)) == in_order(
        tables.read_cells(spark, path, split=False))
    assert {r["description"] for r in tables.read_listings(spark, path).collect()} == {long, "z", ""}
    # a file without a last line break, and one with a record of too few and too many cells
    (tmp_path / "two.csv").write_text('listing_id,name\n1,"a\nb"\n2\n3,x,"more\ncells"\n4,"end\nhere"')
    path = str(tmp_path / "two.csv")
    got = in_order(tables.read_cells(spark, path))
    assert got == [("1", "a\nb"), ("2", None), ("3", "x"), ("4", "end\nhere")]
    assert got == in_order(tables.read_cells(spark, path, split=False))


def test_many_odd_ranges_are_joined_by_shuffle(spark, tmp_path, small_ranges, monkeypatch):
    monkeypatch.setattr(records, "broadcast_if_small", lambda keys: keys.hint("merge"))
    (tmp_path / "one.csv").write_text(written(some_rows(random.Random(5), 60)))
    path = str(tmp_path / "one.csv")
    assert in_order(tables.read_cells(spark, path)) == in_order(
        tables.read_cells(spark, path, split=False))


def test_stray_quotes_are_refused_or_read_whole(spark, tmp_path, small_ranges):
    fine = 'listing_id,name\n1,5 " wide and 6 " tall\n2, "x"\n3,ok\n'
    (tmp_path / "fine.csv").write_text(fine)
    path = str(tmp_path / "fine.csv")
    assert in_order(tables.read_cells(spark, path)) == in_order(
        tables.read_cells(spark, path, split=False))
    for bad in ('listing_id,name\n1,5" tall\n2,6" wide\n', 'listing_id,name\n1,a"b,"c\n2,x"\n'):
        (tmp_path / "bad.csv").write_text(bad)
        path = str(tmp_path / "bad.csv")
        with pytest.raises(Exception, match="stray quote"):
            tables.read_cells(spark, path)
        assert tables.read_cells(spark, path, split=False).count() > 0


def test_records_keep_their_order_key(spark, tmp_path, small_ranges):
    (tmp_path / "one.csv").write_text(written(some_rows(random.Random(6), 50)))
    rows = records.read_records(spark, str(tmp_path / "one.csv"))
    ids = [r[0].split(",")[0] for r in rows.orderBy("file", "block", "place").collect()]
    assert ids == ["listing_id", *(f"id{k}" for k in range(50))]
    assert rows.select(F.countDistinct("block", "place")).first()[0] == 51
