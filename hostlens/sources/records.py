"""CSV files with line breaks in cells, read by many tasks: records are cut by the parity of quotes.

A line break ends a record if an even number of quotes lies before it in the file. So a
file is scanned twice, in byte ranges as Spark splits text files: the first scan counts the
quotes of each range, and the parities of all ranges before tell where the second one starts,
inside a cell or not. What a range cuts off at its borders is put together afterwards, two
pieces a range at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlens.operators.sizing import broadcast_if_small
from hostlens.session import cut

# a record whose cells are quoted as a whole, with quotes inside doubled, or start without a quote
_WHOLE = r'(?s)\A(?:"(?:[^"]|"")*"|(?:[^",\n][^,\n]*)?)(?:,(?:"(?:[^"]|"")*"|(?:[^",\n][^,\n]*)?))*\z'
_SCHEMA = "record string, file string, block bigint, place bigint, follows boolean, goes_on boolean"


class StrayQuote(ValueError):
    """A quote that neither encloses a cell nor is doubled inside one."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with the byte range they start in."""
    return spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("serial"))


def _odd_ranges(lines: DataFrame) -> DataFrame:
    """(file, block) of the byte ranges that start inside a cell."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    ranges = cut(lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes")), "ranges")
    # one row for each byte range of a file
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("before", F.sum("quotes").over(before)).filter(
        F.col("before") % 2 == 1).select("file", "block", F.lit(True).alias("odd"))


def _joined(lines: list[str]) -> str:
    """One record of its lines; line ends are made `\\n` if the record ends like Windows lines."""
    record = "\n".join(lines)
    return record[:-1].replace("\r\n", "\n") if record.endswith("\r") else record


class _Cutter:
    """Cuts the lines of byte ranges, as they come, into records and pieces of records."""

    def __init__(self) -> None:
        self.range: tuple[str, int] | None = None
        self.rows: list[tuple[str, str, int, int, bool, bool]] = []

    def start(self, file: str, block: int, odd: bool) -> None:
        self.end()
        self.range, self.place = (file, block), 0
        self.follows, self.inside, self.pieces = odd, odd, []

    def end(self) -> None:
        if self.range is not None and (self.pieces or self.follows):
            self._put("\n".join(self.pieces), True)
        self.range = None

    def _put(self, record: str, goes_on: bool) -> None:
        if not (record or self.follows or goes_on):
            return  # an empty line between records
        self.rows.append((record, *self.range, self.place, self.follows, goes_on))
        self.place += 1
        self.follows = False

    def add(self, values: pa.Array) -> None:
        """The next lines of the range."""
        quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False)
        after = (np.cumsum(quotes) + self.inside) % 2
        ends = np.flatnonzero(after == 0)
        lines, at = values.to_pylist(), 0
        for end in ends.tolist():
            self.pieces += lines[at: end + 1]
            whole = not self.follows
            self._put(_joined(self.pieces) if whole else "\n".join(self.pieces), False)
            self.pieces, at = [], end + 1
        self.pieces += lines[at:]
        self.inside = bool(after[-1])

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 6
        self.rows = []
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["record", "file", "block", "place", "follows", "goes_on"])


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = _Cutter()
    for batch in batches:
        value, file, block, odd = (batch.column(k) for k in range(4))
        blocks = block.to_numpy(zero_copy_only=False)
        new = blocks[1:] != blocks[:-1]
        new |= pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for at, end in zip(edges[:-1], edges[1:], strict=True):
            if at == end:
                continue
            here = (file[at].as_py(), int(blocks[at]))
            if cutter.range != here:
                cutter.start(*here, bool(odd[at].as_py()))
            cutter.add(value.slice(at, end - at))
        yield cutter.taken()
    cutter.end()
    yield cutter.taken()


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Refuse records that a CSV parser would not end where the quotes say."""
    for batch in batches:
        record = batch.column(0)
        bad = pc.and_(pc.match_substring(record, '"'),
                      pc.invert(pc.match_substring_regex(record, _WHOLE)))
        if pc.any(bad).as_py():
            at = pc.index(bad, True).as_py()
            raise StrayQuote(
                f"stray quote in {batch.column(1)[at].as_py()}, near {record[at].as_py()[:200]!r}; "
                "read such files with split=False")
        yield batch


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, file, block, place) of every CSV record, headers and all; written once.

    A record belongs to the byte range that it starts in, and `place` counts within the
    range: (file, block, place) is the order of the input. Empty lines between records are
    left out. Cells must be quoted as a whole and quotes inside doubled; other quotes raise
    `StrayQuote`.
    """
    lines = _lines(spark, path)
    odd = broadcast_if_small(_odd_ranges(lines))
    marked = lines.join(odd, ["file", "block"], "left")
    # a broadcast keeps the order of lines, a shuffle does not
    marked = marked.sortWithinPartitions("file", "block", "serial").select(
        "value", "file", "block", F.coalesce("odd", F.lit(False)).alias("odd"))
    pieces = cut(marked.mapInArrow(_cut_records, _SCHEMA), "records")
    whole = pieces.filter("not follows and not goes_on").select("record", "file", "block", "place")
    # pieces of a file in order; each that does not follow another starts a record
    before = Window.partitionBy("file").orderBy("block", "place")
    torn = pieces.filter("follows or goes_on").withColumn("group", F.sum(
        F.when(F.col("follows"), 0).otherwise(1)).over(before))
    mended = torn.groupBy("file", "group").agg(F.array_sort(F.collect_list(
        F.struct("block", "place", "record"))).alias("parts"))
    text = F.col("text")
    mended = mended.select(
        F.array_join("parts.record", "\n").alias("text"), "file",
        F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["place"].alias("place"))
    mended = mended.select(F.when(text.endswith("\r"), F.regexp_replace(
        F.regexp_replace(text, "\r\n", "\n"), r"\r\z", "")).otherwise(text).alias("record"),
        "file", "block", "place")
    schema = "record string, file string, block bigint, place bigint"
    return whole.unionByName(mended).mapInArrow(_checked, schema)


def read_split_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Cells as text with a `row_key`, as a whole-file reader gives them; headers are dropped.

    `columns` are the names of the header, the same in each file. A record with fewer cells
    has nulls at its end, further cells are dropped.
    """
    records = read_records(spark, path).filter("block > 0 or place > 0")
    schema = ", ".join(f"c{k} string" for k in range(len(columns)))
    cells = F.from_csv("record", schema, {"escape": '"'})
    rows = records.select(cells.alias("cells"), F.struct(
        "file", "block", F.col("place").alias("serial")).alias("row_key"))
    return rows.select(*[F.col(f"cells.c{k}").alias(name) for k, name in enumerate(columns)],
                       "row_key")
