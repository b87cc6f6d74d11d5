"""Replacing result tables so that a lost driver or a failed job never leaves none.

A result is written to a folder of its own beside the target, read back and compared with
what was written, and only then takes the target's place: the old folder steps aside, the
new one moves in, the old one goes. Folder renames are the only changes a reader can meet.
If the job ends between the two renames, the old folder still lies beside the target, and
the next reader or writer of this module puts it back.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "json")


class IncompleteWrite(RuntimeError):
    """What was read back is not what was written."""


@dataclass
class _Folder:
    """A folder in any store that the session's Hadoop configuration reaches."""

    spark: SparkSession
    path: str

    def _hadoop(self):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        store, path = self._hadoop()
        return store.exists(path)

    def move_to(self, other: _Folder) -> None:
        store, path = self._hadoop()
        if not store.rename(path, other._hadoop()[1]):
            raise OSError(f"could not rename {self.path} to {other.path}")

    def delete(self) -> None:
        store, path = self._hadoop()
        store.delete(path, True)

    def beside(self, mark: str) -> _Folder:
        """A sibling that readers of the parent folder skip."""
        parent, _, name = self.path.rstrip("/").rpartition("/")
        hidden = f"_{name}.{mark}"
        return _Folder(self.spark, f"{parent}/{hidden}" if parent or self.path.startswith("/")
                       else hidden)


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in any store that Spark reads."""
    return _Folder(spark, path).exists()


def recovered(spark: SparkSession, path: str) -> str:
    """The path, its former folder put back if a replacement ended half-way."""
    target = _Folder(spark, path)
    former = target.beside("old")
    if not target.exists() and former.exists():
        former.move_to(target)
    return path


def _staged(df: DataFrame, path: str, fmt: str, options: dict[str, str]) -> _Folder:
    """Write beside the target and check the number of rows that can be read back."""
    spark = df.sparkSession
    folder = _Folder(spark, path).beside(f"new-{uuid.uuid4().hex}")
    seen = Observation()
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.format(fmt).options(
            **options).save(folder.path)
        written = seen.get["n"]
        found = spark.read.schema(df.schema).format(fmt).load(folder.path).count()
        if found != written:
            raise IncompleteWrite(f"{written} rows written to {path}, {found} found")
    except BaseException:
        folder.delete()
        raise
    return folder


def replace_tables(tables: dict[str, DataFrame], fmt: str = "parquet",
                   options: dict[str, str] | None = None) -> None:
    """Write each frame to its path; no path changes before all frames are written whole.

    A frame may read the table it replaces. Earlier formats of a path don't matter.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown result format: {fmt}")
    staged: list[tuple[_Folder, _Folder]] = []
    try:
        for path, df in tables.items():
            recovered(df.sparkSession, path)
            staged.append((_Folder(df.sparkSession, path), _staged(df, path, fmt, options or {})))
    except BaseException:
        for _, folder in staged:
            folder.delete()
        raise
    for target, folder in staged:
        former = target.beside("old")
        if target.exists():
            if former.exists():  # left by a job that ended after its switch
                former.delete()
            target.move_to(former)
        folder.move_to(target)
        former.delete()
        # a session remembers the files of a folder it has read
        target.spark.catalog.refreshByPath(target.path)
