"""Exact dedup of texts as a stream with keyed state that never expires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hostlens.llm.common import lower_az
from hostlens.session import cut, scratch_path

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # many small stores: no megabytes of disk set aside for each
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
# rows of one text that one task compares with the bytes of the row that stays
ROWS_PER_SALT = 4096


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased."""
    return F.sha2(lower_az(text), 256)


class StreamingDedup:
    """Deduplicates a growing folder of Parquet files.

    `advance()` feeds the files that came since the last call to a streaming
    aggregation. Its state is a RocksDB store in the checkpoint: one entry for
    each digest, kept for ever, of the best (doc_id, locator) so far and the
    number of rows. The locator (file, row in the file) finds the content again.
    State is partial per input partition before it is shuffled, so a text with
    very many copies costs a few rows.

    `decisions()` gives one row for each row seen: the row with the largest
    doc_id stays (null ids come last; of equal ids the last locator). Each row
    that hits another row's digest is compared with that row's bytes, found by
    its locator. Rows that differ in spite of equal digests (never seen with
    SHA-256; tests use a short digest) are grouped once more by their bytes.

    Null texts count as empty. Repeated rows are rows of their own, one stays.
    Other columns, also any named like a column used here, are not read. An
    empty folder gives an empty result.
    """

    def __init__(
        self, spark: SparkSession, path: str, state_path: str, schema: StructType,
        digest=text_digest, files_per_batch: int | None = None,
    ) -> None:
        self.spark, self.path, self.state_path = spark, path, state_path
        self.schema = StructType([schema["doc_id"], schema["text"]])
        self.digest, self.files_per_batch = digest, files_per_batch

    def _keyed(self, rows: DataFrame) -> DataFrame:
        locator = F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        return rows.select(
            "doc_id", "text", self.digest(F.col("text")).alias("digest"), locator.alias("locator"))

    def advance(self) -> None:
        """Take in all files not seen yet, in batches of `files_per_batch` files."""
        reader = self.spark.readStream.schema(self.schema)
        if self.files_per_batch:
            reader = reader.option("maxFilesPerTrigger", self.files_per_batch)
        # as a pattern: a stream takes a plain path for a folder, and the table may be one file
        path = self.path.rstrip("/")
        rows = self._keyed(reader.parquet(f"{path[:-1]}[{path[-1]}]"))
        state = rows.groupBy("digest").agg(
            F.max(F.struct("doc_id", "locator")).alias("keeper"),
            F.count(F.lit(1)).alias("group_size"),
        )
        conf = self.spark.conf
        before = {key: conf.get(key, None) for key in STATE_STORE}
        for key, value in STATE_STORE.items():
            conf.set(key, value)
        try:
            (state.writeStream.format("noop").outputMode("update")
                .option("checkpointLocation", self.state_path)
                .trigger(availableNow=True).start().awaitTermination())
        finally:
            for key, value in before.items():
                if value is None:
                    conf.unset(key)
                else:
                    conf.set(key, value)

    def state(self) -> DataFrame:
        """(digest, keeper id, keeper locator, rows): the keyed state as a table."""
        stored = self.spark.read.format("statestore").load(self.state_path)
        keeper, rows = (F.col(f"value.{name}") for name in stored.schema["value"].dataType.names)
        return stored.select(
            F.col("key.digest").alias("digest"), keeper["doc_id"].alias("keep_id"),
            keeper["locator"].alias("keep_locator"), rows.alias("group_size"))

    def decisions(self) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, digest) of every row taken in."""
        seen = self._keyed(self.spark.read.schema(self.schema).parquet(self.path))
        state = cut(self.state(), "dedup-state")
        joined = seen.drop("text").join(state, "digest")
        kept = F.col("locator") == F.col("keep_locator")
        # full bytes of hits against the bytes of the row that stays, salted for large groups;
        # the texts of groups are written once, so all texts are shuffled once only
        groups = state.filter("group_size > 1").withColumn(
            "salts", F.ceil(F.col("group_size") / ROWS_PER_SALT))
        # by locator, so that the texts of a large group never meet under one key
        slim = seen.select("digest", "locator").join(groups, "digest").select(
            "digest", "locator", "salts", (F.col("locator") == F.col("keep_locator")).alias("keeps"))
        hits = cut(seen.select("doc_id", "locator", lower_az(F.col("text")).alias("bytes"))
                   .join(slim, "locator"), "dedup-hits")
        keepers = hits.filter("keeps").select(
            "digest", F.col("bytes").alias("keep_bytes"), F.explode(F.sequence(
                F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
        apart = cut(
            hits.withColumn("salt", F.pmod(F.xxhash64("locator"), "salts"))
            .join(keepers, ["digest", "salt"])
            .filter(F.col("bytes") != F.col("keep_bytes"))
            .select("doc_id", "locator", "digest", "bytes"), "dedup-apart")
        own = apart.groupBy("digest", "bytes").agg(
            F.max(F.struct("doc_id", "locator")).alias("own"), F.count(F.lit(1)).alias("own_size"))
        regrouped = apart.join(own, ["digest", "bytes"]).select(
            "locator", F.col("own.doc_id").alias("own_id"), "own_size",
            (F.col("locator") == F.col("own.locator")).alias("own_kept"))
        lost = own.groupBy("digest").agg(F.sum("own_size").alias("lost"))
        return (
            joined.join(regrouped, "locator", "left").join(lost, "digest", "left")
            .select(
                "doc_id",
                F.when(F.col("own_size").isNull(), F.col("keep_id"))
                .otherwise(F.col("own_id")).alias("keep_id"),
                F.coalesce("own_size", F.col("group_size") - F.coalesce("lost", F.lit(0)))
                .alias("group_size"),
                F.coalesce("own_kept", kept).alias("kept"),
                "digest",
            )
        )


def streaming_dedup(spark: SparkSession, path: str, **options) -> DataFrame:
    """All rows of a Parquet table through a new state, and their decisions."""
    job = StreamingDedup(
        spark, path, scratch_path(spark, "dedup-state"), spark.read.parquet(path).schema, **options)
    job.advance()
    return job.decisions()
