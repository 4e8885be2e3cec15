"""Exact deduplication as a stateful stream.

The texts are normalised and hashed in one scan, which leaves a narrow table of digest, identifier and content locator
(file and row in it). A streaming aggregation keyed by the digest reads that table and keeps, in RocksDB and without
expiry, one state row per digest: the stable identifier of the row that stays, where its content lies, and
the number of rows. Spark sums each task's rows before they are shuffled, so a digest that a third of all
rows share sends one row per task. New files only update the state. For every group of more than one row the texts are
then read again through their locators and compared in full with the text that stays, large groups in salted
parts; rows that differ (a digest collision) are grouped by their text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yardframe.llm.components import with_value_of_key
from yardframe.llm.tables import shared_dir, stored, text_of

WHITE_SPACE = " \t\n\x0b\x0c\r"
#: State on disk; no file space in advance, as there are many small stores.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def normal_text(text: str) -> Column:
    """The text without [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(text_of(text), WHITE_SPACE, "")


def sha256_of(normal: Column) -> Column:
    return F.sha2(normal.cast("binary"), 256)


def order_of(points: str, key: str) -> Column:
    """Least for the row that stays: most code points, then the smallest id; a null id comes last."""
    return F.struct((-F.col(points)).alias("rank"), F.col(key).isNull().alias("no_key"), F.col(key).alias("key"))


GROUP_PART = 256  # rows of a group that are compared with one copy of the text that stays


def digest_rows(docs: DataFrame, *, key: str = "doc_id", text: str = "text", digest=sha256_of) -> DataFrame:
    """key, points (code points), digest, sha, file, row of every row of a table of files."""
    rows = docs.select(F.col(key).alias("key"), F.length(text_of(text)).cast("long").alias("points"), normal_text(text).alias("normal"),
                       F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.select("key", "points", digest(F.col("normal")).alias("digest"), sha256_of(F.col("normal")).alias("sha"), "file", "row")


def update_groups(rows: DataFrame, state_dir: str, groups_dir: str, *, key: str = "doc_id", text: str = "text", digest=sha256_of) -> None:
    """Feeds all documents that the stream of files `rows` has to offer into the keyed state, then ends.

    state_dir keeps the state and the stream's progress: calling again after new files arrived, or after a
    failure, goes on where the last call ended. groups_dir gets one folder of changed groups for each batch.
    """
    feed(digest_rows(rows, key=key, text=text, digest=digest), state_dir, groups_dir)


def feed(keyed: DataFrame, state_dir: str, groups_dir: str) -> None:
    """The same for a stream of digest rows."""
    best = F.min(F.struct(order_of("points", "key").alias("order"), F.col("file"), F.col("row")))
    groups = keyed.groupBy("digest").agg(best.alias("best"), F.count("*").alias("size"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{groups_dir}/batch={number}")

    spark = keyed.sparkSession
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        query = (groups.writeStream.outputMode("update").foreachBatch(write)
                 .option("checkpointLocation", state_dir).trigger(availableNow=True).start())
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()


def latest_groups(spark: SparkSession, groups_dir: str, key_type: str = "long") -> DataFrame:
    """digest, size, keep (id), keep_file, keep_row: the last state of every digest."""
    schema = (f"digest string, best struct<order: struct<rank: long, no_key: boolean, key: {key_type}>, file: string, row: long>, "
              "size long, batch int")
    changes = spark.read.schema(schema).option("basePath", groups_dir).parquet(groups_dir)
    last = changes.groupBy("digest").agg(F.max_by(F.struct("best", "size"), "batch").alias("s"))
    return last.select("digest", F.col("s.size").alias("size"), F.col("s.best.order.key").alias("keep"),
                       F.col("s.best.file").alias("keep_file"), F.col("s.best.row").alias("keep_row"))


def _located(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """rows (file, row, ...) with the normalised text that lies there."""
    texts = docs.select(F.col("_metadata.row_index").alias("row"), F.col("_metadata.file_path").alias("file"), F.col(text).alias("text"))
    return texts.join(rows, ["row", "file"]).withColumn("normal", normal_text("text")).drop("text")


def resolve(docs: DataFrame, rows: DataFrame, groups: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: key, keep_id, group_size, kept, text_sha256. rows: its stored digest rows.

    A null or empty text is the empty text, and so equals every text of white space only. Rows that repeat an
    id are rows of their own; of equal rows one is kept, the first by file and place in it. Ids may be of any type
    that sorts. An empty table gives no rows.
    """
    kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    marked = with_value_of_key(rows, groups.withColumn("n", F.col("size")), "digest").withColumn("kept", kept)
    hits = marked.where("size > 1").select("row", "file", "digest", "size", "kept")
    held = _located(docs, hits, text)
    parts = F.ceil(F.col("size") / GROUP_PART)
    keepers = held.where("kept").select("digest", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("normal").alias("kept_text"))
    others = held.where(~F.col("kept")).withColumn("part", F.pmod(F.xxhash64("row", "file"), parts))
    differ = stored(others.join(keepers, ["digest", "part"]).where("normal <> kept_text").select("digest").distinct())
    result = marked.select("key", "keep", "size", "kept", "sha", "digest")
    if not differ.isEmpty():
        # Digests collided: within those digests the text itself is the group.
        mixed = _located(docs, rows.join(differ, "digest", "left_semi"), text)
        best = F.min(F.struct(order_of("points", "key").alias("order"), F.col("file"), F.col("row")))
        by_text = mixed.groupBy("normal").agg(best.alias("best"), F.count("*").alias("size"))
        split = mixed.join(by_text, "normal").select(
            "key", F.col("best.order.key").alias("keep"), "size",
            ((F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))).alias("kept"), "sha", "digest")
        result = result.join(differ, "digest", "left_anti").select(result.columns).unionByName(split)
    return result.select(F.col("key").alias(key), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept",
                         F.col("sha").alias("text_sha256"))


def dedup_folder(spark: SparkSession, path: str, *, key: str = "doc_id", text: str = "text", bytes_per_batch: int = 1 << 36,
                 digest=sha256_of) -> DataFrame:
    """Deduplicates the Parquet table at `path`; its digest rows are streamed in batches of at most bytes_per_batch."""
    docs = spark.read.parquet(path)
    folder = shared_dir(spark)
    rows = digest_rows(docs, key=key, text=text, digest=digest)
    rows.write.parquet(f"{folder}/digests")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/digests")
    stream = spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(f"{folder}/digests")
    feed(stream, f"{folder}/state", f"{folder}/groups")
    groups = stored(latest_groups(spark, f"{folder}/groups", rows.schema["key"].dataType.simpleString()))
    return resolve(docs, rows, groups, key=key, text=text)
