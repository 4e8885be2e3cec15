"""Token counts of documents in flat token files by a separator scan.

A flat file is a run of ids in which an end-of-document id closes each document; nothing says where documents
lie. Files are cut into blocks by size alone. A task searches its block for the end id with numpy and reports
the ids between ends, those before the first and those behind the last. A prefix scan over the blocks of a
file (ids so far, last end so far, ends so far) then stitches documents that run over block borders and
numbers them. A block is all that a task holds; the scan sees one narrow row for each block.

An end id with nothing before it is an empty document; ids behind the last end of a file are a last document
without end; an empty file has no documents; a document may be longer than many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yardframe.llm.tables import stored, text_of
from yardframe.llm.token_files import encoder, file_system, read_range, write_whole

BLOCK_BYTES = 1 << 22


def write_flat(docs: DataFrame, folder: str, vocabulary: str, end_id: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes docs to one flat file for each partition. Returns key, file, ordinal: what stands where, without lengths.

    Special tokens in a text are encoded as plain text, so the end id never occurs inside a document.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, plain_specials=True)
        end = np.array([end_id], enc.dtype).tobytes()
        name = f"{TaskContext.get().partitionId():06d}.ids"
        keys: list[pa.Array] = []

        def ids() -> Iterator[bytes]:
            for batch in batches:
                keys.append(batch.column("key"))
                for value in batch.column("text"):
                    yield enc.encode(value.as_py()) + end

        write_whole(f"{folder}/{name}", ids())
        done = 0
        for k in keys:
            yield pa.RecordBatch.from_arrays([k, pa.array([name] * len(k), pa.string()), pa.array(np.arange(done, done + len(k)))], ["key", "file", "ordinal"])
            done += len(k)

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    schema = rows.select("key").schema.add("file", "string").add("ordinal", "long")
    return stored(rows.mapInArrow(run, schema))


def scan_blocks(spark: SparkSession, folder: str, width: int, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block, ids, ends (places of the end id in the block, ascending)."""
    from pyarrow.fs import FileSelector, FileType

    step = max(1, block_bytes // width) * width
    system, inner = file_system(folder)
    files = [(f.base_name, f.size) for f in system.get_file_info(FileSelector(inner, allow_not_found=True)) if f.type == FileType.File and f.base_name.endswith(".ids")]
    table = spark.createDataFrame(files, "file string, bytes long")
    blocks = table.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("bytes") - 1) / step).cast("long"))).alias("block"))
    blocks = blocks.repartition(max(1, sum(-(-size // step) for _, size in files)), "file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, block in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "block")), strict=True):
                ids = np.frombuffer(read_range(f"{folder}/{name}", block * step, min(step, size - block * step)), f"<u{width}")
                ends = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block]), pa.array([len(ids)], pa.int64()),
                                                  pa.array([ends.tolist()], pa.list_(pa.int64()))], ["file", "block", "ids", "ends"])

    return blocks.mapInArrow(run, "file string, block long, ids long, ends array<long>")


def document_lengths(blocks: DataFrame) -> DataFrame:
    """file, ordinal, first (id of the document in its file), n_tokens (without the end id)."""
    blocks = stored(blocks)
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    narrow = blocks.select("file", "block", "ids", F.size("ends").alias("n_ends"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    narrow = narrow.withColumn("base", F.coalesce(F.sum("ids").over(ahead), F.lit(0)))
    narrow = narrow.withColumn("behind", F.when(F.col("n_ends") > 0, F.col("base") + F.col("last") + 1))
    carried = narrow.select("file", "block", "base", F.coalesce(F.sum("n_ends").over(ahead), F.lit(0)).alias("ordinal0"),
                            F.coalesce(F.max("behind").over(ahead), F.lit(0)).alias("open"))
    ends = blocks.join(carried, ["file", "block"]).select("file", "base", "ordinal0", "open", F.posexplode("ends").alias("i", "end"), "ends")
    first = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.element_at("ends", F.greatest(F.col("i"), F.lit(1))) + 1)
    closed = ends.select("file", (F.col("ordinal0") + F.col("i")).alias("ordinal"), first.alias("first"), (F.col("base") + F.col("end") - first).alias("n_tokens"))
    whole = narrow.groupBy("file").agg(F.sum("ids").alias("ids"), F.sum("n_ends").alias("ordinal"), F.coalesce(F.max("behind"), F.lit(0)).alias("first"))
    left = whole.where("ids > first").select("file", "ordinal", "first", (F.col("ids") - F.col("first")).alias("n_tokens"))
    return closed.unionByName(left)


def token_counts(docs: DataFrame, folder: str, vocabulary: str, end_id: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs to flat files and counts them by the scan: key, file, first, n_tokens; one row for each row of docs."""
    names = write_flat(docs, folder, vocabulary, end_id, key=key, text=text)
    lengths = document_lengths(scan_blocks(docs.sparkSession, folder, encoder(vocabulary, True).width, end_id))
    return names.join(lengths, ["file", "ordinal"]).select(F.col("key").alias(key), "file", "first", "n_tokens")
