"""Token ids as binary shards, with a minimal perfect hash index from document keys to their places.

Layout of a folder:
  shards/<n>.ids    raw ids of the documents of one key range, ascending by key, each followed by the end id
  index/<n>.mph     minimal perfect hash index of the keys with hash % (number of index files) == n
  manifest/         Parquet, a row for each shard: shard, ids in it, ids before it

An index file holds, for n keys, a displacement for every few keys and, by slot, the key's fingerprint,
shard, first id and number of ids. Looking a key up takes one displacement, one slot and one comparison of
fingerprints. Slots of a key are tried by displacement, largest groups first, until each key has its
own of exactly n slots.

Documents are range-partitioned by key and text hash into shards of about SHARD_TEXT bytes of text, so a task encodes and
writes one shard and holds one batch, and a key of very many rows (a null one, too) spreads over several. Index
files have at most KEYS_PER_FILE keys on average. Every file is written under a task's own name and renamed, so a
task that runs again replaces it by an equal one.

A null or empty text has only the end id. A null key comes last and has its own index entry. Rows that
repeat a key are all written, ordered by their text's hash; their index entry tells where the run begins and how many
ids it has, which may go on in the next shards, and the row table has each row's own place. An empty table gives no files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yardframe.llm.components import with_value_of_key
from yardframe.llm.tables import shared_dir, stored, text_of
from yardframe.llm.token_files import encoder, file_system, read_ranges, write_whole
from yardframe.llm.words import mix

KEYS_PER_FILE = 1 << 16
SHARD_TEXT = 1 << 26  # bytes of text whose ids make one shard
KEYS_PER_GROUP = 4
_SEEDS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("count", "<u8")])


def key_hash(key) -> F.Column:
    """64 bits of a key of any type; a null key has a hash of its own."""
    return F.xxhash64(key.isNull(), key.cast("string"))


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit hashes, by displacement of small groups."""

    def __init__(self, shift: np.ndarray, size: int):
        self.shift, self.size = shift, size

    @staticmethod
    def _slot(h: np.ndarray, shift: np.ndarray, size: int) -> np.ndarray:
        return (mix(h ^ (shift.astype(np.uint64) * _SEEDS[1])) % np.uint64(size)).astype(np.int64)

    @staticmethod
    def _group(h: np.ndarray, groups: int) -> np.ndarray:
        return (mix(h ^ _SEEDS[0]) % np.uint64(groups)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        size = len(h)
        groups = max(1, -(-size // KEYS_PER_GROUP))
        shift = np.zeros(groups, np.uint32)
        group = cls._group(h, groups)
        order = np.argsort(group, kind="stable")
        counts = np.bincount(group, minlength=groups)
        first = np.concatenate([[0], np.cumsum(counts)])
        taken = np.zeros(size, bool)
        step = 256
        for g in np.argsort(-counts, kind="stable"):
            if not counts[g]:
                break
            own = h[order[first[g] : first[g + 1]]]
            at = 0
            while True:  # ends: 2**32 displacements try all places again and again
                tries = np.arange(at, at + step, dtype=np.uint64)
                slots = cls._slot(own[None, :], tries[:, None], size)
                ok = ~taken[slots].any(axis=1)
                if len(own) > 1:
                    ok &= (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                if ok.any():
                    pick = int(ok.argmax())
                    shift[g] = at + pick
                    taken[slots[pick]] = True
                    break
                at += step
                if at >= 1 << 32:
                    raise ValueError("equal hashes in one index file")
        return cls(shift, size)

    def slots(self, h: np.ndarray) -> np.ndarray:
        return self._slot(h, self.shift[self._group(h, len(self.shift))], self.size)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ _SEEDS[2]) >> np.uint64(32)).astype(np.uint32)


def index_bytes(h: np.ndarray, shard: np.ndarray, first: np.ndarray, count: np.ndarray) -> bytes:
    hashed = PerfectHash.build(h)
    slots = np.zeros(len(h), SLOT)
    at = hashed.slots(h)
    for name, values in (("print", fingerprint(h)), ("shard", shard), ("first", first), ("count", count)):
        slots[name][at] = values
    return np.array([len(h), len(hashed.shift)], "<u8").tobytes() + hashed.shift.astype("<u4").tobytes() + slots.tobytes()


class Index:
    """One index file in memory."""

    def __init__(self, raw: bytes):
        size, groups = (int(x) for x in np.frombuffer(raw, "<u8", 2))
        self.hashed = PerfectHash(np.frombuffer(raw, "<u4", groups, 16), size)
        self.slots = np.frombuffer(raw, SLOT, size, 16 + 4 * groups)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Slots of the keys; a key that is not in the index gets count 0 (but for one in 2**32)."""
        if not len(self.slots):
            return np.zeros(len(h), SLOT)
        found = self.slots[self.hashed.slots(h)].copy()
        found["count"][found["print"] != fingerprint(h)] = 0
        return found


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Writes shards, index and manifest. Returns the stored row table: key, h, shard, first (id in its shard), count."""
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    parts = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_TEXT))
    order = [F.col("key").asc_nulls_last(), F.col("tie")]
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = rows.select("key", key_hash(F.col("key")).alias("h"), F.spark_partition_id().alias("shard"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        head = next((b for b in batches if b.num_rows), None)
        if head is None:
            return
        shard, places, done = head.column("shard")[0].as_py(), [], 0

        def ids() -> Iterator[bytes]:
            nonlocal done
            for batch in (b for source in ((head,), batches) for b in source):
                counts = []
                for value in batch.column("text"):
                    raw = enc.encode(value.as_py()) + end
                    counts.append(len(raw) // enc.width)
                    yield raw
                count = np.array(counts, np.int64)
                places.append((batch.column("key"), batch.column("h"), done + np.cumsum(count) - count, count))
                done += int(count.sum())

        write_whole(f"{folder}/shards/{shard:06d}.ids", ids())
        enc.forget()
        for keys, h, first, count in places:
            yield pa.RecordBatch.from_arrays([keys, h, pa.array(np.full(len(count), shard, np.int32)), pa.array(first), pa.array(count)],
                                             ["key", "h", "shard", "first", "count"])

    schema = rows.select("key", "h").schema.add("shard", "integer").add("first", "long").add("count", "long")
    spark = docs.sparkSession
    placed = stored(rows.mapInArrow(write, schema))
    totals = placed.groupBy("shard").agg(F.sum("count").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.withColumn("before", before).coalesce(1).write.parquet(f"{folder}/manifest")  # one row for each shard
    write_index(placed, folder)
    return placed


def index_files(n_keys: int) -> int:
    return max(1, -(-n_keys // KEYS_PER_FILE))


def write_index(placed: DataFrame, folder: str) -> None:
    begin = F.min(F.struct("shard", "first"))
    keys = placed.groupBy("h").agg(begin.alias("at"), F.sum("count").alias("count")).select("h", "at.shard", "at.first", "count")
    files = index_files(placed.select("h").distinct().count())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([b for b in batches if b.num_rows], schema)
        part = held.column("part").to_numpy()
        h = held.column("h").to_numpy().view(np.uint64)
        values = [held.column(c).to_numpy() for c in ("shard", "first", "count")]
        for p in np.unique(part):
            own = part == p
            write_whole(f"{folder}/index/{p:06d}.mph", [index_bytes(h[own], *(v[own] for v in values))])
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(part), pa.int32())], ["part"])

    schema = pa.schema([("h", pa.int64()), ("shard", pa.int32()), ("first", pa.int64()), ("count", pa.int64()), ("part", pa.int32())])
    part = F.pmod(F.col("h"), F.lit(files)).cast("int").alias("part")
    dealt = keys.select("h", "shard", "first", "count", part).repartition(files, "part")
    dealt.mapInArrow(build, "part int").count()


def find_tokens(keys: DataFrame, folder: str, *, key: str = "doc_id") -> DataFrame:
    """Keyed access for many keys at once: key, shard, first, count by index, without touching the shards.

    keys: a DataFrame of keys; each is sent to its index file, read once by a task.
    """
    system, inner = file_system(f"{folder}/index")
    files = len(system.get_file_info(FileSelector(inner, allow_not_found=True)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, Index] = {}
        for batch in batches:
            h, part = batch.column("h").to_numpy().view(np.uint64), batch.column("part").to_numpy()
            out = np.zeros(len(h), SLOT)
            for p in np.unique(part):
                if p not in opened:
                    store, path = file_system(f"{folder}/index/{p:06d}.mph")
                    with store.open_input_file(path) as source:
                        opened = {int(p): Index(source.read())}
                out[part == p] = opened[int(p)].look_up(h[part == p])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out["shard"].astype(np.int32)),
                                              pa.array(out["first"].astype(np.int64)), pa.array(out["count"].astype(np.int64))],
                                             ["key", "shard", "first", "count"])

    asked = keys.select(F.col(key).alias("key")).withColumn("h", key_hash(F.col("key")))
    if not files:
        return asked.select("key", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("count"))
    asked = asked.withColumn("part", F.pmod(F.col("h"), F.lit(files)).cast("int"))
    schema = asked.select("key").schema.add("shard", "integer").add("first", "long").add("count", "long")
    dealt = asked.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(look_up, schema)


def token_documents(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0,
                    folder: str | None = None) -> DataFrame:
    """Writes the files, looks every document up by its key, reads its ids back from the shards.

    key, start (ids of all documents before it), n_tokens (with the end id), ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers); one row for each row of docs.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    placed = write_tokens(docs, folder, vocabulary, key=key, text=text, end_id=end_id)
    width = encoder(vocabulary).width
    kind = placed.schema["key"].dataType
    keys = placed.groupBy("h").agg(F.min("key").alias("key"), F.count("*").alias("n"))
    found = find_tokens(keys, folder, key="key").select(key_hash(F.col("key")).alias("h"), F.col("shard").alias("run_shard"), F.col("first").alias("run_first"),
                                                        F.col("count").alias("run_count"))
    runs = stored(found.join(keys.select("h", "n", F.col("n").alias("rows")), "h"))
    # a key of one row is read where the index says; the rows of a longer run have their own places in it
    cut = with_value_of_key(placed, runs, "h")
    alone = F.col("rows") == 1
    cut = cut.select("key", *[F.when(alone, F.col(f"run_{c}")).otherwise(F.col(c)).alias(c) for c in ("shard", "first", "count")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype(f"<u{width}")
        for batch in batches:
            shard, first, count = (batch.column(c).to_numpy() for c in ("shard", "first", "count"))
            sums = np.zeros(len(shard), np.int64)
            for s in np.unique(shard):
                own = np.flatnonzero(shard == s)
                for i, raw in zip(own, read_ranges(f"{folder}/shards/{s:06d}.ids", first[own] * width, count[own] * width), strict=True):
                    sums[i] = zlib.crc32(np.frombuffer(raw, dtype).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], ["key", "shard", "first", "n_tokens", "ids_crc32"])

    schema = cut.select("key", "shard", "first").schema.add("n_tokens", "long").add("ids_crc32", "long")
    near = cut.repartition("shard").sortWithinPartitions("shard", "first")
    read_back = near.mapInArrow(read, schema)
    manifest = spark.read.schema("shard int, ids long, before long").parquet(f"{folder}/manifest")
    out = read_back.join(F.broadcast(manifest), "shard")  # one row for each shard
    return out.select(F.col("key").cast(kind).alias(key), (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
