"""Token-id files with a minimal perfect hash index (operator 7).

Layout of a store (a folder):

``blocks/``  one row per block: ``shard``, ``block``, ``keys``, ``occurrences`` and ``lengths`` (arrays,
             one entry per document), and ``ids``: the documents' ids one after the other as
             little-endian unsigned integers of ``width`` bytes (2 where the vocabulary allows).
``totals/``  ids per (shard, block) and the number of ids before it.
``index/``   one row per index partition: a minimal perfect hash over the partition's keys
             (``seeds``, one per bucket) and, by slot, the key's stored 32-bit ``fingerprints``
             and the place of its document (``shards``, ``blocks``, ``offsets``, ``lengths``).

Shards are ranges of the key, in ascending order, so the files as a whole hold all documents
in ascending key order. A lookup takes the key's partition, its bucket's seed, and its slot:
no search. The fingerprint tells unknown keys apart.

All files are written and read by Spark, so they may live in any store it reaches. Texts are
shuffled once, into their range. Null texts are empty: their ids are the end id alone. Repeated keys are
told apart by their occurrence (0, 1, ...) in the order of their texts; null keys come first. An
empty table gives an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, utf8
from .token_counts import default_tokenizer, encoder

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 20
#: Keys per index partition and per bucket of its hash, about.
INDEX_KEYS, BUCKET_KEYS = 4_096, 3
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hashes(keys: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
    """64-bit hashes of (key, occurrence); different for different first occurrences."""
    h = mix(keys.astype(np.int64).view(np.uint64) + _GOLD)
    return np.where(occurrences > 0, mix(h ^ mix(occurrences.astype(np.uint64) * _GOLD)), h)


class PerfectHash:
    """Minimal perfect hash: slot = mixed(key, seed of its bucket) modulo the number of keys.

    Buckets are settled from the largest down; each takes the first seed that sends all its
    keys to free slots.
    """

    def __init__(self, seeds: np.ndarray, keys: int):
        self.seeds, self.keys = seeds, keys

    @classmethod
    def over(cls, hashes: np.ndarray) -> PerfectHash:
        n = len(hashes)
        if len(np.unique(hashes)) < n:
            raise ValueError("two keys have one hash")
        buckets = max(1, n // BUCKET_KEYS)
        seeds = np.zeros(buckets, np.uint32)
        bucket = cls._bucket(hashes, buckets)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets), "right")
        sizes = np.diff(ends, prepend=0)
        free = np.ones(n, bool)
        tries = np.arange(64, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            own = hashes[order[ends[b] - sizes[b] : ends[b]]]
            start = 0
            while True:
                slots = cls._slots(own[None, :], (tries + np.uint64(start))[:, None], n)
                ok = free[slots].all(1)
                if ok.any() and sizes[b] > 1:
                    at = np.flatnonzero(ok)
                    inner = np.sort(slots[at], 1)
                    ok[at] = (inner[:, 1:] != inner[:, :-1]).all(1)
                if ok.any():
                    t = int(np.argmax(ok))
                    seeds[b] = start + t
                    free[slots[t]] = False
                    break
                start += 64
        return cls(seeds, n)

    @staticmethod
    def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
        return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)

    @staticmethod
    def _slots(hashes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
        return (mix(hashes ^ (seeds * _GOLD)) % np.uint64(n)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        seeds = self.seeds[self._bucket(hashes, len(self.seeds))].astype(np.uint64)
        return self._slots(hashes, seeds, self.keys)


def marks(hashes: np.ndarray) -> np.ndarray:
    """Stored fingerprints: bits that neither bucket nor partition uses alone."""
    return (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts, append ``end_id``, and write blocks, totals and index to ``path``.

    Keys are integers.
    """
    spark = docs.sparkSession
    vocabulary = tokenizer or default_tokenizer()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e = encoder(vocabulary)
        narrow = max(e.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        kind, width = (np.uint16, 2) if narrow else (np.uint32, 4)
        shard, block, last, times = TaskContext.get().partitionId(), 0, object(), 0
        keys, occurrences, lengths, payload, size = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "block": block, "keys": keys, "occurrences": occurrences, "lengths": lengths, "width": width, "ids": b"".join(payload)}],
                schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("keys", pa.list_(pa.int64())), ("occurrences", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("width", pa.int32()), ("ids", pa.binary())]),
            )

        for batch in pieces(batches):
            for k, (own, _) in zip(batch.column(0).to_pylist(), e.encode_all(utf8(batch.column(1))), strict=True):
                times, last = (times + 1, last) if k == last else (0, k)
                ids = np.append(own, np.uint32(end_id))
                keys.append(k)
                occurrences.append(times)
                lengths.append(len(ids))
                payload.append(ids.astype(kind).tobytes())
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield close()
                    block += 1
                    keys, occurrences, lengths, payload, size = [], [], [], [], 0
        if keys:
            yield close()

    picked = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    ranged = picked.repartitionByRange("key").sortWithinPartitions("key", "text")
    ranged.mapInArrow(blocks, _BLOCKS_DDL).write.parquet(f"{path}/blocks")
    written = spark.read.schema(_BLOCKS_DDL).parquet(f"{path}/blocks")
    _write_totals(written, path)
    _write_index(written, path)


def _write_totals(written: DataFrame, path: str) -> None:
    """Ids before each block: within its shard, and before the shard."""
    own = written.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    own = own.withColumn("inside", F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    shards = own.groupBy("shard").agg(F.sum("n").alias("n"))  # a row per shard
    before = shards.select("shard", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    totals = own.join(before, "shard").select("shard", "block", "n", (F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))).cast("long").alias("start"))
    totals.write.parquet(f"{path}/totals")


def _places(written: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per document: ``key``, ``occurrence``, ``shard``, ``block``, ``start`` and ``n``.

    ``start`` counts all ids before the document, over the whole store.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["lengths"], np.int64)
                at = np.cumsum(n) - n + row["start"]
                size = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.int64()), pa.array(row["occurrences"], pa.int64()), pa.array(np.full(size, row["shard"], np.int32)), pa.array(np.full(size, row["block"], np.int32)), pa.array(at), pa.array(n)],
                    names=["key", "occurrence", "shard", "block", "start", "n"],
                )

    rows = written.select("shard", "block", "keys", "occurrences", "lengths").join(totals.select("shard", "block", "start"), ["shard", "block"])
    rows = rows.select("shard", "block", "keys", "occurrences", "lengths", "start")
    return rows.mapInArrow(spread, "key long, occurrence long, shard int, block int, start long, n long")


def _partition(partitions: int):
    """Index partition of a key; not derived from the bits that the hash inside uses."""
    return F.pmod(F.xxhash64(F.coalesce("key", F.lit(0)), F.col("key").isNull(), "occurrence"), F.lit(partitions)).cast("int")


def _hashes(rows: pa.Table) -> np.ndarray:
    keys = rows.column("key")
    null = keys.is_null().to_numpy()
    hashes = key_hashes(keys.fill_null(0).to_numpy(), rows.column("occurrence").to_numpy())
    return np.where(null, mix(~hashes), hashes)


def _write_index(written: DataFrame, path: str) -> None:
    spark = written.sparkSession
    totals = spark.read.schema("shard int, block int, n long, start long").parquet(f"{path}/totals")
    documents = written.agg(F.sum(F.size("keys"))).first()[0] or 0
    partitions = max(1, -(-documents // INDEX_KEYS))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        h = _hashes(rows)
        perfect = PerfectHash.over(h)
        slot = perfect.slots(h)

        def placed(values: np.ndarray, kind: str) -> bytes:
            out = np.zeros(len(h), kind)
            out[slot] = values
            return out.tobytes()

        column = lambda name: rows.column(name).to_numpy()
        row = {
            "partition": key[0].as_py(), "seeds": perfect.seeds.astype("<u4").tobytes(), "keys": len(h), "fingerprints": placed(marks(h), "<u4"),
            "shards": placed(column("shard"), "<i4"), "blocks": placed(column("block"), "<i4"), "offsets": placed(column("start"), "<i8"), "lengths": placed(column("n"), "<i8"),
        }
        return pa.Table.from_pylist([row], schema=_INDEX)

    places = _places(written, totals).withColumn("partition", _partition(partitions))
    places.groupBy("partition").applyInArrow(build, _INDEX_DDL).withColumn("partitions", F.lit(partitions)).write.parquet(f"{path}/index")


_BLOCKS_DDL = "shard int, block int, keys array<long>, occurrences array<long>, lengths array<long>, width int, ids binary"
_INDEX = pa.schema([("partition", pa.int32()), ("seeds", pa.binary()), ("keys", pa.int64()), ("fingerprints", pa.binary()), ("shards", pa.binary()), ("blocks", pa.binary()), ("offsets", pa.binary()), ("lengths", pa.binary())])
_INDEX_DDL = "partition int, seeds binary, keys long, fingerprints binary, shards binary, blocks binary, offsets binary, lengths binary"


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Places of ``keys`` (``key``, ``occurrence``): plus ``shard``, ``block``, ``start``, ``n``.

    Keys whose stored fingerprint differs are unknown and give no row; an unknown key is
    taken for a known one with a chance of 2^-32.
    """
    index = spark.read.schema(_INDEX_DDL + ", partitions int").parquet(f"{path}/index")
    partitions = (index.select("partitions").first() or [1])[0]

    def find(key: tuple, held: pa.Table, rows: pa.Table) -> pa.Table:
        h = _hashes(rows)
        found = {c: np.zeros(0, np.int64) for c in ("shard", "block", "start", "n")}
        known = np.zeros(len(h), bool)
        if held.num_rows and len(h):
            row = held.to_pylist()[0]
            slot = PerfectHash(np.frombuffer(row["seeds"], "<u4"), row["keys"]).slots(h)
            known = np.frombuffer(row["fingerprints"], "<u4")[slot] == marks(h)
            found = {c: np.frombuffer(row[b], kind)[slot[known]] for c, b, kind in (("shard", "shards", "<i4"), ("block", "blocks", "<i4"), ("start", "offsets", "<i8"), ("n", "lengths", "<i8"))}
        rows = rows.filter(pa.array(known))
        return pa.table(
            {"key": rows.column("key"), "occurrence": rows.column("occurrence"), "shard": pa.array(found["shard"], pa.int32()), "block": pa.array(found["block"], pa.int32()), "start": pa.array(found["start"], pa.int64()), "n": pa.array(found["n"], pa.int64())}
        )

    asked = keys.select(F.col("key").cast("long").alias("key"), F.col("occurrence").cast("long").alias("occurrence")).withColumn("partition", _partition(partitions))
    return index.groupBy("partition").cogroup(asked.groupBy("partition")).applyInArrow(find, "key long, occurrence long, shard int, block int, start long, n long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Read the blocks back: ``key``, ``occurrence`` and ``ids`` (array of long) of every document."""
    return _read(spark, path, lambda ids: ids.astype(np.int64).tolist(), pa.list_(pa.int64()), "ids array<long>")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``key``, ``occurrence`` and the crc32 of the document's ids as little-endian uint32, as ``crc``."""
    return _read(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64(), "crc long")


def _read(spark: SparkSession, path: str, make, kind: pa.DataType, column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<u2" if row["width"] == 2 else "<u4")
                ends = np.cumsum(row["lengths"])
                out = [make(ids[e - n : e]) for e, n in zip(ends, row["lengths"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), pa.array(row["occurrences"], pa.int64()), pa.array(out, kind)], names=["key", "occurrence", "value"])

    name = column.split()[0]
    rows = spark.read.schema(_BLOCKS_DDL).parquet(f"{path}/blocks").select("keys", "occurrences", "lengths", "width", "ids")
    return rows.mapInArrow(run, "key long, occurrence long, " + column.replace(name, "value", 1)).withColumnRenamed("value", name)
