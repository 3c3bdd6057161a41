"""Line dedup that can be taken back: cuckoo filters over exact reference counts (operator 9).

The exact reference-count table holds, per line key (128-bit digest of the stripped,
ASCII-lower-cased line), the number of documents with that line. ``insert`` and ``delete``
add and subtract documents, so a document can be taken out again and the table is as if it
had never come. Keys that reach ``min_docs`` go into cuckoo filters, one per shard of keys;
a filter drops a key again when its count falls below. When lines are removed, the filter
answers first, and only lines that it lets through are looked up in the exact counts.

Only digests are shuffled, counted inside each task first; a line that is in a third of all
documents is one row per task. Filters and the exact keys above the threshold are sent to the
tasks when together they measure at most ``SEND_BYTES``. Beyond that digests go to the filters: those of a shard
meet its filter in a cogroup, a shard with many lines in parts, and what passes meets the exact
table in a join that adaptive execution splits where it is skewed. A filter that has no room for new keys is built
anew from the counts of its shard, with room for them.

Null and empty texts are one empty line. Keys of fewer than ``min_chars`` code points are
never dropped. A repeated row is another document. An empty table gives an empty one. Only id and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, pieces, utf8, write_once

#: Largest measured size of filters and exact keys that is sent to every task.
SEND_BYTES = 64 << 20
#: Keys per filter shard, about; most shards; lines that meet a filter in one task, about.
SHARD_KEYS, SHARDS_MOST, PART_LINES = 50_000, 65_536, 500_000
_SLOTS = 4
_MAX_KICKS = 500


def line_keys(text: bytes) -> list[bytes]:
    """Keys of a text's lines: blanks stripped at both ends, A-Z lower-cased."""
    return [x.strip(BLANKS) for x in text.lower().split(b"\n")]


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """16-bit fingerprints in buckets of four; insertion, deletion, vectorised lookup."""

    def __init__(self, buckets: int):
        self.buckets = 1 << max(2, int(np.ceil(np.log2(max(1, buckets)))))
        self.slots = np.zeros((self.buckets, _SLOTS), np.uint16)

    @classmethod
    def holding(cls, low: np.ndarray, high: np.ndarray) -> CuckooFilter:
        """A filter with all keys, given as two uint64 halves; doubled until they fit."""
        size = len(low) / _SLOTS / 0.85 + 1
        while True:
            f = cls(int(size))
            if all(f.insert(int(a), int(b)) for a, b in zip(low, high, strict=True)):
                return f
            size = f.buckets * 2

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        f = cls.__new__(cls)
        f.slots = np.frombuffer(data, np.uint16).reshape(-1, _SLOTS).copy()
        f.buckets = len(f.slots)
        return f

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def _place(self, low: int, high: int) -> tuple[int, int]:
        return low & (self.buckets - 1), (high & 0xFFFF) or 1

    def insert(self, low: int, high: int) -> bool:
        bucket, mark = self._place(low, high)
        for b in (bucket, self._other(bucket, mark)):
            free = np.flatnonzero(self.slots[b] == 0)
            if len(free):
                self.slots[b, free[0]] = mark
                return True
        for kick in range(_MAX_KICKS):
            b = self._other(b, mark)
            free = np.flatnonzero(self.slots[b] == 0)
            if len(free):
                self.slots[b, free[0]] = mark
                return True
            slot = (mark + kick) % _SLOTS
            mark, self.slots[b, slot] = int(self.slots[b, slot]), mark
        return False

    def delete(self, low: int, high: int) -> bool:
        bucket, mark = self._place(low, high)
        for b in (bucket, self._other(bucket, mark)):
            held = np.flatnonzero(self.slots[b] == mark)
            if len(held):
                self.slots[b, held[0]] = 0
                return True
        return False

    def maybe(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each key may be held; never false for a held key."""
        bucket = low & np.uint64(self.buckets - 1)
        mark = high & np.uint64(0xFFFF)
        mark[mark == 0] = 1
        other = (bucket ^ (mark * np.uint64(0x5BD1E995))) & np.uint64(self.buckets - 1)
        m = mark.astype(np.uint16)[:, None]
        return (self.slots[bucket] == m).any(1) | (self.slots[other] == m).any(1)


def reference_counts(docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """Exact counts: ``digest`` (16 bytes) and ``n``, the number of documents with the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counts: dict[bytes, int] = {}
            for t in utf8(batch.column(0)):
                for k in set(line_keys(t)):
                    if len(k) >= min_chars and (min_chars <= 1 or len(k.decode()) >= min_chars):
                        d = digest(k)
                        counts[d] = counts.get(d, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "n"])

    lines = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "digest binary, n long")
    return lines.groupBy("digest").agg(F.sum("n").alias("n"))


def insert(counts: DataFrame, docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """Reference counts after more documents."""
    return _changed(counts, reference_counts(docs, text, min_chars))


def delete(counts: DataFrame, docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """Reference counts after documents have gone; lines of none are left out."""
    return _changed(counts, reference_counts(docs, text, min_chars).withColumn("n", -F.col("n")))


def _changed(counts: DataFrame, change: DataFrame) -> DataFrame:
    return counts.select("digest", "n").unionByName(change).groupBy("digest").agg(F.sum("n").alias("n")).where("n > 0")


def _shard(shards: int) -> Column:
    """Shard by the digest's last four bytes; :meth:`Probe.frequent` does the same."""
    return (F.conv(F.hex(F.substring("digest", 13, 4)), 16, 10).cast("long") % shards).cast("int")


def _shard_count(keys: int) -> int:
    return min(SHARDS_MOST, max(64, keys // SHARD_KEYS))


def _built(held: DataFrame) -> DataFrame:
    """One filter per ``shard`` over its digests."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        low, high = _halves(rows.column("digest").to_pylist())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([CuckooFilter.holding(low, high).to_bytes()], pa.binary())})

    return held.groupBy("shard").applyInArrow(build, "shard int, filter binary")


def filters(counts: DataFrame, min_docs: int = 10, shards: int | None = None) -> DataFrame:
    """One cuckoo filter per shard over the keys in at least ``min_docs`` documents: ``shard``, ``filter``."""
    held = counts.where(F.col("n") >= min_docs).select("digest")
    shards = shards or _shard_count(held.count())
    return _built(held.withColumn("shard", _shard(shards)))


def update_filters(held: DataFrame, before: DataFrame, after: DataFrame, shards: int, min_docs: int = 10) -> DataFrame:
    """Filters after a change of counts: only keys that crossed the threshold go in or out.

    A filter that is full, and that of a shard that had none, is built from the counts after the change.
    """
    old = before.where(F.col("n") >= min_docs).select("digest", F.lit(True).alias("was"))
    new = after.where(F.col("n") >= min_docs).select("digest", F.lit(True).alias("is"))
    crossed = old.join(new, "digest", "full").where("was is null or is is null")
    crossed = crossed.select(_shard(shards).alias("shard"), "digest", F.col("is").isNotNull().alias("is"))

    def change(key: tuple, state: pa.Table, rows: pa.Table) -> pa.Table:
        data = state.column("filter").to_pylist()
        kept = None
        if data:
            f = CuckooFilter.from_bytes(data[0])
            now = rows.column("is").to_pylist()
            digests = rows.column("digest").to_pylist()
            for a, b in zip(*_halves([d for d, n in zip(digests, now, strict=True) if not n]), strict=True):
                f.delete(int(a), int(b))
            low, high = _halves([d for d, n in zip(digests, now, strict=True) if n])
            if all(f.insert(int(a), int(b)) for a, b in zip(low, high, strict=True)):
                kept = f.to_bytes()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([kept], pa.binary())})

    changed = held.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(change, "shard int, filter binary")
    changed = write_once(changed, "line-filters")
    full = changed.where("filter is null").select("shard")  # at most SHARDS_MOST numbers
    anew = after.where(F.col("n") >= min_docs).select("digest", _shard(shards).alias("shard"))
    return changed.where("filter is not null").unionByName(_built(anew.join(F.broadcast(full), "shard")))


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


class Probe:
    """Sharded filters with the exact keys behind them, as sent to a task."""

    def __init__(self, shards: int, parts: dict[int, bytes], exact: bytes):
        self.shards, self.parts, self.exact_bytes = shards, parts, exact

    def ready(self) -> Probe:
        if not hasattr(self, "exact"):
            self.filters = {s: CuckooFilter.from_bytes(b) for s, b in self.parts.items()}
            self.exact = {self.exact_bytes[i : i + 16] for i in range(0, len(self.exact_bytes), 16)}
        return self

    def frequent(self, digests: list[bytes]) -> list[bool]:
        """The filter answers first; what it lets through is looked up exactly."""
        if not digests:
            return []
        low, high = _halves(digests)
        shard = np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4)[:, 3] % self.shards
        maybe = np.zeros(len(digests), bool)
        for s in np.unique(shard).tolist():
            if (f := self.filters.get(s)) is not None:
                own = np.flatnonzero(shard == s)
                maybe[own] = f.maybe(low[own], high[own])
        return [bool(m) and d in self.exact for m, d in zip(maybe, digests, strict=True)]


def _digests(text: bytes) -> list[bytes]:
    """One digest per line; that of an empty key belongs to no line."""
    return [digest(k) if k else bytes(16) for k in line_keys(text)]


def _without(text: bytes, gone: list[bool]) -> tuple[int, int, bytes]:
    """Number of lines, lines dropped, and the text that stays."""
    if not any(gone):
        return len(gone), 0, text
    kept = [x for x, g in zip(text.split(b"\n"), gone, strict=True) if not g]
    return len(gone), len(gone) - len(kept), b"\n".join(kept)


_OUT = "n_lines long, n_dropped long, kept string"


def _rows(batch: pa.RecordBatch, cleaned: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    n, gone, kept = zip(*cleaned, strict=True)
    arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["key", "n_lines", "n_dropped", "kept"])


def drop_lines(docs: DataFrame, counts: DataFrame, min_docs: int = 10, min_chars: int = 1, key: str = "doc_id", text: str = "text", send_bytes: int = SEND_BYTES) -> DataFrame:
    """``key``, ``n_lines``, ``n_dropped`` and ``kept`` text of every row.

    ``counts`` is the reference-count table, already written.
    """
    spark = docs.sparkSession
    frequent = counts.where(F.col("n") >= min_docs).select("digest")
    n = frequent.count()
    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    shards = _shard_count(n)
    if n * 24 > send_bytes:
        return _by_shards(picked, counts, min_docs, shards, kind).withColumnRenamed("key", key)
    parts = {r["shard"]: bytes(r["filter"]) for r in filters(counts, min_docs, shards).collect()}
    exact = b"".join(sorted(bytes(r["digest"]) for r in frequent.collect()))
    shared = spark.sparkContext.broadcast(Probe(shards, parts, exact))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = shared.value.ready()
        for batch in pieces(batches):
            texts = utf8(batch.column(1))
            own = [_digests(t) for t in texts]
            gone = iter(probe.frequent([d for ds in own for d in ds]))
            yield _rows(batch, [_without(t, list(islice(gone, len(ds)))) for t, ds in zip(texts, own, strict=True)])

    return picked.mapInArrow(run, f"key {kind}, {_OUT}").withColumnRenamed("key", key)


def _by_shards(picked: DataFrame, counts: DataFrame, min_docs: int, shards: int, kind: str) -> DataFrame:
    """The same where the frequent keys are too many to send: digests go to the filter of their shard."""
    rows = picked.withColumn("row", F.xxhash64("key", "text"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            pairs = [(r, digest(k)) for r, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True) for k in set(line_keys(t)) if k]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())], names=["row", "digest"])

    def ask(lines: pa.Table, state: pa.Table) -> pa.Table:
        data = state.column("filter").to_pylist()
        if not data or not lines.num_rows:
            return lines.select(["row", "digest"]).slice(0, 0)
        maybe = CuckooFilter.from_bytes(data[0]).maybe(*_halves(lines.column("digest").to_pylist()))
        return lines.select(["row", "digest"]).filter(pa.array(maybe))

    # lines of each shard are known from the counts, so are the parts that they are dealt to
    load = F.ceil(F.sum("n") / PART_LINES).cast("long").alias("parts")
    loads = write_once(counts.groupBy(_shard(shards).alias("shard")).agg(load), "line-loads")
    lines = rows.select("row", "text").mapInArrow(explode, "row long, digest binary").withColumn("shard", _shard(shards))
    lines = lines.join(F.broadcast(loads), "shard").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")
    asked = filters(counts, min_docs, shards).join(loads, "shard")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    passed = lines.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(ask, "row long, digest binary")
    frequent = counts.where(F.col("n") >= min_docs).select("digest")
    hits = passed.join(frequent, "digest", "left_semi").groupBy("row").agg(F.collect_set("digest").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            gone = [set(g or ()) for g in batch.column(2).to_pylist()]
            yield _rows(batch, [_without(t, [d in g for d in _digests(t)]) for t, g in zip(utf8(batch.column(1)), gone, strict=True)])

    joined = rows.join(hits, "row", "left").select("key", "text", "gone")
    return joined.mapInArrow(run, f"key {kind}, {_OUT}")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Count the lines of ``docs`` (written once) and drop those in at least ``min_docs`` of them."""
    counts = write_once(reference_counts(docs, text, min_chars), "line-counts")
    return drop_lines(docs, counts, min_docs, min_chars, key, text)
