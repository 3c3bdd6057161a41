"""Document fingerprints from prefix polynomial hashes (operator 10).

For each text, arrays hold the polynomial hash of every prefix, modulo two primes near 2^32.
Two array reads give the hash of any span, so spans of any two texts are compared in constant
time, and the longest common extension of two texts, from any two places or back from their
ends, is found by binary search. A text's fingerprint is its length and whole-text hashes. The
likeness of two texts is the share of the longer one that spans common to both cover, in order: after a difference of at
most ``APART`` code points on either side the comparison goes on where ``ANCHOR`` code points are equal again, and
after a longer one with the common end.
The hashes of an edited text follow from those of the two texts it is put together from.

Texts are shuffled once, into ranges of the key; each task streams its range in order and
holds two texts at a time. Only the texts at the ends of ranges meet in a second, small step.
The arrays take about 20 bytes per code point of the two texts at hand.

Null texts count as empty. Equal texts have equal fingerprints; two empty texts have likeness
1. The next document is that of the next (key, text) in ascending order, null keys first, so repeated
rows follow each other; a single row is its own next. An empty table gives an empty one.
Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, write_once

#: Primes below 2^32 and the polynomials' bases.
PRIMES = (4294967291, 4294967279)
BASES = (2654435769, 1640531513)
#: Code points of a difference that is passed over, and of what must be equal behind it.
APART, ANCHOR = 256, 24


class Powers:
    """Powers of the bases, grown as texts need them."""

    def __init__(self):
        self.tables = [np.ones(1, np.uint64) for _ in PRIMES]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) <= n:
            for i, (p, r) in enumerate(zip(PRIMES, BASES, strict=True)):
                t = self.tables[i]
                self.tables[i] = np.concatenate([t, t * np.uint64(int(t[-1]) * r % p) % np.uint64(p)])
        return self.tables


_powers = Powers()


class PrefixHashes:
    """Hashes of every prefix of a text: ``sum of (code point + 1) x base^position``."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        self.text, self.n = text, len(codes)
        self.prefix = []
        for p, powers in zip(PRIMES, _powers.upto(self.n), strict=True):
            h = np.zeros(self.n + 1, np.uint64)
            np.cumsum(codes * powers[: self.n] % np.uint64(p), out=h[1:])
            self.prefix.append(h % np.uint64(p))

    def upto(self, i: int, m: int) -> int:
        """Hash number ``m`` of the first ``i`` code points."""
        return int(self.prefix[m][i])


class Spliced:
    """Prefix hashes of a text's first ``cut`` code points followed by another's first ``more``."""

    def __init__(self, head: PrefixHashes, cut: int, tail: PrefixHashes, more: int):
        self.head, self.cut, self.tail, self.n = head, cut, tail, cut + more
        self.text = head.text[:cut] + tail.text[:more]

    def upto(self, i: int, m: int) -> int:
        if i <= self.cut:
            return self.head.upto(i, m)
        shift = int(_powers.upto(self.cut)[m][self.cut])
        return (self.head.upto(self.cut, m) + shift * self.tail.upto(i - self.cut, m)) % PRIMES[m]


def same_span(x, i: int, y, j: int, length: int, moduli: range = range(len(PRIMES))) -> bool:
    """Whether ``x[i:i+length]`` and ``y[j:j+length]`` have equal hashes."""
    for m in moduli:
        p, powers = PRIMES[m], _powers.upto(max(i, j))[m]
        a = (x.upto(i + length, m) - x.upto(i, m)) * int(powers[j])
        b = (y.upto(j + length, m) - y.upto(j, m)) * int(powers[i])
        if (a - b) % p:
            return False
    return True


def common_extension(x, y, back: bool = False, i: int = 0, j: int = 0) -> int:
    """Length of the longest common span from the places ``i`` and ``j`` of two texts (or, with ``back``, at their ends)."""

    def same(k: int, moduli: range) -> bool:
        return same_span(x, x.n - k, y, y.n - k, k, moduli) if back else same_span(x, i, y, j, k, moduli)

    def search(moduli: range) -> int:
        low, high = 0, min(x.n - i, y.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if same(middle, moduli) else (low, middle - 1)
        return low

    found = search(range(1))  # one modulus leads; both confirm
    return found if same(found, range(len(PRIMES))) else search(range(len(PRIMES)))


def fingerprint(x) -> str:
    return f"{x.n:x}-" + "".join(f"{x.upto(x.n, m):08x}" for m in range(len(PRIMES)))


def behind_difference(a: str, i: int, b: str, j: int) -> tuple[int, int] | None:
    """The nearest places behind ``i`` and ``j`` from which the texts are equal for a while; None beyond ``APART``."""
    there: dict[str, int] = {}
    for q in range(j, min(j + APART, len(b) - ANCHOR) + 1):
        there.setdefault(b[q : q + ANCHOR], q)
    best = None
    for p in range(i, min(i + APART, len(a) - ANCHOR) + 1):
        q = there.get(a[p : p + ANCHOR])
        if q is not None and (best is None or p - i + q - j < best[0]):
            best = p - i + q - j, p, q
    return best and best[1:]


def likeness(x, y) -> float:
    """Share of the longer text covered by common spans, in order, and at last the common end."""
    longer = max(x.n, y.n)
    if not longer:
        return 1.0
    matched = i = j = 0
    while i < x.n and j < y.n:
        k = common_extension(x, y, i=i, j=j)
        matched, i, j = matched + k, i + k, j + k
        if i == x.n or j == y.n:
            break
        found = behind_difference(x.text, i, y.text, j)
        if found is None:
            matched += min(common_extension(x, y, back=True), x.n - i, y.n - j)
            break
        i, j = found
    return matched / longer


def compare(own: PrefixHashes, following: PrefixHashes) -> tuple:
    """The row of a text before ``following``."""
    cut = own.n - own.n // 2
    edited = Spliced(own, cut, following, min(own.n // 2, following.n))
    digest = hashlib.sha256(edited.text.encode()).hexdigest()
    return own.n, digest, fingerprint(own), fingerprint(edited), likeness(own, edited), likeness(own, following)


_VALUES = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [v.split()[0] for v in _VALUES.split(", ")]


def document_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_chars``, ``edited_sha256``, both fingerprints, ``near_edited``, ``near_next``."""
    picked = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    names = ["place", "shard", "key", "text", *_NAMES]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with place 0; the range's first text with place 1 and its last row with place 2."""
        from pyspark import TaskContext

        shard, before, key_type = TaskContext.get().partitionId(), None, None

        def rows(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [pa.int32(), pa.int32(), key_type, pa.string(), *_TYPES]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in pieces(batches):
            key_type, out = batch.column(0).type, []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = PrefixHashes(t)
                if before is None:
                    out.append((1, shard, k, t, *[None] * len(_NAMES)))
                else:
                    out.append((0, shard, before[0], None, *compare(before[1], own)))
                before = (k, own)
            yield rows(out)
        if before is not None:
            yield rows([(2, shard, before[0], before[1].text, *[None] * len(_NAMES))])

    ranged = picked.repartitionByRange("key").sortWithinPartitions("key", "text")
    found = write_once(ranged.mapInArrow(stream, f"place int, shard int, key {kind}, text string, {_VALUES}"), "prints")
    # one first and one last text per range
    order = Window.orderBy("shard")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = found.where("place = 1").select("shard", F.coalesce(F.lead("shard").over(order), F.first("shard").over(everything)).alias("next"))
    heads = found.where("place = 1").select(F.col("shard").alias("next"), F.col("text").alias("following"))
    ends = found.where("place = 2").select("shard", "key", "text").join(after, "shard").join(heads, "next").select("key", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = [compare(PrefixHashes(a), PrefixHashes(b)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True))], names=["key", *_NAMES])

    inner = found.where("place = 0").select("key", *_NAMES)
    return inner.unionByName(ends.mapInArrow(close, f"key {kind}, {_VALUES}")).withColumnRenamed("key", key)
