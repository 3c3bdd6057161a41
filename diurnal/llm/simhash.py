"""SimHash near-dedup by a self-join of a binary trie (operator 8).

Fingerprints are 64 majority bits over the XXH64 hashes of a text's word shingles. Equal
fingerprints are folded first, so copies cost one row. The distinct fingerprints form a
binary trie: its top is cut into nodes with about equally many fingerprints, node pairs are
walked together from the root, adding up the bits in which their paths differ, and a pair is
pruned once these exceed the budget. Each surviving pair of cut nodes is one group, in which
a task walks the two subtrees in the same way, down to leaves of a few fingerprints, and
compares these exactly. No pair within the budget can be pruned, since every pruned path
already differs in more bits.

A task hands back a spanning forest of the links it found, which keeps every connection and
never more rows than fingerprints; components are then joined up over all tasks.

Texts without words (null, empty, blank) have fingerprint zero and link like any other;
texts with fewer words than a shingle are one shingle. Repeated rows share a fingerprint and
a component; rows whose id is null belong to components but are never their name, unless all ids are null.
An empty table gives an empty one. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, utf8, write_once
from .components import components

#: Cut nodes of the trie's top hold about this many fingerprints; there are at least
#: ``NODES_LEAST`` (for parallel work) and at most about ``NODES_MOST`` of them.
NODE_SIZE, NODES_LEAST, NODES_MOST = 65536, 32, 2048
#: A node with at most this many fingerprints is a leaf in a task's walk.
LEAF = 8
#: Node pairs walked at once in a task; more are put off, which bounds its memory.
FRONTIER = 200_000


def fingerprint(text: bytes, size: int = 4) -> int:
    """Majority bits of the shingle hashes of one text in UTF-8."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        spans = zip(starts[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in spans]
    return _majority(np.array(hashes, np.uint64))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, size: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``bits`` (the fingerprint as a signed long) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            bits = np.array([fingerprint(t, size) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=["key", "bits"])

    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, bits long").withColumnRenamed("key", key)


class Trie:
    """Levels of a binary trie over sorted distinct fingerprints below one node.

    ``lo``/``hi`` are a node's range of fingerprints, ``left``/``right`` its children in the
    next level or -1; leaves have no children.
    """

    def __init__(self, values: np.ndarray, depth: int):
        self.values, self.lo, self.hi, self.left, self.right = values, [], [], [], []
        lo, hi = np.array([0]), np.array([len(values)])
        while True:
            inner = (hi - lo > LEAF) & (depth < 64)
            self.lo.append(lo)
            self.hi.append(hi)
            left, right = np.full(len(lo), -1), np.full(len(lo), -1)
            self.left.append(left)
            self.right.append(right)
            if not inner.any():
                break
            shift = np.uint64(63 - depth)
            at = np.flatnonzero(inner)
            # the first value of a node with the bit set: all higher bits as in its first value
            bound = (values[lo[at]] >> shift | np.uint64(1)) << shift
            mid = np.searchsorted(values, bound)
            mid = np.clip(mid, lo[at], hi[at])
            has_left, has_right = mid > lo[at], mid < hi[at]
            numbers = np.cumsum(np.stack([has_left, has_right], 1).ravel()) - 1
            left[at[has_left]] = numbers[0::2][has_left]
            right[at[has_right]] = numbers[1::2][has_right]
            new_lo, new_hi = np.stack([lo[at], mid], 1).ravel(), np.stack([mid, hi[at]], 1).ravel()
            there = np.stack([has_left, has_right], 1).ravel()
            lo, hi, depth = new_lo[there], new_hi[there], depth + 1


def close_pairs(a: np.ndarray, b: np.ndarray, depth: int, start: int, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of pairs of ``a`` and ``b`` (sorted, uint64) at most ``budget`` bits apart.

    ``a`` and ``b`` are the subtrees of two nodes at ``depth`` whose paths differ in ``start``
    bits. With ``same`` both are one subtree, and each pair comes once.
    """
    ta, tb = Trie(a, depth), Trie(b, depth)
    stack = [(0, 0, np.array([0]), np.array([0]), np.array([start], np.int8))]
    while stack:
        la, lb, x, y, d = stack.pop()
        if len(x) > FRONTIER:
            half = len(x) // 2
            stack += [(la, lb, x[:half], y[:half], d[:half]), (la, lb, x[half:], y[half:], d[half:])]
            continue
        leaf_x = (ta.left[la][x] < 0) & (ta.right[la][x] < 0)
        leaf_y = (tb.left[lb][y] < 0) & (tb.right[lb][y] < 0)
        done = leaf_x | leaf_y
        if done.any():
            yield from _compare(a, b, ta.lo[la][x[done]], ta.hi[la][x[done]], tb.lo[lb][y[done]], tb.hi[lb][y[done]], budget, same)
        x, y, d = x[~done], y[~done], d[~done]
        if not len(x):
            continue
        found = []
        for cx, way_x in ((ta.left[la][x], 0), (ta.right[la][x], 1)):
            for cy, way_y in ((tb.left[lb][y], 0), (tb.right[lb][y], 1)):
                ok = (cx >= 0) & (cy >= 0) & (d + (way_x != way_y) <= budget)
                if same:  # once below a different child, order is settled
                    ok &= (x < y) | (way_x <= way_y)
                found.append((cx[ok], cy[ok], d[ok] + np.int8(way_x != way_y)))
        x, y, d = (np.concatenate(c) for c in zip(*found, strict=True))
        if len(x):
            stack.append((la + 1, lb + 1, x, y, d))


def _compare(a, b, lo_a, hi_a, lo_b, hi_b, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Exact comparison of the products of index ranges."""
    sizes = (hi_a - lo_a) * (hi_b - lo_b)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + 4 * FRONTIER, "right")))
        if to == at + 1 and sizes[at] > 4 * FRONTIER:  # a leaf against a large node: by rows
            for i in range(lo_a[at], hi_a[at]):
                near = np.flatnonzero(np.bitwise_count(b[lo_b[at] : hi_b[at]] ^ a[i]) <= budget) + lo_b[at]
                near = near[near > i] if same else near
                yield np.full(len(near), i), near
            at = to
            continue
        n = sizes[at:to]
        which = np.repeat(np.arange(at, to), n)
        place = np.arange(n.sum()) - np.repeat(ends[at:to] - n - base, n)
        width = (hi_b - lo_b)[which]
        i, j = lo_a[which] + place // width, lo_b[which] + place % width
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if same:
            near &= i < j
        yield i[near], j[near]
        at = to


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links that join two trees: each root hooks onto a smaller one."""
    root = np.arange(size)
    kept_i, kept_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            roots, first = np.unique(high, return_index=True)
            root[roots] = low[first]
            kept_i.append(i[first])
            kept_j.append(j[first])
            while (root != (up := root[root])).any():
                root = up
    return np.concatenate(kept_i), np.concatenate(kept_j)


def cut_nodes(bits: DataFrame, total: int, budget: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """The trie's top: nodes (depth, first bits) and surviving node pairs (a, b, differing bits).

    Counts of the first 16 bits (65,536 rows at most) decide where to cut: a node is split
    until it holds at most ``NODE_SIZE`` fingerprints, or fewer or more to keep to the bounds on
    the number of nodes. Both lists are bounded by ``NODES_MOST``, not by the data.
    """
    head = F.shiftrightunsigned("bits", 48).cast("int").alias("head")
    counts = np.zeros(1 << 16, np.int64)
    for r in bits.groupBy(head).count().collect():
        counts[r["head"]] = r["count"]
    most = max(1, min(NODE_SIZE, total // NODES_LEAST), total // NODES_MOST)
    sums = np.concatenate([[0], np.cumsum(counts)])

    def size(depth: int, path: int) -> int:
        width = 16 - depth
        return int(sums[(path + 1) << width] - sums[path << width])

    nodes, open_nodes = [], [(0, 0)]
    while open_nodes:
        depth, path = open_nodes.pop()
        n = size(depth, path)
        if n and (n <= most or depth == 16):
            nodes.append((depth, path))
        elif n:
            open_nodes += [(depth + 1, path * 2), (depth + 1, path * 2 + 1)]
    nodes.sort(key=lambda x: x[1] << (16 - x[0]))
    number = {x: i for i, x in enumerate(nodes)}
    pairs, walk = [], [((0, 0), (0, 0), 0)]

    def below(node: tuple[int, int]) -> list[tuple[int, int]]:
        return [node] if node in number else [c for c in ((node[0] + 1, node[1] * 2), (node[0] + 1, node[1] * 2 + 1)) if size(*c)]

    while walk:
        x, y, d = walk.pop()
        if x in number and y in number:
            pairs.append((number[x], number[y], d))
            continue
        for cx in below(x):
            for cy in below(y):
                if (x == y and cx > cy) or _differing(cx, cy) > budget:
                    continue
                walk.append((cx, cy, _differing(cx, cy)))
    return nodes, pairs


def _differing(x: tuple[int, int], y: tuple[int, int]) -> int:
    """Bits in which two paths differ, as far as the shorter one goes."""
    depth = min(x[0], y[0])
    return ((x[1] >> (x[0] - depth)) ^ (y[1] >> (y[0] - depth))).bit_count()


def links(bits: DataFrame, budget: int = 4) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct ``bits`` within ``budget`` of each other."""
    spark = bits.sparkSession
    total = bits.count()
    nodes, pairs = cut_nodes(bits, total, budget)
    starts = np.array([p << (16 - d) for d, p in nodes], np.int64)
    depths = np.array([d for d, _ in nodes])
    by_node: list[list[int]] = [[] for _ in nodes]
    for n, (x, y, _) in enumerate(pairs):
        by_node[x].append(n)
        if y != x:
            by_node[y].append(n)
    plan = spark.sparkContext.broadcast((starts, depths, by_node, pairs))  # bounded by NODES_MOST

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, _, by_node, _ = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            node = np.searchsorted(starts, (own.view(np.uint64) >> np.uint64(48)).astype(np.int64), "right") - 1
            for n in np.unique(node).tolist():
                values = own[node == n]
                for at in range(0, len(by_node[n]), 64):
                    to = by_node[n][at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(to, len(values)), pa.int32()), pa.array(np.tile(values, len(to)))], names=["pair", "bits"])

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        starts, depths, _, pairs = plan.value
        x, y, _ = pairs[key[0].as_py()]
        values = np.sort(rows.column("bits").to_numpy().view(np.uint64))
        node = np.searchsorted(starts, (values >> np.uint64(48)).astype(np.int64), "right") - 1
        a, b = values[node == x], values[node == y]
        depth = int(min(depths[x], depths[y]))
        start = int(np.bitwise_count(a[0] >> np.uint64(64 - depth) ^ b[0] >> np.uint64(64 - depth))) if depth else 0
        found = close_pairs(a, b, depth, start, budget, x == y)
        if x == y:
            i, j = _forest(found, len(a))
            left, right = a[i], a[j]
        else:
            i, j = _forest(((i, j + len(a)) for i, j in found), len(a) + len(b))
            left, right = a[i], b[j - len(a)]
        return pa.table({"a": pa.array(left.view(np.int64)), "b": pa.array(right.view(np.int64))})

    sent = bits.select("bits").mapInArrow(send, "pair int, bits long")
    return sent.groupBy("pair").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 4, budget: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``bits`` and ``component``: the smallest key reachable over links, per row."""
    prints = write_once(fingerprints(docs, size, key, text), "simhash")
    distinct = write_once(prints.groupBy("bits").agg(F.min(key).alias("least")), "simhash-distinct")
    linked = components(links(distinct.select("bits"), budget))
    member = distinct.join(linked, distinct["bits"] == linked["node"], "left").select("bits", "least", F.coalesce("component", "bits").alias("root"))
    member = write_once(member, "simhash-members")
    # written, so that both sides of the joins below are plain exchanges, which can be split where skewed
    roots = write_once(member.groupBy("root").agg(F.min("least").alias("component")), "simhash-roots")
    names = member.join(roots, "root").select("bits", "component")
    return prints.join(names, "bits").select(key, "bits", "component")
