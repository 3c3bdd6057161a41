"""Distinct-chunk table: each different chunk of text is segmented once per task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class ChunkTable:
    """Results of ``segment`` by chunk, in two generations of ``capacity`` entries each.

    When the young generation is full it becomes the old one; chunks found there are taken
    over without a new segmentation. Frequent chunks therefore stay, and memory is bounded
    by the capacity however many different chunks a task meets. Chunks longer than
    ``longest`` are segmented at each occurrence and never kept. ``segment`` takes a list of
    chunks and returns a list of results, none of which is None.
    """

    def __init__(self, segment: Callable[[list], list], capacity: int = 120_000, longest: int = 160):
        self.segment, self.capacity, self.longest = segment, capacity, longest
        self.young: dict = {}
        self.old: dict = {}

    def results(self, chunks: list) -> list:
        """One result per chunk, in order."""
        if len(self.young) > self.capacity:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = set(chunks).difference(young)
        new = list(missing)
        if old and missing:
            known = missing & old.keys()
            young.update(zip(known, map(old.__getitem__, known), strict=True))
            new = list(missing - known)
        if new:
            young.update(zip(new, self.segment(new), strict=True))
        out = list(map(young.__getitem__, chunks))
        for c in new:
            if len(c) > self.longest:
                del young[c]
        return out


_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True
#: Chunks up to this many bytes are compared as four words of eight bytes; longer ones count as distinct.
_WIDE = 32
#: Lowest bits of a hash, which have the chunk's length.
_LENGTH = np.uint64(63)


def chunk_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` and ``ends`` of the runs of bytes other than ASCII white space."""
    blank = np.concatenate([[True], _BLANK[np.frombuffer(data, np.uint8)], [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[0::2], edges[1::2]


def chunk_keys(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Five words for each chunk: a hash with the length in its lowest bits, and its bytes, zero-padded.

    Equality is always decided on the bytes. The hash of a chunk longer than ``_WIDE`` bytes is 0, and its
    first word its number.
    """
    padded = np.frombuffer(data + bytes(_WIDE + 8), np.uint8)
    length = ends - starts
    at_any = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(padded) - 7,), (1,))
    keys = np.zeros((_WIDE // 8 + 1, len(starts)), np.uint64)
    h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(_WIDE // 8):  # the k-th eight bytes of those that have them
        own = slice(None) if not k else np.flatnonzero(length > 8 * k)
        left = np.minimum(length[own] - 8 * k, 8).astype(np.uint64) * np.uint64(8)
        w = at_any[starts[own] + 8 * k] & (~np.uint64(0) >> (np.uint64(64) - left))
        keys[k + 1][own] = w
        w = (w ^ h[own]) * np.uint64(0xBF58476D1CE4E5B9)
        h[own] = w ^ (w >> np.uint64(29))
    long = np.flatnonzero(length > _WIDE)
    h = (h & ~_LENGTH) | (length.astype(np.uint64) & _LENGTH)
    h[long], keys[1, long] = 0, long
    keys[0] = h
    return keys


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``number`` and ``first`` of keys: which of the distinct ones each equals, and one occurrence of each of these.

    The distinct ones are in the order of their hashes.
    """
    order = np.argsort(keys[0])
    ranked = keys[0][order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    differs = np.zeros(max(len(order) - 1, 0), bool)
    for k in range(1, len(keys)):
        w = keys[k][order]
        differs |= w[1:] != w[:-1]
    if (differs & ~new[1:]).any():  # different chunks of one hash (or long ones): order them by all words
        order = np.lexsort(keys[::-1])
        ranked = keys[:, order]
        new[1:] = (ranked[:, 1:] != ranked[:, :-1]).any(0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


class FlatTable:
    """Ids of chunks in arrays: a slot for each of the hash's highest bits, and in it where a chunk's ids lie.

    Of two chunks with one slot the later one stays. There are at least twice ``capacity`` slots; when the
    array of ids is full, the table begins anew.
    """

    def __init__(self, capacity: int):
        bits = max(1, (2 * capacity - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros((_WIDE // 8 + 1, 1 << bits), np.uint64)
        self.begins, self.sizes = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        self.ids, self.used = np.zeros(8 * capacity, np.uint32), 0

    def look_up(self, keys: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``begin`` and ``size`` of the ids of each key, and the array they lie in.

        ``encode`` gets the numbers of the unknown keys, of equal ones one, and returns their sizes and ids.
        The array holds until the next call.
        """
        slot = (keys[0] >> self.shift).astype(np.int64)
        known = (keys[0] > 0) & (self.keys[0][slot] == keys[0]) & (self.keys[1][slot] == keys[1])
        for k in range(2, len(keys)):  # chunks of one hash are equally long
            own = np.flatnonzero(known & ((keys[0] & _LENGTH) > 8 * (k - 1)))
            known[own] = self.keys[k][slot[own]] == keys[k][own]
        begin, size, ids = self.begins[slot], self.sizes[slot], self.ids
        new = np.flatnonzero(~known)
        if len(new):
            number, first = distinct(keys[:, new])
            first = new[first]
            sizes, more = encode(first)
            begins = self.used + np.cumsum(sizes) - sizes
            begin[new], size[new] = begins[number], sizes[number]
            ids = self._keep(keys, slot, first, begins, sizes, more)
        return begin, size, ids

    def _keep(self, keys, slot, first, begins, sizes, more) -> np.ndarray:
        """Store the chunks at ``first`` and return the array that their ids and all others lie in."""
        if self.used + len(more) > len(self.ids):
            ids, self.used = np.concatenate([self.ids[: self.used], more]), 0
            self.keys[0] = 0
            return ids
        self.ids[self.used : self.used + len(more)] = more
        self.used += len(more)
        lasting = keys[0, first] > 0
        first, begins, sizes = first[lasting], begins[lasting], sizes[lasting]
        if len(first):  # in the order of slots, the last of each
            last = np.append(np.diff(slot[first]) != 0, True)
            first, at = first[last], slot[first[last]]
            self.keys[:, at] = keys[:, first]
            self.begins[at], self.sizes[at] = begins[last], sizes[last]
        return self.ids


def laid_out(begin: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of chunks one after the other, and how many there are before each chunk and in all."""
    after = np.concatenate([[0], np.cumsum(size)])
    places = np.repeat(begin - after[:-1], size)
    places += np.arange(after[-1])
    return ids[places], after
