"""Benchmark decontamination with a generalised suffix automaton of the test items (operator 13).

Items and documents become words (runs of letters, digits and code points from U+0080, A-Z
lower-cased). A suffix automaton over the words of all items has a state for every set of places where a
run of item words ends. A document's words are streamed through it; the length of the longest
match that ends at each word is tracked along suffix links. A match of ``window`` words or more is an
occurrence of item windows throughout, so its words are hit; the state that has the match's last
``window`` words names the items. An item of fewer words is a window of its own. Hit words can be removed
as spans of the text, and documents with too large a share of them dropped.

Items are folded to distinct word sequences first. Sequences are dealt by hash to blocks of about
``BLOCK_WORDS`` words (longer sequences in overlapping parts), and tasks build one automaton a block.
One automaton at a time is broadcast: its size is bounded by the block. Documents are read once for each
block, and texts are not shuffled; a row with hits is one small row. Only stretches of words whose
neighbours are neighbours in some item, long enough for a window, are walked.

Null and empty texts have no words; items without words match nothing. Rows of items with one id are
one item; rows without id mark hits, but have no id to report. Repeated documents are treated alike.
Empty tables give empty ones, and no items no hits. Only ids and texts are read.
"""

from __future__ import annotations

import io
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import attach
from .common import pieces, utf8, write_once

#: Words of one automaton, about, and of one part of a longer item.
BLOCK_WORDS, PART_WORDS = 500_000, 20_000
#: Words of a window of an item.
WINDOW = 10
_WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TABLE = bytes(b if b in _WORD_BYTES else 32 for b in bytes(range(256)).lower())
_SPAN_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_PAIR_BITS = 24


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Builder:
    """Suffix automaton grown word by word; state 0 is the empty match."""

    def __init__(self):
        self.length, self.link, self.next = [0], [-1], [{}]

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(arcs)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state that has just ``p``'s matches followed by ``c``; split off from ``q`` if that has longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        own = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = own
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = own
            p = self.link[p]
        return own

    def extend(self, last: int, c: int) -> int:
        """State of a sequence after one more word."""
        if c in self.next[last]:  # another sequence went this way
            return self._split(last, self.next[last][c], c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new


class Automaton:
    """Packed automaton of one block, with the sequences that have each window."""

    ARRAYS = ("keys", "targets", "link", "length", "top", "marked", "mark_at", "mark_size", "mark_of", "chain", "pairs")

    @classmethod
    def over(cls, sequences: list[list[bytes]], window: int) -> Automaton:
        self = cls()
        vocabulary: dict[bytes, int] = {}
        coded = [[vocabulary.setdefault(w, len(vocabulary)) for w in s] for s in sequences]
        b = Builder()
        for s in coded:
            last = 0
            for c in s:
                last = b.extend(last, c)
        self.vocabulary, self.window, v = b" ".join(vocabulary), window, len(vocabulary)
        self.link, self.length = np.array(b.link, np.int32), np.array(b.length, np.int32)
        arcs = sorted((state * v + c, to) for state, arcs in enumerate(b.next) for c, to in arcs.items())
        self.keys, self.targets = np.array([a[0] for a in arcs], np.int64), np.array([a[1] for a in arcs], np.int32)
        # the state with the last `window` words of each longer match: up the links, by ascending length
        self.top = np.full(len(b.length), -1, np.int32)
        for state in np.argsort(self.length, kind="stable").tolist():
            if b.length[state] >= window:
                self.top[state] = state if b.length[b.link[state]] < window else self.top[b.link[state]]
        marks = set()
        for number, s in enumerate(coded):
            state = 0
            for i, c in enumerate(s):
                state = b.next[state][c]
                if i + 1 >= window:
                    state = int(self.top[state])
                    marks.add((state, window, number))
            if 0 < len(s) < window:
                marks.add((state, len(s), number))
        marks = sorted(marks)
        states = np.array([m[0] for m in marks], np.int64)
        self.marked, self.mark_at = (x.astype(np.int32) for x in np.unique(states, return_index=True))
        self.mark_size, self.mark_of = np.array([m[1] for m in marks], np.int32), np.array([m[2] for m in marks], np.int32)
        # the nearest state up the links, from the state itself, in which a sequence shorter than a window ends
        short = {m[0] for m in marks if m[1] < window}
        self.chain = np.full(len(b.length), -1, np.int32)
        if short:
            for state in np.argsort(self.length, kind="stable").tolist()[1:]:
                self.chain[state] = state if state in short else self.chain[b.link[state]]
        self.least = min([window, *(len(s) for s in coded if s)])
        beside = np.unique(np.array([s[i] * v + s[i + 1] for s in coded for i in range(len(s) - 1)], np.int64))
        bits = np.zeros(1 << _PAIR_BITS, bool)
        bits[self._hash(beside)] = True
        self.pairs = np.packbits(bits) if len(beside) * 256 > len(bits) else self._hash(beside).astype(np.int32)
        return self

    @staticmethod
    def _hash(pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _PAIR_BITS)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vocabulary=np.frombuffer(self.vocabulary, np.uint8), window=self.window, least=self.least, **{a: getattr(self, a) for a in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Automaton:
        self, held = cls(), np.load(io.BytesIO(data))
        for a in cls.ARRAYS:
            setattr(self, a, held[a])
        self.vocabulary, self.window, self.least = held["vocabulary"].tobytes(), int(held["window"]), int(held["least"])
        return self.ready()

    def ready(self) -> Automaton:
        """Lookup tables for streaming."""
        self.codes = {w: i for i, w in enumerate(self.vocabulary.split())}
        self._keys, self._targets = array("q", self.keys.tobytes()), array("i", self.targets.tobytes())
        self._link, self._length = array("i", self.link.tobytes()), array("i", self.length.tobytes())
        self._top, self._chain = array("i", self.top.tobytes()), array("i", self.chain.tobytes())
        begins = self.mark_at.tolist()
        self.marks = dict(zip(self.marked.tolist(), zip(begins, [*begins[1:], len(self.mark_of)], strict=False), strict=True))
        if self.pairs.dtype == np.uint8:
            self._beside = np.unpackbits(self.pairs).view(bool)
        else:
            self._beside = np.zeros(1 << _PAIR_BITS, bool)
            self._beside[self.pairs] = True
        return self

    def stretches(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Begin and end of the stretches of words in which a window can lie."""
        known = codes >= 0
        if self.least > 1:
            linked = known[:-1] & known[1:]
            at = np.flatnonzero(linked)
            linked[at] = self._beside[self._hash(codes[at] * len(self.codes) + codes[at + 1])]
        else:
            linked = known
        edges = np.flatnonzero(np.diff(np.concatenate([[False], linked, [False]])))
        more = int(self.least > 1)
        return [(a, e + more) for a, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if e + more - a >= self.least]

    def hits(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words inside occurring windows, merged, and the sequences that have the windows."""
        if not self.codes or len(text_words) < self.least:
            return [], set()
        codes = np.fromiter(map(self.codes.get, text_words, repeat(-1)), np.int64, len(text_words))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for begin, end in self.stretches(codes):
            self._walk(codes[begin:end].tolist(), begin, spans, found)
        return spans, set(self.mark_of[list(found)].tolist()) if found else set()

    def _walk(self, codes: list[int], begin: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        keys, targets, link, length, top, chain = self._keys, self._targets, self._link, self._length, self._top, self._chain
        v, last, window = len(self.codes), len(keys), self.window
        state = matched = 0
        for i, c in enumerate(codes, begin + 1):
            while True:
                k = state * v + c
                at = bisect_left(keys, k)
                if at < last and keys[at] == k:
                    state, matched = targets[at], matched + 1
                    break
                if not state:
                    break
                state = link[state]
                matched = length[state]
            if not state:
                continue
            if matched >= window:
                _cover(spans, i - matched, i)
                found.update(range(*self.marks[top[state]]))
            short = chain[state]
            while short > 0:
                for m in range(*self.marks[short]):
                    size = int(self.mark_size[m])
                    if size <= matched and size < window:
                        _cover(spans, i - size, i)
                        found.add(m)
                short = chain[link[short]]


def _cover(spans: list[tuple[int, int]], begin: int, end: int) -> None:
    """Add a span that ends no earlier than the ones before."""
    while spans and spans[-1][1] >= begin:
        begin = min(begin, spans.pop()[0])
    spans.append((begin, end))


def _folded_items(items: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``item``, ``sequence`` of every item with words and id; ``sequence``, ``words``, ``n`` of distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [words(t) for t in utf8(batch.column(1))]
            joined, n = [b" ".join(w) for w in found], [len(w) for w in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(joined, pa.binary()), pa.array(n, pa.int64())], names=["item", "words", "n"])

    picked = items.select(F.col(key).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    split = picked.mapInArrow(run, "item string, words binary, n long").where("n > 0").withColumn("sequence", F.md5("words"))
    split = write_once(split, "items")
    named = split.where("item is not null").select("item", "sequence").distinct()
    return named, split.groupBy("sequence").agg(F.first("words").alias("words"), F.max("n").alias("n"))


def automata(sequences: DataFrame, window: int = WINDOW) -> DataFrame:
    """``block``, ``names`` of its sequences and packed ``automaton``, one row a block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts that overlap by a window less one word, so that each window is in one."""
        for batch in pieces(batches):
            rows = []
            for name, joined in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = joined.split()
                rows += [(name, at, b" ".join(w[at : at + PART_WORDS + window - 1])) for at in range(0, max(1, len(w) - window + 1), PART_WORDS)]
            name, at, part = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(at, pa.int64()), pa.array(part, pa.binary())], names=["sequence", "at", "words"])

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        order = sorted(zip(rows.column("sequence").to_pylist(), rows.column("at").to_pylist(), rows.column("words").to_pylist(), strict=True))
        packed = Automaton.over([w.split() for _, _, w in order], window).to_bytes()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "names": pa.array([[n for n, _, _ in order]], pa.list_(pa.string())), "automaton": pa.array([packed], pa.binary())})

    total = sequences.agg(F.sum(F.col("n") + window)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    parts = sequences.select("sequence", "words").mapInArrow(cut, "sequence string, at long, words binary")
    dealt = parts.withColumn("block", F.pmod(F.xxhash64("sequence", "at"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(build, "block int, names array<string>, automaton binary")


_HITS = "place long, n_words long, spans array<struct<begin:int,end:int>>, sequences array<string>"


def _streamed(docs: DataFrame, names: list[str], packed: bytes | None, whole: bool) -> DataFrame:
    """Rows ``key``, ``print``, ``place`` in the task, ``n_words``, ``spans`` and ``sequences``; with ``whole`` also those without hits."""
    shared = docs.sparkSession.sparkContext.broadcast((names, packed))  # one block
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, data = shared.value
        a = Automaton.from_bytes(data) if data else None
        place = TaskContext.get().partitionId() << 40
        for batch in pieces(batches):
            rows = []
            for t in utf8(batch.column(2)):
                w = words(t)
                spans, found = a.hits(w) if a else ([], ())
                rows.append((place, len(w), [{"begin": x, "end": y} for x, y in spans], sorted({own[k] for k in found})))
                place += 1
            at, n, spans, found = zip(*rows, strict=True)
            span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            arrays = [pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(found, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["key", "print", "place", "n_words", "spans", "sequences"])
            yield out if whole else out.filter(pa.array([bool(s) for s in spans]))

    return write_once(docs.mapInArrow(run, f"key {kind}, print string, {_HITS}"), "hits")


def _merged(spans: Column) -> Column:
    """Spans without overlaps, in order."""
    step = lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1).end >= s.begin),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1).begin.alias("begin"), F.greatest(F.element_at(done, -1).end, s.end).alias("end")))),
    ).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<begin:int,end:int>>"), step)


def _printed(docs: DataFrame, key: str, text: str) -> list[Column]:
    """Id, digest of the text, and text: rows with equal id and text have equal results."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.col(key).alias("key"), F.md5(whole).alias("print"), whole.alias("text")]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key``, ``print`` (MD5 of the text), ``n_words``, ``n_hit``, ``spans`` of hit words and ``items`` of every row.

    ``items`` are the ids, as text and in their order as text, of the items with occurring windows.
    """
    named, sequences = _folded_items(items, item_key, item_text)
    blocks = write_once(automata(sequences, window), "automata")
    numbers = sorted(r["block"] for r in blocks.select("block").collect())
    picked = docs.select(*_printed(docs, key, text))
    streamed = []
    for number in numbers or [None]:  # a pass over the documents for each block
        block = blocks.where(F.col("block") == number).first() if numbers else None
        streamed.append(_streamed(picked, *((block["names"], bytes(block["automaton"])) if block else ([], None)), whole=not streamed))
    hits = [s.where(F.size("spans") > 0).select("key", "print", F.lit(k).alias("block"), "spans", "sequences") for k, s in enumerate(streamed)]
    per_block = hits[0]
    for other in hits[1:]:
        per_block = per_block.unionByName(other)
    # one row for each block of a text with hits
    per_text = per_block.dropDuplicates(["key", "print", "block"]).groupBy("key", "print")
    joined = per_text.agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("sequences"))).alias("sequences"))
    joined = write_once(joined.withColumn("spans", _merged(F.col("spans")) if len(hits) > 1 else F.col("spans")), "hit-texts")
    each = joined.select("key", "print", F.explode("sequences").alias("sequence"))
    of_items = attach(each, named, ["sequence"], ["key", "print"], "inner").groupBy("key", "print").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = joined.join(of_items.withColumnsRenamed({"key": "k", "print": "p"}), F.col("key").eqNullSafe(F.col("k")) & (F.col("print") == F.col("p")), "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.begin)
    found = found.select("key", "print", n_hit.alias("n_hit"), "spans", "items")
    rows = attach(streamed[0].select("key", "print", "place", "n_words"), found, ["key", "print"], ["place"])
    none = lambda c: F.coalesce(F.col(c), F.array().cast(found.schema[c].dataType))
    return rows.select(F.col("key").alias(key), "print", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), none("spans").alias("spans"), none("items").alias("items"))


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of the spans and what stands between them."""
    at = [m.span() for m in _SPAN_WORD.finditer(text)]
    for begin, end in reversed(spans):
        text = text[: at[begin][0]] + text[at[end - 1][1] :]
    return text


def decontaminate(docs: DataFrame, found: DataFrame, least_span: int = 1, most_coverage: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` without their hit spans, as :func:`contamination` found them.

    Spans of fewer than ``least_span`` words stay; rows with a larger share of hit words than
    ``most_coverage`` go as a whole.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    rows = docs.select(rest.alias("rest"), *_printed(docs, key, text), F.col(text).isNull().alias("none"))
    share = (F.col("n_hit") / F.col("n_words")).alias("share")
    hit = found.where("n_hit > 0").select(F.col(key).alias("key"), "print", share, "spans").dropDuplicates(["key", "print"])
    marked = attach(rows, hit, ["key", "print"], ["rest"]).where(F.coalesce(F.col("share"), F.lit(0.0)) <= most_coverage)
    kind = marked.schema["rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for t, none, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = [(s["begin"], s["end"]) for s in spans or () if s["end"] - s["begin"] >= least_span]
                out.append(None if none else without_words(t, own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], names=["rest", "text"])

    cleaned = marked.select("rest", "text", "none", "spans").mapInArrow(run, f"rest {kind}, text string")
    return cleaned.select(*[F.col("text").alias(text) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
