"""Toxicity by nearest labelled examples (operator 5).

A bounded, deterministic sample of labelled texts is turned into TF-IDF vectors over all
their words, and indexed: each term's posting list is cut into blocks of ``BLOCK`` examples with
the block's largest weight kept beside it. For a text, the blocks with the highest upper bounds
``sum(query weight x block maximum)`` are visited first; others are skipped only when their bounds are below the
k-th best cosine so far, so the neighbours are those of an exhaustive search. Votes are
weighted by cosine and mapped to probabilities by bins of leave-one-out votes of the examples.

Every word of the examples is in the index. Words that tell the labels apart weigh more: a term's
idf is multiplied by ``FLOOR`` plus what the root of its chi-square (document frequencies by label)
has above ``CHANCE``. The sample has up to as many rows of either label, so in votes, calibration and shares
an example counts for all labelled rows of its label divided by those in the sample, and scores do not
depend on where the sample ends. Lists of the ``DENSE`` most frequent terms lie in dense blocks, the others are sparse.

The sample size and the number of neighbours are parameters; the fitted model is bounded by the
examples and their words and travels with the tasks. Every text is scored whole, in one pass, and
nothing is shuffled. Null and empty texts, and texts without any word of the examples, get the
smoothed share of toxic labels among the examples without words, or among all if each has some. Without
labelled rows, or with labels of one
kind, every score is the (smoothed) share of toxic labels. Ties between neighbours go to the smaller
doc_id. Repeated rows get equal scores; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, sample_by_hash

#: Examples per index block, and blocks visited at first.
BLOCK, AT_ONCE = 32, 16
#: Terms whose posting lists are dense.
DENSE = 512
#: Texts searched together, and the words of these, about.
TOGETHER, WORDS = 128, 60_000
#: Weight of a term that tells nothing, and the root of chi-square above which a term weighs more:
#: by chance one gets there with a probability of less than 1e-4.
FLOOR, CHANCE = 0.005, 4
#: A text whose score is at least this is predicted toxic.
THRESHOLD = 0.3
#: ASCII bytes that are not letters become spaces.
_LETTERS = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
#: Non-ASCII punctuation (general punctuation, Latin-1 signs, CJK marks) also splits words.
_SIGNS = re.compile("[ -©«-´¶-¹»-¿×÷ -⁯　-〿]+")


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text: runs of letters, as UTF-8."""
    if not text:
        return []
    low = text.lower()
    if not low.isascii():
        low = _SIGNS.sub(" ", low)
    return low.encode().translate(_LETTERS).split()


def _expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, one range after the other, and the range of each."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(which)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes), which


@dataclass
class Neighbours:
    """Block-max inverted index over unit TF-IDF vectors of the examples, with calibration.

    ``idf`` has the weight of each term, ``shares`` the labelled rows an example stands for, by label. Dense terms: ``dense`` (block, term, place) and ``dense_most``
    (term, block). Sparse terms: postings ``example``, ``weight`` from ``start`` on, and block maxima ``block``,
    ``most`` from ``block_start`` on. ``slot`` is a dense term's number, -1 for sparse ones.
    """

    ids: np.ndarray
    labels: np.ndarray
    terms: dict[bytes, int]
    idf: np.ndarray
    slot: np.ndarray | None = None
    dense: np.ndarray | None = None
    dense_most: np.ndarray | None = None
    example: np.ndarray | None = None
    weight: np.ndarray | None = None
    start: np.ndarray | None = None
    block: np.ndarray | None = None
    most: np.ndarray | None = None
    block_start: np.ndarray | None = None
    k: int = 15
    shares: tuple[float, float] = (1.0, 1.0)
    rest: float = 0.0
    edges: np.ndarray | None = None
    values: np.ndarray | None = None

    def vector(self, counts: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers, ascending, and unit weights ``(1 + ln tf) idf``."""
        own = sorted((self.terms[t], n) for t, n in counts.items() if t in self.terms)
        if not own:
            return np.zeros(0, np.int64), np.zeros(0)
        at, tf = np.array(own, np.int64).T
        w = (1 + np.log(tf)) * self.idf[at]
        return at, w / np.sqrt((w * w).sum())

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Index the examples' vectors; returns them in the order of the index.

        Examples with like terms stand together, which makes block maxima tell blocks apart.
        """
        terms, blocks = len(self.terms), -(-len(vectors) // BLOCK)
        found = np.bincount(np.concatenate([at for at, _ in vectors]), minlength=terms)
        self.slot = np.full(terms, -1)
        often = np.argsort(-found, kind="stable")[:DENSE]
        self.slot[often] = np.arange(len(often))
        order = self._order(vectors, len(often))
        self.ids, self.labels = self.ids[order], self.labels[order]
        vectors = [vectors[e] for e in order]
        self.dense = np.zeros((blocks, len(often), BLOCK))
        example = np.repeat(np.arange(len(vectors)), [len(at) for at, _ in vectors])
        at, w = (np.concatenate(c) for c in zip(*vectors, strict=True))
        often = self.slot[at] >= 0
        self.dense[example[often] // BLOCK, self.slot[at[often]], example[often] % BLOCK] = w[often]
        self.dense_most = np.ascontiguousarray(self.dense.max(2).T)
        at, example, w = at[~often], example[~often], w[~often]
        by_term = np.argsort(at, kind="stable")
        at, self.example, self.weight = at[by_term], example[by_term], w[by_term]
        self.start = np.searchsorted(at, np.arange(terms + 1))
        pair, first = np.unique(at * blocks + self.example // BLOCK, return_index=True)
        self.block, self.block_start = pair % blocks, np.searchsorted(pair // blocks, np.arange(terms + 1))
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        return vectors

    def _order(self, vectors: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
        """Examples by halving along the main direction of their dense terms, in whole blocks."""
        x = np.zeros((len(vectors), width))
        for e, (at, w) in enumerate(vectors):
            own = self.slot[at] >= 0
            x[e, self.slot[at[own]]] = w[own]
        out, todo = [], [np.argsort(self.ids, kind="stable")]
        while todo:
            part = todo.pop()
            if len(part) <= BLOCK:
                out.append(part)
                continue
            own = x[part] - x[part].mean(0)
            way = own[np.argmax((own * own).sum(1))]
            for _ in range(8):
                way = own.T @ (own @ way)
                way /= max(np.sqrt(way @ way), 1e-300)
            part = part[np.argsort(own @ way, kind="stable")]
            half = -(-len(part) // BLOCK) // 2 * BLOCK
            todo += [part[half:], part[:half]]
        return np.concatenate(out)

    def nearest(self, at: np.ndarray, w: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Example numbers and cosines of the ``k`` nearest with a positive cosine."""
        return self.nearest_all([(at, w)], [leave])[0]

    def nearest_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], leave: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of several texts, searched together."""
        n, blocks, places = len(vectors), len(self.dense), len(self.dense) * BLOCK
        text = np.repeat(np.arange(n), [len(at) for at, _ in vectors])
        at, w = (np.concatenate(c) for c in zip(*vectors, strict=True))
        often = self.slot[at] >= 0
        asked = np.zeros((n, self.dense.shape[1]))
        asked[text[often], self.slot[at[often]]] = w[often]
        text, at, w = text[~often], at[~often], w[~often]
        place, which = _expand(self.block_start[at], self.block_start[at + 1])
        bounds = asked @ self.dense_most
        bounds += np.bincount(text[which] * blocks + self.block[place], w[which] * self.most[place], n * blocks).reshape(n, blocks)
        place, which = _expand(self.start[at], self.start[at + 1])
        text, example, part = text[which], self.example[place], w[which] * self.weight[place]
        scores = np.zeros((n, places))

        def visit(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)).tolist():
                rows = np.flatnonzero(wanted[:, b])
                scores[rows, b * BLOCK : (b + 1) * BLOCK] = asked[rows] @ self.dense[b]
            ok = wanted[text, example // BLOCK]
            scores.ravel()[:] += np.bincount(text[ok] * places + example[ok], part[ok], n * places)
            for i, e in enumerate(leave or ()):
                if e >= 0:
                    scores[i, e] = 0

        first = np.zeros((n, blocks), bool)
        best = np.argpartition(-bounds, min(AT_ONCE, blocks) - 1, 1)[:, :AT_ONCE]
        np.put_along_axis(first, best, True, 1)
        visit(first & (bounds > 0))
        least = np.partition(scores, places - self.k, 1)[:, places - self.k] if places > self.k else np.zeros(n)
        visit(~first & (bounds > 0) & (bounds + 1e-9 >= least[:, None]))
        least = np.partition(scores, places - self.k, 1)[:, places - self.k] if places > self.k else np.zeros(n)
        out = []
        for own, limit in zip(scores, least.tolist(), strict=True):
            near = np.flatnonzero((own > 0) & (own >= limit - 1e-11))
            cosines = np.round(own[near], 12)
            best = np.lexsort((self.ids[near], -cosines))[: self.k]
            best = best[cosines[best] > 0]
            out.append((near[best], cosines[best]))
        return out

    def vote(self, near: np.ndarray, cosines: np.ndarray) -> float:
        if not len(near):
            return -1.0
        own = cosines * np.where(self.labels[near] > 0, self.shares[1], self.shares[0])
        return float((own * self.labels[near]).sum() / own.sum())

    def calibrated(self, vote: float) -> float:
        if vote < 0 or self.edges is None:
            return self.rest
        return float(np.interp(vote, self.edges, self.values))

    def scores(self, texts: list[str | None]) -> list[tuple[float, tuple[int, ...], tuple[float, ...]]]:
        """Per text its probability, and as evidence the nearest examples' ids and cosines."""
        out: list = [(self.rest, (), ())] * len(texts)
        group, size = [], 0
        for i, text in enumerate(texts):
            at, w = self.vector(Counter(words(text))) if self.terms else ((), ())
            if len(at):
                group.append((i, at, w))
                size += len(at)
            if group and (len(group) == TOGETHER or size > WORDS or i == len(texts) - 1):
                found = self.nearest_all([(at, w) for _, at, w in group])
                for (j, _, _), (near, cosines) in zip(group, found, strict=True):
                    out[j] = (self.calibrated(self.vote(near, cosines)), tuple(self.ids[near].tolist()), tuple(cosines.tolist()))
                group, size = [], 0
        return out


def _isotonic(x: np.ndarray, y: np.ndarray, shares: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """Increasing fit by pooling neighbours, on (vote, label) pairs, weighted by label; one point per pool.

    Each pool's value is smoothed by one pair of an unknown label, of the mean weight.
    """
    pools: list[list[float]] = []
    for v, label in sorted(zip(x.tolist(), y.tolist(), strict=True)):
        w = shares[int(label)]
        pools.append([v, label * w, w, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            a, b = pools.pop(), pools.pop()
            pools.append([(a[0] * a[2] + b[0] * b[2]) / (a[2] + b[2]), a[1] + b[1], a[2] + b[2], a[3] + b[3]])
    return np.array([p[0] for p in pools]), np.array([_smoothed(p[1], p[2], p[3]) for p in pools])


def _smoothed(toxic: float, of: float, rows: int) -> float:
    """Share of toxic in a weighted count ``of`` over ``rows`` rows, with one more row of an unknown label."""
    one = of / rows
    return (toxic + one / 2) / (of + one)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    examples: int = 1500,
    k: int = 15,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Neighbours:
    """Model from the labelled rows of ``docs``, at most ``examples`` of each label.

    The sample is the rows with the smallest hash of their id. ``labels`` holds ``key`` and
    ``label``; rows with a null in either are left out.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    known = known.groupBy("key").agg(F.max("label").alias("label"))
    there = docs.select(F.col(key).alias("key")).distinct()
    chosen = sample_by_hash(known.join(there, "key", "left_semi"), "label", "key", examples, total="total")
    found = chosen.collect()
    rows = [(r["key"], r["label"]) for r in found]
    by_key = dict(rows)
    toxic = sum(by_key.values())
    totals = {r["label"]: r["total"] for r in found}
    shares = (totals.get(0, 0) / max(1, len(rows) - toxic), totals.get(1, 0) / max(1, toxic))
    rest = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
    empty = Neighbours(np.zeros(0, np.int64), np.zeros(0), {}, np.zeros(0), k=k, rest=rest)
    if not 0 < toxic < len(rows):
        return empty

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [Counter(words(t)) for t in batch.column(1).to_pylist()]
            terms, tf = pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), terms, tf], names=["key", "terms", "tf"])

    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    # the chosen rows are at most 2 x examples
    sample = picked.join(F.broadcast(chosen), "key").dropDuplicates(["key"]).select("key", "text")
    kind = picked.schema["key"].dataType.simpleString()
    counted = sample.mapInArrow(count, f"key {kind}, terms array<binary>, tf array<long>").toArrow()
    per = {i: dict(zip(t, n, strict=True)) for i, t, n in zip(*(c.to_pylist() for c in counted.columns), strict=True)}
    ids = sorted(i for i in per if per[i])
    terms: dict[bytes, int] = {}
    for i in ids:
        for t in per[i]:
            terms.setdefault(t, len(terms))
    if not terms:
        return empty
    y = np.array([by_key[i] for i in ids], float)
    at = np.fromiter((terms[t] for i in ids for t in per[i]), np.int64)
    of = np.repeat(np.arange(len(ids)), [len(per[i]) for i in ids])
    model = Neighbours(np.array(ids, np.int64), y, terms, _weights(at, y[of], toxic, len(rows) - toxic, shares), k=k, shares=shares)
    vectors = model.build([model.vector(per.pop(i)) for i in ids])
    none = [label for i, label in rows if i in per]
    model.rest = _smoothed(sum(none) * shares[1], sum(shares[label] for label in none), len(none)) if none else rest
    votes = []
    for e in range(0, len(vectors), TOGETHER):
        part = vectors[e : e + TOGETHER]
        votes += [model.vote(*found) for found in model.nearest_all(part, list(range(e, e + len(part))))]
    votes = np.array(votes)
    has = votes >= 0
    if has.any():
        model.edges, model.values = _isotonic(votes[has], model.labels[has], shares)
    return model


def _weights(at: np.ndarray, y: np.ndarray, n1: int, n0: int, shares: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """Weight of each term, from the terms ``at`` of the examples and the label ``y`` at each."""
    n = n1 + n0
    a = np.bincount(at, y)
    df = np.bincount(at)
    b = df - a
    spread = n1 * n0 * df * (n - df)  # 0 for a term of all examples
    root = np.sqrt(n / np.maximum(spread, 1)) * np.abs(a * (n0 - b) - b * (n1 - a)) * (spread > 0)
    share = (a * shares[1] + b * shares[0]) / (n1 * shares[1] + n0 * shares[0])
    return (1 - np.log(share)) * (FLOOR + np.maximum(0, root - CHANCE) / np.sqrt(n))


def score(docs: DataFrame, model: Neighbours, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``score``, ``predicted``, and evidence: ``neighbours``, ``cosines`` per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the examples' words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches):
            s, near, cos = zip(*m.scores(batch.column(1).to_pylist()), strict=True)
            arrays = [batch.column(0), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32()), pa.array(near, pa.list_(pa.int64())), pa.array(cos, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "score", "predicted", "neighbours", "cosines"])

    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    out = picked.mapInArrow(run, f"key {kind}, score double, predicted int, neighbours array<long>, cosines array<double>")
    return out.withColumnRenamed("key", key)
