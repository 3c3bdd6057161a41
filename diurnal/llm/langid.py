"""Language of texts by a bidirectional gated recurrent network over bytes (operator 2).

The network reads a text's UTF-8 bytes in windows of ``WINDOW``, with one gated recurrent
layer in each direction, labels every position with language probabilities, and a
document's probabilities are the mean over all its positions. It is trained in NumPy by
backpropagation through time, on a bounded sample of labelled texts: at most ``per_lang``
documents of each language (those with the smallest hashed ids) and ``SPREAD`` windows of each.
The weights, about 25 KB, travel with the tasks; every text is read whole, in one pass,
and nothing is shuffled.

A null text or one without any letter is ``und`` with score 0; so is every text if nothing
was labelled. Windows begin with a zero state. Ties between languages go to the first by name. Repeated rows get
equal results; an empty table gives an empty one. Only the columns named are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, sample_by_hash, utf8

#: Bytes of a window, training windows of a document, and windows computed at once.
WINDOW, SPREAD, AT_ONCE = 96, 6, 4096
UNDETERMINED = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode())


@dataclass
class Direction:
    """One gated recurrent layer; columns are units, gates are stacked update, reset, new.

    The halves for sigmoid gates are kept inside the weights: sigmoid(a) = (1 + tanh(a/2)) / 2.
    """

    inputs: np.ndarray  # 3H x 256, one column per byte value
    state: np.ndarray  # 3H x H

    def forward(self, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (T x H x B) after each position of windows (T x B)."""
        steps, count = codes.shape
        size = self.state.shape[1]
        h = np.zeros((size, count), np.float32)
        out, saved = np.empty((steps, size, count), np.float32), []
        gate, new = self.state[: 2 * size], self.state[2 * size :]
        for t in range(steps):
            x = self.inputs[:, codes[t]]
            zr = np.tanh(x[: 2 * size] + gate @ h)
            zr *= np.float32(0.5)
            zr += np.float32(0.5)
            z, r = zr[:size], zr[size:]
            inner = new @ h
            n = np.tanh(x[2 * size :] + r * inner)
            if keep:
                saved.append((h, z, r, inner, n))
            h = n + z * (h - n)
            out[t] = h
        return out, saved

    def backward(self, codes: np.ndarray, saved: list, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the weights, through all positions, from those of the states."""
        size = self.state.shape[1]
        d_inputs, d_state = np.zeros_like(self.inputs), np.zeros_like(self.state)
        dh = np.zeros_like(grads[0])
        gates = np.empty((len(codes), len(self.state), codes.shape[1]), np.float32)
        for t in range(len(codes) - 1, -1, -1):
            h, z, r, inner, n = saved[t]
            dh = dh + grads[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z) * 2
            dr = dn * inner * r * (1 - r) * 2
            da = np.concatenate([dz, dr, dn])
            gates[t] = da
            d_state[: 2 * size] += da[: 2 * size] @ h.T
            d_state[2 * size :] += (dn * r) @ h.T
            dh = dh * z + self.state[: 2 * size].T @ da[: 2 * size] + self.state[2 * size :].T @ (dn * r)
        order = np.argsort(codes, axis=None, kind="stable")
        seen, first = np.unique(codes.ravel()[order], return_index=True)
        by_position = gates.transpose(0, 2, 1).reshape(-1, len(self.state))
        d_inputs[:, seen] = np.add.reduceat(by_position[order], first, axis=0).T
        return d_inputs, d_state


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # L x 2H
    bias: np.ndarray  # L x 1

    @classmethod
    def new(cls, languages: list[str], size: int = 8, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        layer = lambda: Direction(f(3 * size, 256, scale=0.3), f(3 * size, size, scale=0.3))
        return cls(languages, layer(), layer(), f(len(languages), 2 * size, scale=0.3), np.zeros((len(languages), 1), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.inputs, self.ahead.state, self.back.inputs, self.back.state, self.out, self.bias]

    def positions(self, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Probabilities (T x L x B) at every position of windows (T x B)."""
        a, saved_a = self.ahead.forward(codes, keep)
        b, saved_b = self.back.forward(codes[::-1], keep)
        b = b[::-1]
        size = a.shape[1]
        logits = np.matmul(self.out[:, :size], a) + np.matmul(self.out[:, size:], b) + self.bias
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits, (a, b, saved_a, saved_b)

    def gradients(self, codes: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over positions, and its gradients by backpropagation through time."""
        p, (a, b, saved_a, saved_b) = self.positions(codes, keep=True)
        steps, _, count = p.shape
        size = a.shape[1]
        loss = -np.log(p[:, truth, np.arange(count)] + 1e-9).mean()
        d = p.copy()
        d[:, truth, np.arange(count)] -= 1
        d /= steps * count
        d_out = np.concatenate([np.einsum("tlb,thb->lh", d, a), np.einsum("tlb,thb->lh", d, b)], 1)
        ga = self.ahead.backward(codes, saved_a, np.matmul(self.out[:, :size].T, d))
        gb = self.back.backward(codes[::-1], saved_b, np.matmul(self.out[:, size:].T, d)[::-1])
        return float(loss), [*ga, *gb, d_out, d.sum((0, 2))[:, None]]

    def train(self, codes: np.ndarray, truth: np.ndarray, steps: int = 250, batch: int = 192, rate: float = 0.02, seed: int = 11) -> float:
        """Adam over random batches of windows (N x T); the last loss."""
        rng = np.random.default_rng(seed)
        w = self.weights()
        m, v, loss = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], float("nan")
        for step in range(1, steps + 1):
            at = rng.integers(0, len(codes), batch)
            loss, grads = self.gradients(np.ascontiguousarray(codes[at].T), truth[at])
            pace = rate * (1 - step / (steps + 1)) + rate * 0.05
            for x, g, a, b in zip(w, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                x -= (pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Pooled probabilities (documents x L), the mean over all positions; zeros for empty texts."""
        lengths = np.array([len(t) for t in texts], np.int64)
        windows = -(-lengths // WINDOW)
        total = int(windows.sum())
        sums = np.zeros((total, len(self.languages)))
        padded = np.frombuffer(b"".join([t + bytes(int(w) * WINDOW - len(t)) for t, w in zip(texts, windows, strict=True)]), np.uint8).reshape(total, WINDOW)
        filled = np.full(total, WINDOW, np.int64)
        ends = np.cumsum(windows)
        some = windows > 0
        filled[ends[some] - 1] = lengths[some] - (windows[some] - 1) * WINDOW
        order = np.argsort(filled, kind="stable")  # windows that are not full come together
        for at in range(0, total, AT_ONCE):
            own = order[at : at + AT_ONCE]
            n = filled[own]
            if n.min() == WINDOW:
                p, _ = self.positions(np.ascontiguousarray(padded[own].T))
                sums[own] = p.sum(0).T
            else:  # shorter windows one length at a time, so that padding is never read
                for length in np.unique(n).tolist():
                    same = own[n == length]
                    p, _ = self.positions(np.ascontiguousarray(padded[same, :length].T))
                    sums[same] = p.sum(0).T
        out = np.zeros((len(texts), len(self.languages)))
        out[some] = np.add.reduceat(sums, (ends - windows)[some], axis=0) / lengths[some, None] if total else 0
        return out


def spread_windows(text: bytes) -> list[bytes]:
    """At most ``SPREAD`` windows at even distances over a text; a shorter text fills one by being repeated."""
    if not text:
        return []
    if len(text) < WINDOW:
        return [((text + b" ") * (WINDOW // len(text) + 1))[:WINDOW]]
    starts = np.unique(np.linspace(0, len(text) - WINDOW, SPREAD).astype(int))
    return [text[s : s + WINDOW] for s in starts]


def fit(docs: DataFrame, per_lang: int = 150, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """Network trained on the rows of ``docs`` with a language; None if there are none.

    Texts of any length are learned from, if they have a letter. If none has, the most frequent language stands for all.
    """
    labelled = docs.where(F.col(key).isNotNull() & F.col(lang).isNotNull())
    slim = labelled.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"))
    chosen = sample_by_hash(slim.distinct(), "lang", "key", per_lang)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [(k, y, t) for k, y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True) if has_letter(t)]
            rows = [(k, y, w) for k, y, t in texts for w in spread_windows(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], names=["key", "lang", "window"])

    # the chosen ids are at most per_lang for each language
    texts = labelled.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key")
    texts = texts.select(F.col("key").cast("string").alias("key"), "lang", "text")
    rows = sorted((r["lang"], r["key"], bytes(r["window"])) for r in texts.mapInArrow(cut, "key string, lang string, window binary").collect())
    if not rows:
        most = labelled.groupBy(F.col(lang).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").first()
        return Network.new([most["lang"]]) if most else None
    languages = sorted({r[0] for r in rows})
    codes = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, WINDOW)
    truth = np.array([languages.index(r[0]) for r in rows])
    # every language is learned from equally often
    most = np.bincount(truth).max()
    at = np.concatenate([np.resize(np.flatnonzero(truth == y), most) for y in range(len(languages))])
    network = Network.new(languages)
    network.train(codes[at], truth[at])
    return network


def identify(docs: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` (its pooled probability) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in pieces(batches):
            texts = utf8(batch.column(1))
            known = np.array([net is not None and has_letter(t) for t in texts])
            lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            if known.any():
                p = net.documents([t for t, ok in zip(texts, known, strict=True) if ok])
                best = p.argmax(1)
                lang[known] = [net.languages[b] for b in best]
                score[known] = np.minimum(p[np.arange(len(p)), best], 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["key", "lang_pred", "score"])

    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
