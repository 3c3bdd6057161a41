"""Exact token counts at every prefix by dynamic programming (operator 6).

The tokenizer's words never span ASCII white space, and its normaliser acts on each side of it
alone, so ``count(prefix k) = count(prefix k-1) + count(chunk k)`` over the chunks between
white space: a running sum gives the exact count at every chunk end. Inside a chunk ``prefix_counts``
gives the count at every prefix in one pass, by the last token of each. Budget and truncation
questions are answered from these arrays by binary search and one such pass over the chunk at the budget, which
ends soon after it, without encoding the text again.

Tasks keep bounded tables of distinct chunks, and below these of distinct words: chunks of ASCII
and Latin letters (``_OTHER`` finds what does not belong) are cut into words here, and many new
words go to the library as one text. Nothing is shuffled.

Null texts count as empty: no bytes, no tokens. Repeated rows give repeated results, an empty
table an empty one. Only the id and text columns are read.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import FlatTable, chunk_keys, chunk_places, laid_out
from .common import BLANKS, pieces, utf8
from .prefix_counts import PrefixCounter

#: Bytes of texts whose chunks are looked up together, about.
TOGETHER = 1 << 19

# After lower-casing, chunks without _OTHER consist of digits, signs, and letters that
# lower-case one to one and are in composed form already.
_OTHER = re.compile("[^\n!-~À-ÖØ-öø-įı-ſ]|<\\|(?:start|end)oftext\\|>")
_WORD = re.compile("[a-zß-öø-ſ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\\[-`{-~]+")
_QUOTED = re.compile(rb"[^\n]*'[^\n]*")
_LINE_END, _LETTER, _DIGIT, _SIGN = range(4)
#: What a byte of such chunks belongs to: those of letters beyond ASCII are 128 and above.
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[ord("\n")], _KIND[ord("0") : ord("9") + 1], _KIND[ord("a") : ord("z") + 1], _KIND[128:] = _LINE_END, _DIGIT, _LETTER, _LETTER
_CHUNK = re.compile(rb"[^%b]+" % BLANKS)


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """A task's tokenizer with tables of the ids of words and of other pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        # each word's last id, and no other, stands for a token with the word-end mark
        self.ends = np.zeros(max(tokens.values()) + 1, bool)
        self.ends[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        self.words = FlatTable(capacity=400_000)
        self.chunks = FlatTable(capacity=400_000)

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _ids_of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words, encoded as one text, whose ids end with each word's last one."""
        ids = np.array(self._encode([" ".join(words)])[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return self._ids_alone(words)
        return np.diff(stops, prepend=0), ids

    def _ids_alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self._encode(texts)]
        return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(itertools.chain.from_iterable(found), np.uint32)

    def _ids_of_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of chunks: by their words, or by the library those with what it alone can cut."""
        joined = b"\n".join(chunks).decode()
        if not _OTHER.search(joined):
            return self._ids_of_lines(joined)
        texts = joined.split("\n")
        other = np.fromiter((_OTHER.search(t) is not None for t in texts), bool, len(texts))
        alone = self._ids_alone([t for t, o in zip(texts, other, strict=True) if o])
        usual = [t for t, o in zip(texts, other, strict=True) if not o]
        by_words = self._ids_of_lines("\n".join(usual)) if usual else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        size = np.empty(len(texts), np.int64)
        size[~other], size[other] = by_words[0], alone[0]
        begin = np.empty(len(texts), np.int64)
        begin[~other] = np.cumsum(by_words[0]) - by_words[0]
        begin[other] = len(by_words[1]) + np.cumsum(alone[0]) - alone[0]
        return size, laid_out(begin, size, np.concatenate([by_words[1], alone[1]]))[0]

    def _ids_of_lines(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of chunks, one a line, through the table of words."""
        data = text.lower().encode()  # as many bytes: the letters of such chunks keep their length
        starts, ends = _word_places(data)

        def encode(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return self._ids_of_words([data[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])

        ids, after = laid_out(*self.words.look_up(chunk_keys(data, starts, ends), encode))
        lines = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == ord("\n")), len(data))
        return np.diff(after[np.searchsorted(starts, lines)], prepend=0), ids

    def encode_all(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per text all ids (uint32) and the token counts after each chunk, 0 before the first."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < TOGETHER):
                size += len(texts[to]) + 1
                to += 1
            yield from self._encode_together(texts[at:to])
            at = to

    def _encode_together(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks are looked up in arrays, unknown ones encoded once, and their ids laid out by position."""
        data = b"\n".join(texts)
        starts, ends = chunk_places(data)

        def encode(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return self._ids_of_chunks([data[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])

        ids, after = laid_out(*self.chunks.look_up(chunk_keys(data, starts, ends), encode))
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        chunk_at = np.searchsorted(starts, bounds)
        for a, b in zip(chunk_at[:-1].tolist(), chunk_at[1:].tolist(), strict=True):
            yield ids[after[a] : after[b]], after[a : b + 1] - after[a]

    def encode(self, text: bytes) -> bytes:
        """All ids of a text as little-endian uint32."""
        return next(self.encode_all([text]))[0].tobytes()

    def prefix_counts(self, text: bytes) -> np.ndarray:
        return next(self.encode_all([text]))[1]

    @staticmethod
    def ends_of(text: bytes) -> list[int]:
        """Code points up to each chunk's end, beginning with 0: the places of ``prefix_counts``."""
        at, last, out = 0, 0, [0]
        for m in _CHUNK.finditer(text):
            at += m.start() - last + len(m[0].decode())
            last = m.end()
            out.append(at)
        return out

    def cut(self, chunk: str, budget: int) -> int:
        """Code points of the longest prefix of one chunk with at most ``budget`` tokens."""
        return self.prefixes.longest(chunk, budget)

    @functools.cached_property
    def prefixes(self) -> PrefixCounter:
        """Made when the first text is over its budget."""
        return PrefixCounter(self.tokenizer)

    def every_prefix(self, text: str) -> list[int]:
        """Counts of all prefixes of a text, the empty one first."""
        return [0, *(n for n, _ in self.prefixes.counts(text))]

    def fitting(self, text: bytes, counts: np.ndarray, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens.

        Counts never fall from one chunk end to the next, so the cut lies in the first chunk
        whose end is over the budget.
        """
        if counts[-1] <= budget:
            return len(text.decode())
        k = int(np.searchsorted(counts, budget, "right")) - 1
        rest = text.split(None, k)[k]
        chunk = rest.split(None, 1)[0].decode()
        before = len(text[: len(text) - len(rest)].decode())
        return before + self.cut(chunk, budget - int(counts[k]))


def _word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` and ``ends`` of the words of lower-case chunks, one a line: as ``_WORD`` finds them."""
    kind = _KIND[np.frombuffer(data, np.uint8)]
    begins = np.ones(len(kind), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    if b"'" in data:
        for m in _QUOTED.finditer(data):  # of a line with apostrophes the words are found one by one
            begins[m.start() : m.end()] = False
            text = m[0].decode()
            sizes = (len(w.encode()) for w in _WORD.findall(text))
            begins[m.start() + np.cumsum([0, *sizes])[:-1]] = True
    edges = np.append(np.flatnonzero(begins | (kind == _LINE_END)), len(kind))
    word = kind[edges[:-1]] != _LINE_END
    return edges[:-1][word], edges[1:][word]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_counts(docs: DataFrame, limit: int = 2048, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fit_chars`` of whole texts.

    ``fit_chars`` is the length in code points of the longest prefix within the limit.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in pieces(batches):
            texts = utf8(batch.column(1))
            rows = []
            for t, (_, counts) in zip(texts, e.encode_all(texts), strict=True):
                rows.append((len(t), int(counts[-1]), e.fitting(t, counts, limit)))
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "n_bytes", "n_tokens", "fit_chars"])

    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    out = picked.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, fit_chars long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


def prefix_table(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ends`` (code points at each chunk's end) and ``tokens`` (count up to there).

    Both arrays begin with 0. A budget question on a stored table is a search in ``tokens``.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, kinds = encoder(path), pa.list_(pa.int64())
        for batch in pieces(batches):
            texts = utf8(batch.column(1))
            arrays = [pa.array([e.ends_of(t) for t in texts], kinds), pa.array([e.prefix_counts(t).tolist() for t in texts], kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["key", "ends", "tokens"])

    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, ends array<long>, tokens array<long>").withColumnRenamed("key", key)
