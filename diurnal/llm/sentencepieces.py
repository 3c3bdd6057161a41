"""SentencePiece encoding and decoding through a distinct-chunk table (operator 4).

The model's pieces never hold a whitespace marker after another character, so no piece
crosses from one marked word (a run of markers and what follows up to the next marker) into
the next. Encoding a text is then the concatenation of its marked words' encodings. Each
task keeps a bounded table of the marked words it has met, segments each distinct one once
with the library, and joins ids back by position; nothing is shuffled. Models for which the
property does not hold (or that normalise text) are refused.

Null texts count as empty and give no ids. Very long texts are one row each; repeated rows
give repeated results; an empty table gives an empty one. Only the id and text columns are
read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .chunks import ChunkTable
from .common import pieces

#: The marker that stands for a space inside pieces.
MARK = "▁"
_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def check_model(path: str) -> None:
    """Raise ValueError if pieces may cross whitespace markers or text is normalised."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    crossing = [p.piece for p in model.pieces if re.search(f"[^{MARK}]{MARK}", p.piece)]
    user_defined = [p.piece for p in model.pieces if p.type == p.USER_DEFINED]
    if crossing or user_defined or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError(f"pieces of {path} may cross whitespace markers, or it normalises text")


class Codec:
    """A task's library processor with its chunk table."""

    def __init__(self, path: str):
        check_model(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = ChunkTable(self._segment)

    def _segment(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """Ids as little-endian int32 bytes and the decoded text, of marked words.

        The library puts one marker before what it encodes, so a chunk goes in without its
        first one; it takes one off when decoding, so a space is put back.
        """
        alone = [self.processor.piece_to_id(MARK)]
        ids = [alone if len(c) == 1 else x for c, x in zip(chunks, self.processor.encode([c[1:] for c in chunks], num_threads=1), strict=True)]
        texts = self.processor.decode(ids, num_threads=1)
        return [(np.array(x, "<i4").tobytes(), " " + t) for x, t in zip(ids, texts, strict=True)]

    def round_trip(self, text: str) -> tuple[bytes, str]:
        """Ids and decoded text of a whole text."""
        if not text:
            return b"", ""
        parts = self.table.results(_CHUNK.findall(" " + text))
        return b"".join([p[0] for p in parts]), "".join([p[1] for p in parts])[1:]


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _id_lists(rows: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def round_trip(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode: ``key``, ``ids`` (array of int), ``decoded`` (string), per row."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in pieces(batches):
            both = [c.round_trip(t or "") for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), _id_lists([x[0] for x in both]), pa.array([x[1] for x in both], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "ids", "decoded"])

    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def encode(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` of each whole text."""
    return round_trip(docs, model, key, text).select(key, "ids")


def decode(encoded: DataFrame, model: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` of rows of ids (null ids: empty), by the library's decoder."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = codec(path).processor
        for batch in pieces(batches):
            texts = [p.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    picked = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def digests(trips: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token count and digests of ids and decoded text, from :func:`round_trip`'s rows."""
    return trips.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
