"""Fill-in-the-middle transformation by block rotation in place (operator 12).

A text is cut between two units (lines) into prefix, middle and suffix. The three sentinels are
inserted into one bytearray before their segments, which stand in reading order. Segments then
change places by rotations, each of which reverses the two blocks and then both together, so no second
copy of a text is laid out. Prefix-suffix-middle is a rotation of middle and suffix, suffix-prefix-middle
one of prefix and middle against suffix. The inverse finds the sentinels in an output, rotates back
and deletes them: the text is restored byte for byte from the output and its form alone.

Cuts follow from a hash of the id, so that reruns agree. One pass over the texts, without a shuffle.

Null and empty texts, and texts that contain a sentinel, stay as they are (form ``plain``). A row
without id is cut by the hash of an empty id; rows repeated are cut alike. Cuts may coincide with each
other or with the ends, so that segments are empty. An empty table gives an empty one. Only the id and
text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, utf8

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = SENTINELS = (b"<P>", b"<S>", b"<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"


def rotate(data: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange the blocks ``data[start:middle]`` and ``data[middle:end]`` by three reversals."""
    view = np.frombuffer(data, np.uint8)
    for a, b in ((start, middle), (middle, end), (start, end)):
        half = (b - a) // 2
        low, high = view[a : a + half], view[b - half : b][::-1]
        low ^= high  # exchanged without a copy: the two halves never overlap
        high ^= low
        low ^= high


def draws(key, seed: int) -> list[int]:
    """Four numbers from the hash of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def line_starts(text: bytes) -> np.ndarray:
    """Byte offset of each line, and the text's length; a line ends with its line break."""
    if not text:
        return np.zeros(1, np.int64)
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    if not len(ends) or ends[-1] != len(text):
        ends = np.append(ends, len(text))
    return np.concatenate([[0], ends])


def code_points(text: bytes) -> int:
    """Number of code points of valid UTF-8."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def arrange(text: bytes, first: int, second: int, form: str) -> bytes:
    """The output for a text cut at two byte offsets."""
    data = bytearray(text)
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):  # from the end, so offsets hold
        data[at:at] = mark
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(data, middle if form == PSM else 0, suffix, len(data))
    return bytes(data)


def rearrange(output: bytes, form: str) -> bytes:
    """The text that :func:`arrange` made an output from."""
    if form == PLAIN:
        return output
    data = bytearray(output)
    # the last block of either form came before its suffix block
    start, back = data.index(SUFFIX), data.index(MIDDLE if form == PSM else PREFIX)
    rotate(data, start, back, len(data))
    for mark in SENTINELS:
        at = data.index(mark)
        del data[at : at + len(mark)]
    return bytes(data)


def transform(text: bytes, key, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, code points of prefix and middle, and output of one text."""
    starts = line_starts(text)
    n = len(starts) - 1
    h1, h2, h3, h4 = draws(key, seed)
    if not text or any(mark in text for mark in SENTINELS) or h3 % 100 >= rate:
        return n, PLAIN, None, None, text
    first, second = (int(starts[x]) for x in sorted((h1 % (n + 1), h2 % (n + 1))))
    form = SPM if h4 % 100 < spm else PSM
    return n, form, code_points(text[:first]), code_points(text[first:second]), arrange(text, first, second, form)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n`` lines, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every row.

    ``rate`` of 100 texts are transformed, ``spm`` of 100 of these with the suffix first.
    """
    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = picked.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [transform(t, k, seed, rate, spm) for k, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True)
            arrays = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = picked.mapInArrow(run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("key", key)


def restore(outputs: DataFrame, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """The columns of ``outputs`` with the text ``out`` that each output was made from in place of the output."""
    others = outputs.drop(output)
    rest = F.struct(*[F.col(f"`{c}`") for c in others.columns])
    kept = outputs.select(F.col(output).alias("output"), F.col(form).alias("form"), rest.alias("rest"))
    kind = others.schema.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [rearrange(o, f) for o, f in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(texts, pa.binary()).cast(pa.string())], names=["rest", "restored"])

    made = kept.mapInArrow(run, f"rest {kind}, restored string")
    return made.select("rest.*", F.col("restored").alias(out))
