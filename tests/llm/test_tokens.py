"""SentencePiece, token counts and the token store against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from conftest import SF

from diurnal.llm import queries, sentencepieces, token_counts, tokenstore
from diurnal.session import scratch_dir

from .conftest import ROWS


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(token_counts.default_tokenizer())


def _documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_sentencepiece_odd_rows(odd, empty, pieces):
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in sentencepieces.round_trip(odd).collect()), key=str)
    want = [(i, pieces.encode(t or ""), pieces.decode(pieces.encode(t or ""))) for i, t, *_ in ROWS]
    assert got == sorted(want, key=str)
    assert sentencepieces.round_trip(empty).collect() == []
    texts = sorted((r["text"] for r in sentencepieces.decode(sentencepieces.encode(odd)).collect()))
    assert texts == sorted(t for *_, t in want)


def test_sentencepiece_all_documents(spark, sf, pieces):
    texts = _documents(spark)
    for r in queries.QUERIES["op4_sentencepiece"](spark, sf).collect():
        ids = pieces.encode(texts[r["doc_id"]])
        want = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), pieces.decode(ids))]
        assert [r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]] == [len(ids), *want]


def test_model_whose_pieces_may_cross_markers_is_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(sentencepieces.default_model(), "rb") as f:
        model.ParseFromString(f.read())
    model.pieces[500].piece = "of▁the"
    path = tmp_path / "crossing.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="cross"):
        sentencepieces.check_model(str(path))


def test_chunk_table_is_bounded():
    from diurnal.llm.chunks import ChunkTable

    calls = []
    table = ChunkTable(lambda cs: calls.append(cs) or [c.upper() for c in cs], capacity=3, longest=5)
    assert table.results(["a", "b", "a", "long-chunk"]) == ["A", "B", "A", "LONG-CHUNK"]
    assert "long-chunk" not in table.young
    for i in range(50):
        table.results([f"c{i}", "a"])
        assert len(table.young) <= 6 and len(table.old) <= 6
    assert sum("a" in c for c in calls) == 1  # a frequent chunk stays


def test_flat_table_encodes_each_unknown_chunk_once():
    """Chunks are looked up as they come; clashes, a full array of ids and long chunks change no result."""
    from diurnal.llm.chunks import FlatTable, chunk_keys, chunk_places, laid_out

    def looked_up(table, data):
        starts, ends = chunk_places(data)
        asked = []

        def encode(new):
            own = [data[a:b] for a, b in zip(starts[new], ends[new], strict=True)]
            asked.extend(own)
            return np.array([len(c) for c in own]), np.frombuffer(b"".join(own), np.uint8).astype(np.uint32)

        ids, after = laid_out(*table.look_up(chunk_keys(data, starts, ends), encode))
        assert bytes(ids.astype(np.uint8)) == b"".join(data.split()) and len(after) == len(data.split()) + 1
        return asked

    data = b"a bb a  \n12345678 12345678 123456789 bb 123456780 " + b"x" * 32 + b" " + b"y" * 33 + b" a\t" + b"y" * 33
    table = FlatTable(capacity=4_000)
    assert sorted(looked_up(table, data)) == sorted([*set(data.split()), b"y" * 33])
    assert sorted(looked_up(table, data + b" new bb new")) == [b"new", b"y" * 33, b"y" * 33]  # long ones are never kept
    small = FlatTable(capacity=2)
    rng = random.Random(5)
    for _ in range(60):
        looked_up(small, b" ".join(bytes(rng.choices(b"ab", k=rng.randrange(1, 5))) for _ in range(rng.randrange(40))))
    assert small.keys.shape[1] == 4 and len(small.ids) == 16
    looked_up(small, b" \n ")


def test_words_of_lines_equal_the_pattern():
    rng = random.Random(9)
    signs = "abzst'rvemld019\"!?.,-_<|>[]{}`~@àßöøÿıſ"
    for _ in range(400):
        lines = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 6))]
        data = "\n".join(lines).encode()
        starts, ends = token_counts._word_places(data)
        assert [data[a:b].decode() for a, b in zip(starts, ends, strict=True)] == [w for x in lines for w in token_counts._WORD.findall(x)]


def test_token_counts_odd_rows(odd, empty, tokenizer):
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(odd, 100).collect()), key=str)
    want = []
    for i, t, *_ in ROWS:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 100))
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(empty).collect() == []


@pytest.mark.parametrize("budget", [0, 1, 3, 7, 11])
def test_longest_fitting_prefix(tokenizer, budget):
    e = token_counts.encoder(token_counts.default_tokenizer())
    count = lambda s: len(tokenizer.encode(s, add_special_tokens=False).ids)
    for text in ("", "unbelievable things happened, weren't they?  end", "naïve café  déjà-vu\n\tΣΊΣΥΦΟΣ", " lead and trail "):
        fit = e.fitting(text.encode(), e.prefix_counts(text.encode()), budget)
        assert fit == max(i for i in range(len(text) + 1) if count(text[:i]) <= budget), (text, budget)


@pytest.mark.parametrize("seed", range(4))
def test_words_and_pieces_equal_the_library(tokenizer, seed):
    """Random texts over awkward characters, cut here or by the library."""
    rng = random.Random(seed)
    latin = "abzABZ019'\"!?.,-_<|>[]{}`~@ \t\n\r\x0b\x0c" + "".join(map(chr, range(0xC0, 0x180)))
    wide = latin + "İ\u0301\u0327  ­Σςσ漢字😀\x00\x1c\x7fªº²½"
    bits = ["'s", "'re", "'LL", "don't", "<|endoftext|>", "<|startoftext|", " ", "İ"]
    e = token_counts.encoder(token_counts.default_tokenizer())
    for alphabet in (latin, wide):
        for _ in range(300):
            text = "".join(rng.choice(bits) if rng.random() < 0.15 else rng.choice(alphabet) for _ in range(rng.randrange(40)))
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(e.encode(text.encode()), "<u4").tolist() == want, text
            assert e.prefix_counts(text.encode())[-1] == len(want)


def test_prefix_table(odd, tokenizer):
    texts = {i: t or "" for i, t, *_ in ROWS}
    for r in token_counts.prefix_table(odd).collect():
        if len(texts[r["doc_id"]]) < 1000:
            assert r["tokens"] == [len(tokenizer.encode(texts[r["doc_id"]][:e], add_special_tokens=False).ids) for e in r["ends"]]


def test_token_counts_all_documents(spark, sf, tokenizer):
    texts = _documents(spark)
    for r in queries.QUERIES["op6_token_counts"](spark, sf).collect():
        assert r["n_tokens"] == len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids)


def test_store_all_documents(spark, sf, tokenizer):
    texts, start = _documents(spark), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.QUERIES["op7_token_store"](spark, sf).collect()}
    assert len(got) == len(texts)
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_store_odd_rows_and_unknown_keys(spark, odd, empty, tokenizer, monkeypatch):
    path = scratch_dir(spark, "store")
    tokenstore.write(odd, path)
    read = [(r["key"], r["occurrence"], r["ids"]) for r in tokenstore.read_documents(spark, path).collect()]
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    assert sorted(((k, i) for k, _, i in read), key=str) == sorted(((i, ids(t)) for i, t, *_ in ROWS), key=str)
    assert sorted((k, o) for k, o, _ in read if k in (2, 3)) == [(2, 0), (2, 1), (3, 0), (3, 1)]
    asked = spark.createDataFrame([(5, 0), (2, 1), (2, 2), (77, 0), (None, 0), (-1, 0)], "key long, occurrence long")
    found = {(r["key"], r["occurrence"]): r["n"] for r in tokenstore.lookup(spark, path, asked).collect()}
    assert found == {(5, 0): len(ids(ROWS[0][1])), (2, 1): len(ids(ROWS[7][1])), (None, 0): len(ids(ROWS[4][1]))}
    nothing = scratch_dir(spark, "store")
    tokenstore.write(empty, nothing)
    assert tokenstore.read_documents(spark, nothing).collect() == []
    assert tokenstore.lookup(spark, nothing, asked).collect() == []


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 5000])
def test_perfect_hash(n):
    hashes = tokenstore.key_hashes(np.arange(n) * 7 - 3, np.arange(n) % 2)
    slots = tokenstore.PerfectHash.over(hashes).slots(hashes)
    assert sorted(slots.tolist()) == list(range(n))


def test_tokenizer_files_are_not_in_the_repository():
    assert "repo" not in public_tokenizers.path("")


@pytest.mark.parametrize("kind", ["han", "thai", "base64", "letters"])
def test_longest_fitting_prefix_of_a_long_chunk(tokenizer, kind):
    """5,000 code points without white space are cut where the library's own counts say."""
    rng = random.Random(7)
    draw = {
        "han": lambda: chr(rng.randrange(0x4E00, 0x9000)),
        "thai": lambda: chr(rng.randrange(0x0E01, 0x0E2F)),
        "base64": lambda: rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
        "letters": lambda: rng.choice("abcdefghijklmnopqrstuvwxyz"),
    }[kind]
    text = "two words " + "".join(draw() for _ in range(5000))
    e = token_counts.encoder(token_counts.default_tokenizer())
    for budget in (150, 1200):
        fit = e.fitting(text.encode(), e.prefix_counts(text.encode()), budget)
        count = lambda i: len(tokenizer.encode(text[:i], add_special_tokens=False).ids)
        assert 10 < fit < len(text) and count(fit) <= budget
        assert all(count(i) > budget for i in (*range(fit + 1, fit + 40), *range(fit + 40, len(text), 97), len(text)))


def test_cut_equals_every_prefix(tokenizer):
    rng = random.Random(3)
    e = token_counts.encoder(token_counts.default_tokenizer())
    for alphabet in ("abet'sre<|>12!.", "漢字日本語中国人的一是", "aé\u0301Σσ漢'll", "xXyY--"):
        for _ in range(25):
            chunk = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40)))
            counts = [len(tokenizer.encode(chunk[:i], add_special_tokens=False).ids) for i in range(len(chunk) + 1)]
            for budget in (0, 1, 3, 8):
                assert e.cut(chunk, budget) == max(i for i, n in enumerate(counts) if n <= budget), (chunk, budget)
