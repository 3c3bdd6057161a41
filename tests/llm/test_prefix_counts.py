"""Counts at every prefix against the library's own."""

import random
import time

import pytest
import public_tokenizers
import tokenizers

from diurnal.llm import token_counts

LATIN = "abzABZ019'\"!?.,-_<|>[]{}`~@ " + "".join(map(chr, range(0xC0, 0x180)))
ALPHABETS = {
    "latin": LATIN,
    "wide": LATIN + "ị゙̧̇́  ­Σςσ漢字😀\x00\x1c\x7fªº²½かきハ　각각",
    "letters": "etaoinshrdlu'setallmdvr",
    "two": "aab",
    "han": "漢字日本語中国人的一是",
}
PIECES = ["'s", "'re", "'LL", "don't", "<|endoftext|>", "<|startoftext|", "İ", "the", "ing", "ation", "́<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def encoder():
    return token_counts.encoder(token_counts.default_tokenizer())


def by_library(library, text):
    return [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


@pytest.mark.parametrize("name", ALPHABETS)
def test_every_prefix(library, encoder, name):
    rng = random.Random(name)
    for _ in range(400):
        text = "".join(rng.choice(PIECES) if rng.random() < 0.12 else rng.choice(ALPHABETS[name]) for _ in range(rng.randrange(1, 40)))
        want = by_library(library, text)
        assert encoder.every_prefix(text) == want, text
        for budget in (0, 1, 3, 8):
            assert encoder.cut(text, budget) == max(i for i, n in enumerate(want) if n <= budget), (text, budget)


def test_long_rows_of_marks(library, encoder):
    rng = random.Random(6)
    for end in ("", "é", "<|endoftext|>x", "b c"):
        for _ in range(8):
            text = "ab" + "".join(rng.choice("̧̣́") for _ in range(rng.randrange(60, 180))) + end
            assert encoder.every_prefix(text) == by_library(library, text)


def test_prefixes_without_further_tokens_count(library, encoder):
    """Unicode blanks have no tokens: the longest prefix goes on behind them."""
    text = "3　 don't"
    assert encoder.fitting(text.encode(), encoder.prefix_counts(text.encode()), 1) == 3
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab3' \n　  !tdΣ") for _ in range(rng.randrange(25)))
        want = by_library(library, text)
        for budget in (0, 1, 2, 5):
            assert encoder.fitting(text.encode(), encoder.prefix_counts(text.encode()), budget) == max(i for i, n in enumerate(want) if n <= budget), (text, budget)


@pytest.mark.parametrize("name", ["sigma", "sigma and letters", "kana", "base64", "one letter"])
def test_chunks_of_a_megabyte(library, encoder, name):
    rng = random.Random(9)
    text = {
        "sigma": "Σ" * 500_000,
        "sigma and letters": "Σ" + "abc" * 300_000,
        "kana": "がぎ" * 100_000,
        "base64": "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000)),
        "one letter": "a" * 1_000_000,
    }[name]
    assert encoder.prefixes
    start = time.time()
    fit = encoder.cut(text, 2048)
    assert time.time() - start < 2
    count = lambda i: len(library.encode(text[:i], add_special_tokens=False).ids)
    assert count(fit) <= 2048 and all(count(i) > 2048 for i in range(fit + 1, fit + 60))
