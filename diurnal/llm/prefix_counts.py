"""Token counts at every prefix of a text without white space, in one pass (operator 6).

A byte-pair encoding is valid exactly if each pair of neighbouring tokens encodes to itself. So the encoding of
a word's first j bytes is that of some first k bytes and one more token, and for each j there is one
such k: ``count[j] = count[k] + 1``. A word's last symbol carries the word-end mark, so counts are kept for
words that go on, and the end is closed at each prefix by one more token with the mark.

Words are found as the tokenizer's pattern finds them, one code point at a time: letters and signs make runs,
digits stand alone, a contraction is only known at its last letter. The normaliser is applied from the last code point
on that nothing composes with, so that what stands before is final. Special strings are one token and
take back what their parts counted.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

#: Tokens that later code points can take back: those of a special string's parts, and of a contraction's.
SLACK = 16
#: Marks on one code point beyond which they are no longer followed one by one once the normaliser reorders them.
LONG_ROW = 64
#: Pairs of tokens whose validity is remembered.
PAIRS = 1 << 20
# What follows the apostrophe of a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_LETTER, _DIGIT, _BLANK, _SIGN = "LNSO"


@cache
def composing() -> frozenset[str]:
    """Code points that a code point before them may compose with, or be reordered around."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in map(chr, range(sys.maxunicode + 1)):
        if unicodedata.combining(c):
            found.add(c)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
        elif parts and not parts[0].startswith("<") and unicodedata.combining(chr(int(parts[0], 16))):
            found.add(c)
    return frozenset(found)


def byte_marks() -> list[str]:
    """The character that stands for each byte in the vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Pairs:
    """The vocabulary's merges, and which tokens may stand beside each other."""

    def __init__(self, description: dict):
        model = description["model"]
        self.end = model["end_of_word_suffix"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.marks = byte_marks()
        back = {m: b for b, m in enumerate(self.marks)}
        self.going, self.closing = {}, {}  # bytes -> token, without and with the word-end mark
        for token in model["vocab"]:
            mark = token.endswith(self.end) and token != self.end
            plain = token.removesuffix(self.end) if mark else token
            if plain and all(c in back for c in plain):
                (self.closing if mark else self.going)[bytes(back[c] for c in plain)] = token
        self.longest = max(map(len, (*self.going, *self.closing)))
        self.valid: dict[tuple[str, str], bool] = {}
        # code points that compose, in whole or in part, in one token
        inside = (t.decode(errors="ignore") for t in (*self.going, *self.closing) if max(t) > 127)
        self.most_marks = 2 + max((sum(c in composing() for c in t) for t in inside), default=0)

    def symbols(self, plain: str, mark: bool) -> list[str]:
        return [*plain[:-1], plain[-1] + self.end] if mark else list(plain)

    def encoded(self, symbols: list[str]) -> list[str]:
        """Tokens of a short sequence: the merge of lowest rank first, from the left."""
        while len(symbols) > 1:
            ranks = [self.rank.get(p, len(self.rank)) for p in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == len(self.rank):
                break
            at = ranks.index(best)
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def together(self, a: str, b: str) -> bool:
        """Whether token ``b`` may follow ``a``, or begin a word if ``a`` is empty."""
        known = self.valid.get((a, b))
        if known is None:
            mark = b.endswith(self.end)
            plain = a + (b.removesuffix(self.end) if mark else b)
            known = self.encoded(self.symbols(plain, mark)) == ([a, b] if a else [b])
            if len(self.valid) >= PAIRS:
                self.valid.clear()
            self.valid[a, b] = known
        return known


class Word:
    """Counts at every prefix of one word that goes on."""

    def __init__(self, pairs: Pairs):
        self.pairs, self.data = pairs, bytearray()
        self.count: list[int] = [0]
        self.last: list[str] = [""]

    def extend(self, more: bytes) -> None:
        for b in more:
            self.data.append(b)
            n, token = self._one_more(self.pairs.going)
            self.count.append(n)
            self.last.append(token)

    def cut(self, size: int) -> None:
        del self.data[size:], self.count[size + 1 :], self.last[size + 1 :]

    def _one_more(self, tokens: dict[bytes, str]) -> tuple[int, str]:
        """Count and last token of the whole word so far, its last token being one of ``tokens``."""
        data, j = self.data, len(self.data)
        for k in range(max(0, j - self.pairs.longest), j):
            token = tokens.get(bytes(data[k:j]))
            if token is not None and self.pairs.together(self.last[k], token):
                return self.count[k] + 1, token
        raise ValueError("the vocabulary lacks single bytes")

    def closed(self) -> int:
        """Tokens if the word ends here."""
        return self._one_more(self.pairs.closing)[0] if self.data else 0

    def least(self) -> int:
        """A count that no longer prefix of a word with this beginning falls below."""
        return min(self.count[-self.pairs.longest - 1 :])


class Run:
    """The state between two code points: tokens of complete words, and the word or contraction that is open."""

    def __init__(self, pairs: Pairs, kind_of):
        self.pairs, self.kind_of = pairs, kind_of
        self.done, self.kind, self.word, self.quote = 0, None, Word(pairs), ""

    def _close(self) -> None:
        if self.quote:
            quote, self.quote = self.quote, ""
            self._alone("'")
            if quote[1:]:
                self.kind = _LETTER
                self.word.extend(quote[1:].encode())
        if self.word.data:
            self.done += self.word.closed()
            self.word = Word(self.pairs)
        self.kind = None

    def _alone(self, text: str) -> None:
        word = Word(self.pairs)
        word.extend(text.encode())
        self.done += word.closed()

    def add(self, c: str) -> None:
        kind = self.kind_of(c)
        if self.quote:
            tail = self.quote[1:] + c
            if tail in CONTRACTIONS:
                self.quote = ""
                self._alone("'" + tail)
                return
            if kind == _LETTER and any(x.startswith(tail) for x in CONTRACTIONS):
                self.quote += c
                return
            quote, self.quote = self.quote, ""
            if not quote[1:] and kind == _SIGN:  # signs after an apostrophe go on with it
                self.kind = _SIGN
                self.word.extend(b"'")
            else:
                self._alone("'")
                if quote[1:]:
                    self.kind = _LETTER
                    self.word.extend(quote[1:].encode())
        if kind in (_LETTER, _SIGN) and kind == self.kind:
            self.word.extend(c.encode())
            return
        self._close()
        if kind == _DIGIT:
            self._alone(c)
        elif c == "'":
            self.quote = c
        elif kind != _BLANK:
            self.kind = kind
            self.word.extend(c.encode())

    def mark(self) -> tuple:
        return self.done, self.kind, self.word, len(self.word.data), self.quote

    def back_to(self, mark: tuple) -> None:
        self.done, self.kind, self.word, size, self.quote = mark
        self.word.cut(size)

    def total(self) -> int:
        """Tokens if the text ends here; the state stays as it is."""
        mark = self.mark()
        self._close()
        total = self.done
        self.back_to(mark)
        return total

    def least(self) -> int:
        return self.done + self.word.least()


class PrefixCounter:
    """Counts at every prefix, for a tokenizer of this kind: normaliser, pattern of words, byte-pair encoding."""

    def __init__(self, tokenizer):
        description = json.loads(tokenizer.to_str())
        self.pairs = Pairs(description)
        self.specials = [t["content"] for t in description["added_tokens"]]
        self._normal, self._split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self._count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
        self.kinds: dict[str, str] = {}
        self.composing = composing()

    def kind_of(self, c: str) -> str:
        """Letter, digit, blank or sign, as the tokenizer's own pattern takes it."""
        kind = self.kinds.get(c)
        if kind is None:
            if not self._split(c):
                kind = _BLANK
            elif len(self._split("a" + c)) == 1:
                kind = _LETTER
            else:
                kind = _SIGN if len(self._split(c + c)) == 1 else _DIGIT
            self.kinds[c] = kind
        return kind

    def counts(self, text: str) -> Iterator[tuple[int, int]]:
        """For each prefix in order: its count, and a count that no longer prefix falls below.

        A code point that composes with those before it may change what the normaliser makes of them. The state is
        taken back to the last one that nothing composes with only if the normalised text does not just go on.
        """
        base, origin = 0, 0  # tokens up to the last special string, and its end
        mixed = False  # a long row of marks is being reordered: the library counts until it ends
        specials = self._specials(text)
        special = next(specials, None)
        run, start, shown = Run(self.pairs, self.kind_of), 0, ""
        mark, least = run.mark(), run.least()
        for i in range(1, len(text) + 1):
            if special and i - 1 == special[0]:
                whole = base + (self._count(text[origin : i - 1]) if mixed else run.total())
            if special and i == special[1]:
                base, origin, start, shown, run, mixed = whole + 1, i, i, "", Run(self.pairs, self.kind_of), False
                mark, least = run.mark(), run.least()
                special = next(specials, None)
                yield base, base
                continue
            if text[i - 1] not in self.composing:
                if mixed:
                    run.back_to(mark)
                    for c in self._normal(text[start : i - 1]):
                        run.add(c)
                    mixed = False
                mark, least, start, shown = run.mark(), run.least(), i - 1, ""
            now = self._normal(text[start:i])
            floor = base + least + (i - start) // self.pairs.most_marks - SLACK
            mixed = mixed or (len(shown) > LONG_ROW and not now.startswith(shown))
            if mixed:
                yield base + self._count(text[origin:i]), floor
                continue
            if not now.startswith(shown):
                run.back_to(mark)
                shown = ""
            for c in now[len(shown) :]:
                run.add(c)
            shown = now
            yield base + run.total(), floor

    def _specials(self, text: str) -> Iterator[tuple[int, int]]:
        at = 0
        while True:
            found = min(((text.find(s, at), -len(s)) for s in self.specials if text.find(s, at) >= 0), default=None)
            if found is None:
                return
            at = found[0] - found[1]
            yield found[0], at

    def longest(self, text: str, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens.

        Counts may rise and fall from one prefix to the next; the search ends where they can no longer fall to the budget.
        """
        best = 0
        for i, (n, least) in enumerate(self.counts(text), start=1):
            if n <= budget:
                best = i
            elif least > budget:
                break
        return best
