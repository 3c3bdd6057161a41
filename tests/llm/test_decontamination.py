"""Benchmark decontamination against brute force over all windows."""

import hashlib
import random
import re
import time

import pytest
from compare import connect, difference
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from diurnal.llm import decontamination, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return WORD.findall((text or "").translate(LOWER))


def _by_hand(doc, items, window):
    """Number of words, hit places, ids of items with occurring windows."""
    w, hit, found = _words(doc), set(), set()
    for item, text in items:
        s = _words(text)
        size = min(window, len(s))
        if not size:
            continue
        windows = {tuple(s[i : i + size]) for i in range(len(s) - size + 1)}
        for j in range(len(w) - size + 1):
            if tuple(w[j : j + size]) in windows:
                hit |= set(range(j, j + size))
                if item is not None:
                    found.add(str(item))
    return len(w), hit, sorted(found)


def _rows(found):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()), key=str)


def _expected(docs, items, window):
    out = []
    for i, t in docs:
        n, hit, ids = _by_hand(t, items, window)
        out.append((i, n, len(hit), ids))
    return sorted(out, key=str)


def test_sql(spark, sf):
    assert difference(queries.QUERIES["op13_decontamination"](spark, sf), connect(sf), queries.ORACLES["op13_decontamination"]) is None


WORDS = st.lists(st.sampled_from([b"a", b"b", b"c", b"zz"]), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c", b"?"]), max_size=30), st.integers(1, 5))
def test_automaton_equals_all_windows(sequences, doc, window):
    packed = decontamination.Automaton.over(sequences, window).to_bytes()
    spans, found = decontamination.Automaton.from_bytes(packed).hits(doc)
    _, hit, ids = _by_hand(b" ".join(doc).replace(b"?", b"q").decode(), [(k, b" ".join(s).decode()) for k, s in enumerate(sequences)], window)
    assert {x for a, b in spans for x in range(a, b)} == hit
    assert sorted(map(str, found)) == ids
    assert all(spans[k][1] < spans[k + 1][0] for k in range(len(spans) - 1))


def _made(rng, n_items=60, n_docs=200):
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "漢字", "Ab", "x1"]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(draw(rng.choice([0, 1, 3, 9, 10, 11, 30, 200])))) for k in range(n_items)]
    items += [(None, items[6][1]), (500, items[6][1]), (7, items[9][1]), (501, None), (502, "... --- !")]
    docs = []
    for k in range(n_docs):
        words = draw(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            s = _words(rng.choice(items)[1])
            if s:
                a = rng.randrange(len(s))
                words[len(words) // 2 : len(words) // 2] = s[a : a + rng.randrange(1, 25)]
        docs.append((rng.randrange(n_docs) if k % 9 else None, rng.choice([" ", ", ", "\n"]).join(words)))
    return docs + docs[:5] + [(3, None), (None, None), (4, "")], items


@pytest.mark.parametrize("block, part", [(500_000, 20_000), (300, 17)])
def test_blocks_and_parts_change_nothing(spark, monkeypatch, block, part):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontamination, "PART_WORDS", part)
    docs, items = _made(random.Random(4))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({c: F.lit(1) for c in ("key", "print", "place", "spans", "items", "rest")})
    found = decontamination.contamination(d, spark.createDataFrame(items, "item_id long, text string").withColumn("sequence", F.lit("x")))
    assert _rows(found) == _expected(docs, items, 10)


def test_one_passage_in_most_documents(no_broadcast):
    """A hot item, many copies of it, and one document repeated many times."""
    spark = no_broadcast
    passage = " ".join(f"p{k}" for k in range(25))
    items = [(k, passage) for k in range(60)] + [(100 + k, f"own {k} " + " ".join(f"u{k}v{j}" for j in range(12))) for k in range(60)]
    docs = [(k, f"before {k}. {passage} after" if k % 3 else "clean words only") for k in range(300)] + [(7, f"before {passage}")] * 40
    found = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"))
    assert _rows(found) == _expected(docs, items, 10)


def test_nothing_to_find(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(n == 0 and ids == [] for _, _, n, ids in _rows(decontamination.contamination(odd, none)))
    assert _rows(decontamination.contamination(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string"))) == []


def test_odd_rows(spark, odd):
    items = [(1, "the CAT sat"), (2, "line"), (3, "word " * 12), (4, "Ça—VA"), (5, "x" * 5000), (6, "İstanbul σίσυφος")]
    found = decontamination.contamination(odd, spark.createDataFrame(items, "item_id long, text string"))
    assert _rows(found) == _expected([(r["doc_id"], r["text"]) for r in odd.collect()], items, 10)


def test_spans_are_removed_and_covered_documents_go(spark):
    passage = " ".join(f"p{k}" for k in range(12))
    docs = [(1, f"One, two. {passage}! Three " + "four " * 20, "a"), (2, f"so {passage}", "b"), (3, "clean\ntext ", "c"), (4, None, "d"), (1, f"One, two. {passage}! Three " + "four " * 20, "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string, key string")
    found = decontamination.contamination(d, spark.createDataFrame([(9, passage.upper())], "item_id long, text string"))
    got = decontamination.decontaminate(d, found)
    assert got.columns == d.columns
    kept = "One, two. ! Three " + "four " * 20
    assert sorted(map(tuple, got.collect())) == sorted([(1, kept, "a"), (1, kept, "a"), (3, "clean\ntext ", "c"), (4, None, "d")])
    longer = decontamination.decontaminate(d, found, least_span=13, most_coverage=1.0)
    assert sorted(longer.collect()) == sorted(d.collect())


def test_automaton_of_many_words_is_built_and_asked_quickly():
    rng = random.Random(2)
    sequences = [[b"%x" % rng.randrange(3000) for _ in range(40)] for _ in range(5000)]
    start = time.time()
    packed = decontamination.Automaton.over(sequences, 10).to_bytes()
    a = decontamination.Automaton.from_bytes(packed)
    assert len(packed) < 120 * 200_000 and time.time() - start < 30
    text = [b"%x" % rng.randrange(3000) for _ in range(300_000)]
    text[1000:1040] = sequences[77]
    start = time.time()
    assert a.hits(text) == ([(1000, 1040)], {77}) and time.time() - start < 3


def test_items_digest_of_none_is_that_of_an_empty_text(spark, sf):
    rows = queries.QUERIES["op13_decontamination"](spark, sf).where("n_items = 0").select("items_sha256").distinct().collect()
    assert [r[0] for r in rows] == [hashlib.sha256(b"").hexdigest()]
