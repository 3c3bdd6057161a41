"""Line dedup, SimHash components and span fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from compare import connect, difference
from pyspark.sql import functions as F

from diurnal.llm import linededup, queries, simhash, spanprints
from diurnal.llm.common import write_once
from diurnal.llm.components import components

from .conftest import ROWS


def test_line_dedup_sql(spark, sf):
    assert difference(queries.QUERIES["op9_line_dedup"](spark, sf), connect(sf), queries.ORACLES["op9_line_dedup"]) is None


def _lines_by_hand(texts, least):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    docs = [(t or "").split("\n") for t in texts]
    count = {}
    for d in docs:
        for k in {key(x) for x in d}:
            count[k] = count.get(k, 0) + 1
    kept = [[x for x in d if not key(x) or count[key(x)] < least] for d in docs]
    return sorted((len(d), len(d) - len(k), "\n".join(k)) for d, k in zip(docs, kept))


@pytest.mark.parametrize("send_bytes", [1 << 20, 0])  # filters sent to the tasks; digests joined
def test_line_dedup_odd_rows(odd, empty, send_bytes):
    counts = write_once(linededup.reference_counts(odd), "counts")
    got = linededup.drop_lines(odd, counts, 2, send_bytes=send_bytes)
    assert sorted((r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect()) == _lines_by_hand([t for _, t, *_ in ROWS], 2)
    assert linededup.dedup_lines(empty).collect() == []


def test_line_counts_are_reversible(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    old, new = docs.where("doc_id % 3 > 0"), docs.where("doc_id % 3 = 0")
    before, whole = linededup.reference_counts(old), linededup.reference_counts(docs)
    rows = lambda df: sorted((bytes(r["digest"]), r["n"]) for r in df.collect())
    added = linededup.insert(before, new)
    assert rows(added) == rows(whole)
    assert rows(linededup.delete(added, new)) == rows(before)
    shards = 64
    held = linededup.filters(before, 2, shards)
    grown = linededup.filters(whole, 2, shards)
    assert held.count() > 1
    shrunk = linededup.update_filters(grown, whole, before, shards, 2)
    state = {r["shard"]: bytes(r["filter"]) for r in shrunk.collect()}
    frequent = [bytes(r["digest"]) for r in before.where("n >= 2").collect()]
    gone = [bytes(r["digest"]) for r in whole.where("n >= 2").join(before.where("n >= 2"), "digest", "left_anti").collect()]
    probe = linededup.Probe(shards, state, b"".join(frequent)).ready()
    assert all(probe.frequent(frequent)) and not any(probe.frequent(gone))


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    low, high = rng.integers(0, 2**63, (2, 3000)).astype(np.uint64)
    f = linededup.CuckooFilter.holding(low, high)
    assert f.maybe(low, high).all()
    other = rng.integers(0, 2**63, (2, 20000)).astype(np.uint64)
    assert f.maybe(*other).mean() < 0.002
    for a, b in zip(low[:1500], high[:1500]):
        assert f.delete(int(a), int(b))
    g = linededup.CuckooFilter.from_bytes(f.to_bytes())
    assert g.maybe(low[1500:], high[1500:]).all() and g.maybe(low[:1500], high[:1500]).mean() < 0.01


def _print_by_hand(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(prints, budget):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= budget) + i + 1:
            u, v = find(i), find(int(j))
            parent[max(u, v)] = min(u, v)
    return [find(i) for i in range(len(a))]


def test_simhash_all_documents(spark, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    prints = [_print_by_hand(t) for _, t in docs]
    want = {docs[i][0]: (prints[i], docs[g][0]) for i, g in enumerate(_groups(prints, 4))}
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.QUERIES["op8_simhash"](spark, sf).collect()}
    assert got == want


def test_simhash_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    assert {r["component"] for r in got if r["bits"] == 0} == {1}
    texts = {i: t for i, t, *_ in ROWS}
    assert all(r["bits"] % 2**64 == _print_by_hand(texts[r["doc_id"]]) for r in got)
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("node_size", [16, 65536])
def test_trie_join_loses_no_link(spark, monkeypatch, node_size):
    """Chains, dense balls and random values, over cut nodes of unequal depth."""
    monkeypatch.setattr(simhash, "NODE_SIZE", node_size)
    monkeypatch.setattr(simhash, "FRONTIER", 500)
    rng = random.Random(3)
    values = {0, 2**64 - 1, *(rng.getrandbits(64) for _ in range(1500))}
    centre = rng.getrandbits(64)
    for _ in range(600):  # a ball, and a chain of steps of four bits
        values.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    for _ in range(200):
        step = sum(1 << b for b in rng.sample(range(64), 4))
        centre ^= step
        values.add(centre)
    values = sorted(values)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    links = simhash.links(spark.createDataFrame(signed, "bits long"), 4)
    name = {r["node"] % 2**64: r["component"] % 2**64 for r in components(links).collect()}
    got, want = {}, {}
    for v, g in zip(values, _groups(values, 4)):
        got.setdefault(name.get(v, v), set()).add(v)
        want.setdefault(values[g], set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 300)] + [(7, 7), (900, 901), (901, 902), (900, 902)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{i: 500 for i in range(500, 800)}, 900: 900, 901: 900, 902: 900}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_fingerprints_all_documents(spark, sf):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_fingerprints"](spark, sf).collect()}
    by_print = {}
    for n, (i, t) in enumerate(docs):
        following = docs[(n + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["edited_fingerprint"] == spanprints.fingerprint(spanprints.PrefixHashes(edited))
        assert by_print.setdefault(r["fingerprint"], t) == t
        for value, other in ((r["near_edited"], edited), (r["near_next"], following)):
            assert value == pytest.approx(_likeness(t, other))
    assert len(by_print) == len({t for _, t in docs})


def _likeness(a, b):
    """Common spans one character at a time, over differences of bounded length, then the common end."""
    same = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    matched = i = j = 0
    while i < len(a) and j < len(b):
        k = same(a[i:], b[j:])
        matched, i, j = matched + k, i + k, j + k
        if i == len(a) or j == len(b):
            break
        size = spanprints.ANCHOR
        steps = [(p + q, p, q) for p in range(spanprints.APART + 1) for q in range(spanprints.APART + 1) if a[i + p : i + p + size] == b[j + q : j + q + size] and i + p + size <= len(a) and j + q + size <= len(b)] if _shares(a[i : i + 300], b[j : j + 300], size) else []
        if not steps:
            matched += min(same(a[::-1], b[::-1]), len(a) - i, len(b) - j)
            break
        i, j = i + min(steps)[1], j + min(steps)[2]
    return matched / max(len(a), len(b)) if a or b else 1.0


def _shares(a, b, size):
    return bool({a[k : k + size] for k in range(len(a) - size + 1)} & {b[k : k + size] for k in range(len(b) - size + 1)})


def test_likeness_of_scattered_edits():
    """A thousand words, two of them different, one near each end; insertions and deletions; a moved block."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(1000)]
    edited = list(words)
    edited[9], edited[985] = "another", "x"
    p = spanprints.PrefixHashes
    assert spanprints.likeness(p(" ".join(words)), p(" ".join(edited))) > 0.99
    fewer = [w for k, w in enumerate(words) if k % 60]
    more = [v for k, w in enumerate(words) for v in ([w, "more words here"] if k % 90 == 7 else [w])]
    for other in (fewer, more):
        value = spanprints.likeness(p(" ".join(words)), p(" ".join(other)))
        assert 0.9 < value <= 1 and value == pytest.approx(_likeness(" ".join(words), " ".join(other)))
    half = words[500:] + words[:500]
    assert spanprints.likeness(p(" ".join(words)), p(" ".join(half))) < 0.1  # spans count in order only
    other = ["".join(rng.choice("mnopqrst") for _ in range(5)) for _ in range(1000)]
    assert spanprints.likeness(p(" ".join(words)), p(" ".join(other))) < 0.01


def test_fingerprints_odd_rows(odd, empty):
    rows = spanprints.document_fingerprints(odd.where(F.col("doc_id").isNotNull())).collect()
    ordered = sorted((i, t or "") for i, t, *_ in ROWS if i is not None)
    want = []
    for n, (i, t) in enumerate(ordered):
        edited = t[: len(t) - len(t) // 2] + ordered[(n + 1) % len(ordered)][1][: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(want)
    assert spanprints.document_fingerprints(odd).count() == len(ROWS)
    one = spanprints.document_fingerprints(odd.where("doc_id = 5")).first()
    assert one["near_next"] == 1.0
    assert spanprints.document_fingerprints(empty).collect() == []


def test_span_equality_and_extensions():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(30))) for _ in range(2))
        x, y = spanprints.PrefixHashes(a), spanprints.PrefixHashes(b)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        n = rng.randint(0, min(len(a) - i, len(b) - j))
        assert spanprints.same_span(x, i, y, j, n) == (a[i : i + n] == b[j : j + n])
        assert spanprints.likeness(x, y) == pytest.approx(_likeness(a, b))
