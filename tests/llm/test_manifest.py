"""Merkle manifest and fill-in-the-middle."""

import hashlib
import random
import zlib

import pytest
from compare import connect, difference
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from diurnal.llm import infilling, merkle, queries

from .conftest import ROWS


@pytest.mark.parametrize("name", ["op11_manifest", "op12_infilling"])
def test_sql(spark, sf, name):
    assert difference(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) is None


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(nodes, fanout):
    """Levels of one tree, and the siblings (left, right) of each leaf."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = i - i % fanout
            path.append(("".join(level[run:i]), "".join(level[i + 1 : run + fanout])))
            i //= fanout
        paths.append(path)
    return levels[-1][0], paths


def _by_hand(rows, fanout):
    """Sorted (doc_id, leaf, subroot, root, proof, folded from the tampered leaf)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        made.append((own, *_tree([_leaf(r) for r in own], fanout)))
    root, above = _tree([m[1] for m in made], fanout)
    out = []
    for (own, subroot, paths), more in zip(made, above, strict=True):
        for r, path in zip(own, paths, strict=True):
            path = path + more
            t = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and t is not None:
                t = t.replace("\n", "")
            d = _leaf((*r[:4], t))
            for left, right in path:
                d = _h(left, d, right)
            out.append((r[0], _leaf(r), subroot, root, _h(*(a + b for a, b in path)), d))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest_odd_rows(spark, odd, fanout):
    docs = odd.withColumn("n_chars", F.length("text"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    m = merkle.build(merkle.leaves(docs, now=merkle.changed_leaf(text=tampered)), fanout)
    text = lambda c: F.lower(F.hex(c))
    got = m.proofs().select("key", text("leaf"), text("subroot"), F.lit(m.root.hex()), merkle.proof_digest(F.col("path")), text(merkle.fold(F.col("now"), F.col("path")))).collect()
    rows = [(i, s, lang, None if t is None else len(t), t) for i, t, lang, s in ROWS]
    assert sorted(map(tuple, got), key=str) == _by_hand(rows, fanout)


def test_manifest_of_many_ranges_and_groups(spark, monkeypatch):
    """A group with most rows over many ranges, many groups of one row, and no group at all."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", 20)
    rows = [(i, "hot" if i % 3 else f"g{i}", None, i % 7, f"text {i % 5}\n") for i in range(400)] + [(None, None, "en", 1, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    m = merkle.build(merkle.leaves(docs))
    assert m.by_group.levels[0].count() == sum(r[1] == "hot" for r in rows) + 2  # groups of one row have no level
    text = lambda c: F.lower(F.hex(c))
    got = m.proofs().select("key", text("leaf"), text("subroot"), F.lit(m.root.hex()), merkle.proof_digest(F.col("path"))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((r[:5] for r in _by_hand(rows, 3)), key=str)
    assert m.proofs().where(merkle.fold(F.col("leaf"), F.col("path")) != F.lit(m.root)).count() == 0


def test_manifest_finds_any_change(spark):
    """Each column counts, and so does where one value ends and the next begins."""
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    base = [(1, "a", "en", 3, "xyz"), (2, "a", "en", 3, "xyz")]
    changed = [(3, "a", "en", 3, "xyz"), (1, "b", "en", 3, "xyz"), (1, "a", None, 3, "xyz"), (1, "a", "en", 4, "xyz"), (1, "a", "en", 3, "xyz "), (1, "a", "en3", None, "xyz"), (1, "a", "-", 3, "xyz")]
    roots = {merkle.build(merkle.leaves(spark.createDataFrame([row, base[1]], schema))).root for row in [base[0], *changed]}
    assert len(roots) == 1 + len(changed)


def test_manifest_of_nothing_and_of_one(spark, empty):
    m = merkle.build(merkle.leaves(empty.withColumn("n_chars", F.length("text"))))
    assert m.root is None and m.proofs().count() == 0
    one = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    m = merkle.build(merkle.leaves(one))
    row = m.proofs().first()
    assert m.root.hex() == _h("1:1----") and bytes(row["leaf"]) == bytes(row["subroot"]) == m.root and row["path"] == []


def _infill_by_hand(i, text):
    lines = text.split("\n")
    units = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h4 % 100 < 50 else "psm", len(p), len(m), out


def test_infilling_odd_rows(spark, odd, empty):
    more = [(20 + k, t) for k, t in enumerate(["\n", "\n\n", "a<P>b\nc", "a <M>\n", "é\n漢字\n😀", "<P\n>S>\n<", "x\n" * 30_000, "<<S\n", "one"] * 4)]
    docs = odd.select("doc_id", "text", "key", "row").unionByName(spark.createDataFrame([(i, t, "k", "r") for i, t in more], "doc_id long, text string, key string, row string"))
    made = infilling.fill_in_middle(docs)
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made.collect()), key=str)
    rows = [(r[0], r[1] or "") for r in ROWS] + more
    assert got == sorted(((i, *_infill_by_hand(i, t)) for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = infilling.restore(made).collect()
    assert sorted(((r["doc_id"], r["restored"]) for r in back), key=str) == sorted(rows, key=str)
    assert infilling.restore(infilling.fill_in_middle(empty)).collect() == []


@given(st.binary(max_size=60), st.data())
def test_rotation(data, draws):
    a, b, c = sorted(draws.draw(st.tuples(*[st.integers(0, len(data))] * 3)))
    turned = bytearray(data)
    infilling.rotate(turned, a, b, c)
    assert turned == data[:a] + data[b:c] + data[a:b] + data[c:]


def test_rate_and_form_shares():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\n") for _ in range(40)) for _ in range(600)]
    forms = [infilling.transform(t.encode(), k, 7, 60, 25)[1] for k, t in enumerate(texts)]
    assert 0.33 < forms.count("plain") / 600 < 0.47 and 0.1 < forms.count("spm") / 600 < 0.2


def test_levels_join_small_and_sorted_ranges_hold_no_text(spark, sf):
    """Only digests move: no exchange above the scan of the texts reads a text column."""
    m = merkle.build(merkle.leaves(spark.read.parquet(f"{sf}/documents.parquet")))
    plan = m.proofs()._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan
