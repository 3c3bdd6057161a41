"""Mixing, top-k, language and toxicity."""

import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from diurnal.llm import knnjoin, langid, mixing, queries, toxicity

from .conftest import ROWS


@pytest.mark.parametrize("name", ["op1_mix", "op3_top_k"])
def test_sql(spark, sf, name):
    assert difference(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) is None


def test_mix_meets_targets_and_its_rows_follow_the_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = mixing.plan(docs).collect()
    by_source = {}
    for r in plan:
        taken = r["size"] * len(r["draws"])
        assert taken <= 2 * r["size"] and len(set(r["draws"])) <= len(r["draws"])
        s = by_source.setdefault(r["source"], [0, r["target"], r["source_size"], 0])
        s[0] += taken
        s[3] = max(s[3], r["size"])
    for taken, target, size, largest in by_source.values():
        assert abs(taken - target) <= largest and target <= 2 * size
    assert sum(t for _, t, _, _ in by_source.values()) == pytest.approx(1.5 * sum(s for _, _, s, _ in by_source.values()))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == [*docs.columns, "mix_shard"]
    got = {r["doc_id"]: sorted(r["s"]) for r in mixed.groupBy("doc_id").agg(F.collect_list("mix_shard").alias("s")).collect()}
    assert got == {r["key"]: sorted(r["draws"]) for r in plan if r["draws"]}


def test_mix_odd_rows(spark, odd, empty):
    rows = mixing.plan(odd).collect()
    assert len(rows) == len(ROWS)
    assert sorted(r["size"] for r in rows) == sorted(len("".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in t or "").split(" ")) - "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in t or "").split(" ").count("") for _, t, *_ in ROWS)
    assert mixing.mix_documents(odd).columns == [*odd.columns, "mix_shard"]
    assert mixing.plan(empty).collect() == [] and mixing.mix_documents(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r["target"], r["draws"]) for r in mixing.plan(blank).collect()] == [(0.0, []), (0.0, [])]


def test_capped_targets_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 40)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # a stops at 20, the last one (weight 5 again) at 80; b and c share the rest 2 : 1
    total = 1.5 * 2050
    assert got["a"] == 20 and got[None] == 80
    assert (got["b"], got["c"]) == pytest.approx((min(2000, (total - 100) * 2 / 3), max((total - 100) / 3, total - 100 - 2000)))


def test_split_tree_is_exact_and_hypergeometric(spark):
    quotas = spark.createDataFrame([("a", 40), ("b", 8), (None, 16)], "source string, quota long")
    rows = mixing.split_tree(quotas, mixing.Mix(levels=3)).collect()
    by_source, by_shard = {}, {}
    for r in sorted(rows, key=lambda r: r["shard"]):
        assert r["first"] == by_source.get(r["source"], 0)
        by_source[r["source"]] = by_source.get(r["source"], 0) + r["n"]
        by_shard[r["shard"]] = by_shard.get(r["shard"], 0) + r["n"]
    assert by_source == {"a": 40, "b": 8, None: 16} and set(by_shard.values()) == {8}
    # the inverted distribution function against exact counts
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    lit = lambda x: F.lit(x).cast("long")
    drawn = u.select(mixing._hypergeometric(lit(12), lit(8), lit(10), F.col("u")).alias("k")).groupBy("k").count().collect()
    from math import comb

    for r in drawn:
        assert r["count"] / 4000 == pytest.approx(comb(12, r["k"]) * comb(8, 10 - r["k"]) / comb(20, 10), abs=0.001)


def test_mix_plan_has_no_python(spark, sf):
    text = mixing.mix_documents(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(w in text for w in ("Python", "Pandas", "Arrow"))


def _best_by_hand(rows, k):
    usable = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            usable.append((i, [int(np.floor(256 * np.float64(x))) for x in v]))
    out = []
    for q, a in {(i, tuple(v)) for i, v in usable if i % 2 == 0}:
        found = {(i, sum(x * y for x, y in zip(a, b))) for i, b in usable if i != q}
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(found, key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("group,piece", [(1024, 2048), (3, 5)])
def test_top_k_odd_rows(spark, monkeypatch, group, piece):
    monkeypatch.setattr(knnjoin, "GROUP", group)
    monkeypatch.setattr(knnjoin, "SLICE", piece)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 6)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # a common vector: ties by id
    rows += [(400, None), (401, [1.0, None] + [0.0] * 4), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (None, rows[1][1]), (404, []), (405, [0.0] * 6), (406, [2.0, 1.0]), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "id": F.lit("x"), "cell": F.lit(0)})
    got = knnjoin.top_k(df, df.where("vec_id % 2 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == _best_by_hand(rows, 5)
    assert knnjoin.top_k(df.limit(0), df.limit(0)).collect() == []
    few = df.where("vec_id in (2, 3, 400)")
    assert sorted(map(tuple, knnjoin.top_k(few, few.where("vec_id = 2")).collect())) == _best_by_hand([rows[2], rows[3]], 5)


def test_language_held_out_accuracy(spark, sf):
    got = queries.QUERIES["op2_language"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    rows = got.join(docs, "doc_id").where("held_out and lang is not null and n > 50").collect()
    assert len(rows) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(odd, empty):
    rows = langid.identify(odd, langid.fit(odd)).collect()
    assert len(rows) == len(ROWS)
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (1, 3, 8)} == {("und", 0.0)}
    assert langid.fit(empty) is None
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(empty, None).collect() == []


def test_network_gradients_and_positions():
    rng = np.random.default_rng(0)
    net = langid.Network.new(["a", "b", "c"], size=3, seed=1)
    for layer in (net.ahead, net.back):
        layer.inputs, layer.state = layer.inputs.astype(float), layer.state.astype(float)
    codes, truth = rng.integers(0, 256, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = net.gradients(codes, truth)
    for w, g in zip(net.weights(), grads):
        flat = np.flatnonzero(np.abs(g) > np.abs(g).max() * 0.5)[:3]
        for i in flat:
            at = np.unravel_index(i, g.shape)
            old, step, losses = w[at], 1e-2, []
            for s in (step, -step):
                w[at] = old + s
                losses.append(net.gradients(codes, truth)[0])
            w[at] = old
            assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(float(g[at]), rel=0.02, abs=1e-4)
    p, _ = net.positions(codes)
    assert p.shape == (7, 3, 5) and np.allclose(p.sum(1), 1)


def test_document_pooling_is_the_mean_over_all_positions():
    net = langid.Network.new(["a", "b"], size=4)
    texts = [b"", b"x", bytes(range(1, 200)) * 3, b"y" * langid.WINDOW, b"z" * (langid.WINDOW + 1)]
    got = net.documents(texts)
    for t, g in zip(texts, got):
        sums = np.zeros(2)
        for at in range(0, len(t), langid.WINDOW):
            sums += net.positions(np.frombuffer(t[at : at + langid.WINDOW], np.uint8)[:, None])[0].sum(0)[:, 0]
        assert np.allclose(g, sums / max(1, len(t)), atol=1e-5)


def test_toxicity_all_documents(spark, sf):
    rows = queries.QUERIES["op5_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [(r["predicted"], r["toxic"]) for r in rows if r["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.9
    clean = [p for p, y in held if y == 0]
    assert np.mean(clean) < 0.05
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (4, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.fit(odd, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd, none).collect()} == {0.5}
    assert toxicity.score(empty, none).collect() == []


def test_nearest_examples_equal_exhaustive_search():
    rng = np.random.default_rng(4)
    terms = {f"t{i}".encode(): i for i in range(40)}
    model = toxicity.Neighbours(np.arange(500), rng.integers(0, 2, 500).astype(float), terms, rng.uniform(1, 4, 40), k=7)
    counts = [{f"t{i}".encode(): int(rng.integers(1, 5)) for i in rng.choice(40, rng.integers(1, 6), False)} for _ in range(500)]
    vectors = [model.vector(c) for c in counts]
    vectors = model.build(vectors)
    dense = np.zeros((500, 40))
    for e, (at, w) in enumerate(vectors):
        dense[e, at] = w
    for q in range(0, 500, 9):
        near, cosines = model.nearest(*vectors[q])
        scores = np.round(dense @ dense[q], 12)
        want = sorted(np.flatnonzero(scores > 0), key=lambda e: (-scores[e], model.ids[e]))[:7]
        assert near.tolist() == want and np.allclose(cosines, scores[want])


def test_copy_of_an_example_finds_it_without_telling_words(spark):
    """No word tells these labels apart; each is indexed, dense or not, and each text is searched."""
    rng = np.random.default_rng(9)
    texts = [" ".join("w" + chr(97 + a) + chr(97 + b) for a, b in rng.integers(0, 26, (30, 2))) for _ in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(model.terms) == len({w for t in texts for w in t.split()})
    rows = toxicity.score(docs, model).collect()
    assert all(r["neighbours"][0] == r["doc_id"] and r["cosines"][0] > 0.999 and len(r["neighbours"]) == 15 for r in rows)


def test_scores_follow_the_true_share_above_the_sample_size(spark):
    """One label in ten is toxic, by chance: with samples of equal size, scores stay well below one half."""
    rng = np.random.default_rng(5)
    texts = [" ".join("w" + chr(97 + a) + chr(97 + b) for a, b in rng.integers(0, 8, (12, 2))) for _ in range(900)] + [""] * 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "doc_id long, toxic int")
    for examples in (60, 1500):
        rows = toxicity.score(docs, toxicity.fit(docs, labels, examples=examples)).collect()
        assert 0.04 < np.mean([r["score"] for r in rows if r["doc_id"] < 900]) < 0.25
        assert all(0.01 < r["score"] < 0.3 for r in rows if r["doc_id"] >= 900)
