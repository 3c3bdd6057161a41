"""Bounds of the top-k join, huge components, and languages of short texts only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurnal.llm import knnjoin, langid

from .test_models import _best_by_hand


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def _planned(df, k=6):
    v = df.select(F.col("vec_id").alias("id"), knnjoin.integer_components(F.col("embedding")).alias("v"))
    own = v.where("id % 10 = 0").groupBy("v").agg(F.min("id").alias("query"))
    return knnjoin.plan(v.select("v").distinct(), own, k)


def test_vectors_in_clusters_go_to_few_groups(spark, monkeypatch):
    monkeypatch.setattr(knnjoin, "GROUP", 40)
    monkeypatch.setattr(knnjoin, "SLICE", 100)
    rng = np.random.default_rng(5)
    centres = np.eye(40)[:10]
    rows = [(i, [float(x) for x in centres[i // 10 % 10] + rng.normal(0, 0.02, 40)]) for i in range(4000)]
    df = _frame(spark, rows)
    made = _planned(df)
    assert len(made.members) >= 5 and made.share < 0.3
    # a group has slices for what it was sent, not for all vectors
    assert all(s == max(1, -(-n // 100)) for s, n in zip(made.slices, made.sent)) and max(made.slices) < 40
    got = knnjoin.top_k(df, df.where("vec_id % 2 = 0"), 5)
    ids, x = np.array([r[0] for r in rows]), np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    scores = x @ x.T
    np.fill_diagonal(scores, -(2**62))
    want = []
    for q in ids[::2]:
        best = np.lexsort((ids, -scores[q]))[:5]
        want += [(int(q), n + 1, int(ids[j]), int(scores[q, j])) for n, j in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_random_directions_are_all_needed_and_found(spark, sf):
    """No bound on distances tells directions at random in 64 dimensions apart: the share says so, and results are whole."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    made = _planned(df)
    assert 0 < made.share <= 1 and sum(made.sent) == round(made.share * made.vectors * len(made.members))


@pytest.mark.parametrize("huge", [1e8, 1e12, 1e300])
def test_huge_finite_components(spark, huge):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 5)]) for i in range(60)]
    rows += [(100, [huge, -1.0, 0.0, 0.0, 2.0]), (101, [-huge, 1.0, 0.0, 0.0, 0.0]), (102, [huge, huge, 0.0, 0.0, 0.0])]
    df = _frame(spark, rows)
    held = lambda v: max(-(2**63), min(2**63 - 1, v))
    ints = {i: [held(int(np.floor(256 * x))) for x in v] for i, v in rows}
    want = []
    for q in (i for i in ints if i % 2 == 0):
        found = sorted((-held(sum(a * b for a, b in zip(ints[q], v))), i) for i, v in ints.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    got = knnjoin.top_k(df, df.where("vec_id % 2 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_ordinary_rows_still_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 6)]) for i in range(90)] + [(95, [0.0] * 6)]
    df = _frame(spark, rows)
    assert sorted(map(tuple, knnjoin.top_k(df, df.where("vec_id % 2 = 0"), 5).collect())) == _best_by_hand(rows, 5)


def test_languages_of_short_texts_only(spark):
    en = "the cat sat on a mat and the dog ran to the house with that".split()
    fr = "le chat est sur la table et les chiens sont dans une maison".split()
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(rng.choice(w, 6)), lang) for k in range(60) for w, lang in ((en, "en"), (fr, "fr"))]
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert max(len(t) for _, t, _ in rows) < langid.WINDOW
    got = langid.identify(df, langid.fit(df)).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang_pred"] in ("en", "fr") and 0 < r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in got) > 0.9 * len(got)


def test_a_text_with_letters_is_never_undetermined_once_there_are_labels(spark):
    df = spark.createDataFrame([(1, None, "sv"), (2, "", "sv"), (3, "123", "da"), (4, "words here", None), (5, "...", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, langid.fit(df)).collect()}
    assert got[4] == ("sv", 1.0) and got[1] == got[3] == got[5] == ("und", 0.0)
    one = spark.createDataFrame([(1, "a", "xx"), (2, "b c", None)], df.schema)
    assert {r["lang_pred"] for r in langid.identify(one, langid.fit(one)).collect()} == {"xx"}
