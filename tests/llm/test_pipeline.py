"""The pipeline's stages, each against brute force on its own input."""

import collections

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from diurnal.llm import sentencepieces
from diurnal.llm.common import write_once

from .test_dedup import _groups, _lines_by_hand, _print_by_hand


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = write_once(stage(spark, docs, sf), f"test-{name}")
    return out


def test_all_but_the_last_return_the_columns_of_documents(stages):
    schema = [(f.name, f.dataType) for f in stages["documents"].schema]
    for name in ("toxicity", "line_dedup", "near_dedup", "mixing"):
        assert [(f.name, f.dataType) for f in stages[name].schema] == schema


def test_toxic_documents_go_and_clean_ones_stay(spark, sf, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages["toxicity"].select("doc_id").collect()}
    there = {r["doc_id"] for r in stages["documents"].select("doc_id").collect()} & set(labels)
    clean, toxic = {i for i in there if not labels[i]}, {i for i in there if labels[i]}
    assert len(clean & kept) > 0.98 * len(clean) and len(toxic & kept) < 0.5 * len(toxic)


def test_lines_are_dropped_by_the_stage_s_own_counts(stages):
    before = [r["text"] for r in stages["toxicity"].collect()]
    rows = stages["line_dedup"].collect()
    assert sorted(r["text"] for r in rows) == sorted(x[2] for x in _lines_by_hand(before, 10))
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_one_of_each_group_stays(stages):
    rows = sorted((r["doc_id"], r["text"]) for r in stages["line_dedup"].select("doc_id", "text").collect())
    groups = _groups([_print_by_hand(t) for _, t in rows], 4)
    want = [i for n, (i, t) in enumerate(rows) if groups[n] == n]
    assert sorted(r["doc_id"] for r in stages["near_dedup"].select("doc_id").collect()) == want


def test_near_dedup_of_repeated_and_nameless_rows(spark, sf):
    words = "one two three four five six seven eight nine ten"
    rows = [(7, words), (7, words), (7, "quite another text than the others are here"), (9, words.upper()), (None, "a row that has no id but has words"), (None, "a row that has no id but has words"), (4, ""), (5, None), (3, " \n")]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(7, words), rows[2], rows[4], (3, " \n")], key=str)


def test_mix_takes_documents_at_most_twice(stages):
    times = collections.Counter(r["doc_id"] for r in stages["mixing"].select("doc_id").collect())
    assert max(times.values()) <= 2
    assert set(times) <= {r["doc_id"] for r in stages["near_dedup"].select("doc_id").collect()}


def test_tokens_are_those_of_the_library(stages):
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    texts = {r["doc_id"]: r["text"] for r in stages["mixing"].select("doc_id", "text").collect()}
    rows = stages["sentencepiece"].collect()
    assert len(rows) == stages["mixing"].count()
    for r in rows:
        assert r["ids"] == sp.encode(texts[r["doc_id"]] or "") and r["n_tokens"] == len(r["ids"])


def test_stages_on_odd_rows(spark, sf, odd):
    docs = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        docs = write_once(stage(spark, docs, sf), "odd-stage")
        assert docs.count() > 0
    docs = odd.limit(0).select("doc_id", "text", "lang", "source", F.lit(0).cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        docs = write_once(stage(spark, docs, sf), "no-stage")
        assert docs.count() == 0


def test_stages_carry_columns_whose_names_clash(spark, sf, odd):
    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    columns, extra = docs.columns, {r["key"] for r in odd.select("key").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf), "clash-stage")
        assert docs.columns == columns and docs.count() > 0, name
        assert {r["key"] for r in docs.select("key").collect()} == extra
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
