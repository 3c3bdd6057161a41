"""Corpus pipeline: toxicity, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but
the last return the columns of ``documents``, and others that a table has, whatever their names.

In every stage rows without id and rows repeated are rows like others unless it says more, null texts stay null
and count as empty, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diurnal.llm import linededup, mixing, sentencepieces, simhash, toxicity
from diurnal.llm.common import prepare, table, write_once


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows as the struct ``row`` with its text, so that whole rows can pass an operator by text."""
    return docs.select(F.struct(*_columns(docs)).alias("row"), F.col("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold.

    Rows without id cannot be examples, but are scored. Without labels of both kinds all rows share one score: that of the
    labels' share (0.5 without any label). Null and empty texts have the score of examples without words.
    """
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(_keyed(docs), model, key="row")
    return scored.where(F.col("predicted") == 0).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them have; emptied ones stay.

    A repeated row is another document with its lines. A null text stays null; ``n_chars`` is counted anew where there is a text.
    """
    prepare(spark)
    cleaned = linededup.dedup_lines(_keyed(docs), key="row")
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept")), "n_chars": F.when(F.col("row.text").isNotNull(), F.length("kept")).otherwise(F.col("row.n_chars"))}
    return cleaned.select(*[new.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Rows without id come first in that order; of rows with one id, the text's hash decides, and of a row
    repeated with id and text one stays. Texts without words are one group.
    Near is operator 8's rule, four words and 4 of 64 bits: of pairs with a similarity of 0.8 it finds about 3 %,
    of those with 0.95 about half.
    """
    prepare(spark)
    mark = F.xxhash64("text")
    keyed = docs.select(F.struct("doc_id", mark.alias("mark")).alias("key"), "text")
    grouped = simhash.near_duplicates(keyed, key="key")
    first = grouped.where(F.col("key") == F.col("component")).select("key.*").distinct()
    kept = write_once(first.select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark")), "kept")
    whole = docs.select(F.struct(*_columns(docs)).alias("row"), F.col("doc_id"), mark.alias("mark"))
    own = whole.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark")))
    return own.dropDuplicates(["doc_id", "mark"]).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard.

    Rows without source are a source of their own, the last. Texts without words have size 0 and come along with their
    block, as often as its other rows.
    """
    return mixing.mix_documents(docs).select(*_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and the digests of its round trip; none for a null or empty text."""
    prepare(spark)
    trips = sentencepieces.round_trip(docs)
    digests = ["doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]
    return trips.select(*digests)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can express neither the votes nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
