"""Filters that grow from nothing and are built anew when full; lines that meet their shard's filter."""

import pytest

from diurnal.llm import linededup
from diurnal.llm.common import write_once


def _docs(spark, lines, times):
    return spark.createDataFrame([(k, "\n".join(lines)) for k in range(times)], "doc_id long, text string")


def _held(filters, shards, keys):
    """Whether the filters may hold each key."""
    probe = linededup.Probe(shards, {r["shard"]: bytes(r["filter"]) for r in filters.collect()}, b"".join(keys)).ready()
    return probe.frequent(keys)


def test_filters_grow_from_nothing(spark):
    shards = 4
    nothing = spark.createDataFrame([], "digest binary, n long")
    filters = write_once(linededup.filters(nothing, 2, shards), "test-filters")
    assert filters.count() == 0
    counts, known = nothing, []
    for step, n in enumerate((3, 40, 900, 5000)):
        lines = [f"line {step} {k}" for k in range(n)]
        after = write_once(linededup.insert(counts, _docs(spark, lines, 2)), "test-counts")
        filters = write_once(linededup.update_filters(filters, counts, after, shards, 2), "test-filters")
        counts, known = after, known + [linededup.digest(x.encode()) for x in lines]
        assert all(_held(filters, shards, known))
    # what is deleted again is let through no longer, but for chance fingerprints
    gone = [f"line 3 {k}" for k in range(5000)]
    after = write_once(linededup.delete(counts, _docs(spark, gone, 1)), "test-counts")
    filters = write_once(linededup.update_filters(filters, counts, after, shards, 2), "test-filters")
    assert all(_held(filters, shards, known[:943])) and sum(_held(filters, shards, known[943:])) < 100


def test_one_row_per_shard_after_updates(spark):
    nothing = spark.createDataFrame([], "digest binary, n long")
    counts = write_once(linededup.insert(nothing, _docs(spark, [f"x{k}" for k in range(300)], 3)), "test-counts")
    filters = linededup.update_filters(linededup.filters(nothing, 2, 8), nothing, counts, 8, 2)
    shards = [r["shard"] for r in filters.collect()]
    assert sorted(shards) == list(range(8))


@pytest.mark.parametrize("part", [500_000, 50])
def test_a_hot_line_is_dealt_to_parts(spark, monkeypatch, part):
    """A line of nearly all documents, with the filters asked in their shards: the same lines go."""
    monkeypatch.setattr(linededup, "PART_LINES", part)
    docs = spark.createDataFrame([(k, f"Shared line\nown {k}\nrare {k // 3} \n" + ("x" if k % 7 else "shared LINE")) for k in range(600)], "doc_id long, text string").repartition(6)
    counts = write_once(linededup.reference_counts(docs), "test-counts")
    sent = linededup.drop_lines(docs, counts, 10)
    asked = linededup.drop_lines(docs, counts, 10, send_bytes=0)
    assert sorted(sent.collect()) == sorted(asked.collect())
    assert {r["n_dropped"] for r in asked.collect()} == {2}
