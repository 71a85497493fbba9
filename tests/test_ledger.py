"""Results by key and content: what is scored again, and which files are read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmill.session import saved, scratch_path
from prefmill.sources import ledger as L

KEY, TEXT = ["k"], ["text"]


def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "k int, text string")


def scored(rows):
    return rows.withColumn("size", F.length("text"))


def run(spark, texts, path, **options):
    """Keys that this run scored."""
    number = L.score_changed(docs(spark, texts), path, KEY, TEXT, scored, **options)
    return [] if number is None else sorted(r["k"] for r in L.results(spark, path).filter(F.col("score_run") == number).collect())


def test_changed_texts_are_scored_again_and_others_never(spark):
    path = scratch_path(spark, "ledger")
    first = {k: f"text {k}" for k in range(50)} | {50: None, 51: ""}
    assert run(spark, first, path, buckets=8) == sorted(first)
    assert run(spark, first, path, buckets=8) == []
    second = first | {3: "changed", 50: "", 51: None, 99: "new"}
    assert run(spark, second, path, buckets=8) == [3, 50, 51, 99]
    assert run(spark, first, path, buckets=8) == []  # changed back: the earlier results are there
    now = L.results_for(docs(spark, second), path, KEY, TEXT, buckets=8)
    assert now.columns == ["k", "text", "size"]
    assert {r["k"]: (r["text"], r["size"]) for r in now.collect()} == {k: (t, None if t is None else len(t)) for k, t in second.items()}


def test_only_files_that_may_hold_a_row_are_read(spark):
    path = scratch_path(spark, "ledger")
    run(spark, {k: f"a {k}" for k in range(400)}, path, buckets=16)
    run(spark, {k: f"b {k}" for k in range(400)}, path, buckets=16)
    some = docs(spark, {5: "b 5", 6: "new"})
    todo = L.unscored_content(some, path, KEY, TEXT, buckets=16)
    assert [r["k"] for r in todo.collect()] == [6]
    buckets = {r["k"]: r["score_bucket"] for r in L._marked(some, KEY, TEXT, 16).collect()}
    read = {f.split("rows/")[1].rsplit("/", 1)[0] for f in todo.inputFiles() if "/rows/" in f}
    assert f"score_run=2/score_bucket={buckets[5]}" in read and len(read) <= 3
    new = L.unscored_content(docs(spark, {k: f"c {k}" for k in range(1000, 1010)}), path, KEY, TEXT, buckets=16)
    assert len([f for f in new.inputFiles() if "/rows/" in f]) <= 4 and new.count() == 10


def test_a_run_without_filters_is_read_whole(spark):
    path = scratch_path(spark, "ledger")
    texts = {k: f"t {k}" for k in range(20)}
    todo = L.unscored_content(docs(spark, texts), path, KEY, TEXT, 4)
    scored(todo).write.partitionBy("score_bucket").parquet(f"{path}/rows/score_run=1")
    assert run(spark, texts | {3: "x"}, path, buckets=4) == [3]


def test_filters_miss_nothing_and_are_rarely_wrong(spark):
    rows = spark.range(20_000).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("t"), "id").alias("text"))
    marked = L._marked(rows, KEY, TEXT, 4).select("k", "score_bucket", *L._hashes(KEY))
    held = marked.filter("k < 10000")
    words = 1 << (L.BITS * 10_000 // 4 // 64).bit_length()
    filters = saved(L.bloom_words(held.select("score_bucket", "h1", "h2"), words).withColumn("score_run", F.lit(7)), "filters")
    hits = [r["k"] for r in L.perhaps(marked, filters).collect()]
    assert set(range(10_000)) <= set(hits) and len(hits) < 10_400
    before, L.FILTER_BYTES = L.FILTER_BYTES, 8 * words
    try:
        assert sorted(r["k"] for r in L.perhaps(marked, filters).collect()) == sorted(hits)
    finally:
        L.FILTER_BYTES = before
    assert np.all(np.diff(sorted(hits)) > 0)


def test_null_keys_and_clashing_names_are_refused(spark):
    path = scratch_path(spark, "ledger")
    with pytest.raises(Exception, match="null in its key"):
        L.score_changed(docs(spark, {1: "a"}).withColumn("k", F.lit(None).cast("int")), path, KEY, TEXT, scored)
    with pytest.raises(ValueError, match="own"):
        L.unscored_content(docs(spark, {1: "a"}).withColumn("content_hash", F.lit("x")), path, KEY, TEXT)
