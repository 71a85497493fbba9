"""States of sketches and counts: increments equal one full run, old shards are not read, errors stay in bounds."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmill.operators import lengths, sketches
from prefmill.operators.pairs import dataset_card
from prefmill.operators.quantiles import exact_quantiles
from prefmill.operators.series import series_index
from prefmill.session import saved, scratch_path

PROBS = {"low": 0.01, "mid": 0.5, "high": 0.999}


def numbers(spark, n=200_000):
    rows = spark.range(n).selectExpr("cast(id % 8 as int) AS shard", "if(id % 3 = 0, null, 'g' || id % 3) AS g", "pow(rand(7), 3) * 1000 AS v")
    return saved(rows, "numbers")


def test_quantiles_by_increments(spark):
    rows, path = numbers(spark), scratch_path(spark, "kll")
    for some in (rows.filter("shard < 3"), rows.filter("shard < 6"), rows, rows):
        sketches.extend_quantiles(spark, some, path, "shard", ["g"], "v")
    state = spark.read.parquet(path)
    assert state.count() == 24 and state.agg(F.sum("n")).first()[0] == 200_000
    ours = {r["g"]: tuple(r)[1:] for r in sketches.exact_from_state(rows, state, ["g"], "v", PROBS).collect()}
    full = {r["g"]: tuple(r)[1:] for r in exact_quantiles(rows, ["g"], "v", PROBS).collect()}
    assert ours == full and set(ours) == {None, "g1", "g2"}
    for r in sketches.quantiles_from_state(state, ["g"], PROBS).collect():
        values = np.sort([x["v"] for x in rows.filter(F.col("g").eqNullSafe(F.lit(r["g"]))).select("v").collect()])
        assert (r["n_rows"], r["min"], r["max"]) == (len(values), values[0], values[-1])
        for name, p in PROBS.items():
            assert abs(np.searchsorted(values, r[name]) / len(values) - p) <= sketches.rank_error()



def test_card_by_increments(spark):
    rows = spark.range(60_000).selectExpr(
        "id % 6 AS shard", "'d' || id % 7 AS domain", "if(id % 11 = 0, null, 't' || id % 30000) AS task", "'c' || id AS code_form"
    )
    path = scratch_path(spark, "card")
    for some in (rows.filter("shard = 1"), rows.filter("shard < 4"), rows):
        sketches.extend_card(spark, some, path, "shard")
    about, exact = sketches.card_from_state(spark.read.parquet(path)).first(), dataset_card(rows).first()
    assert about["n_rows"] == exact["n_rows"] == 60_000 and about["n_domains"] == exact["n_domains"] == 7
    for name in ("n_tasks", "n_code_forms"):
        assert abs(about[name] - exact[name]) <= sketches.distinct_error() * exact[name]
    assert sketches.card_from_state(spark.read.parquet(path).limit(0)).first()["n_rows"] == 0


def test_known_shards_are_not_opened(spark):
    place, path = scratch_path(spark, "shards"), scratch_path(spark, "card")
    rows = spark.range(100).selectExpr("id % 4 AS shard", "'d' AS domain", "'t' AS task", "'c' AS code_form")
    rows.filter("shard < 3").write.partitionBy("shard").parquet(place)
    sketches.extend_card(spark, spark.read.parquet(place), path, "shard")
    rows.filter("shard = 3").write.mode("append").partitionBy("shard").parquet(place)
    new = sketches.new_shards(spark, spark.read.parquet(place), path, "shard")
    for file in Path(place.removeprefix("file:")).glob("shard=[012]/*.parquet"):
        file.write_bytes(b"not parquet")
    assert {r["shard"] for r in new.collect()} == {3}


def test_more_shards_than_are_listed(spark, monkeypatch):
    monkeypatch.setattr(sketches, "LISTED", 2)
    rows, path = numbers(spark, 1000), scratch_path(spark, "kll")
    for some in (rows.filter("shard < 5"), rows):
        sketches.extend_quantiles(spark, some, path, "shard", [], "v")
    assert spark.read.parquet(path).agg(F.sum("n"), F.count("*")).first()[:] == (1000, 8)


def test_a_row_without_a_shard_is_refused(spark):
    with pytest.raises(Exception, match="no shard"):
        sketches.extend_quantiles(spark, spark.sql("SELECT null AS shard, 1D AS v"), scratch_path(spark, "kll"), "shard", [], "v")


def test_lengths_by_increments_equal_one_run(spark):
    rows = spark.range(500).selectExpr("'s' || id % 5 AS shard", "cast(id % 37 as int) AS prompt", "if(id % 9 = 0, null, cast(id as int)) AS chosen")
    path = scratch_path(spark, "lengths")
    for some in (rows.filter("shard = 's1'"), rows.filter("shard < 's3'"), rows):
        sketches.extend_lengths(spark, some, path, "shard", ("prompt", "chosen"))
    by_state = lengths.length_stats(sketches.counts_from_state(spark.read.parquet(path)))
    at_once = lengths.length_stats(lengths.length_counts(rows.drop("shard"), ("prompt", "chosen")))
    assert sorted(map(tuple, by_state.collect())) == sorted(map(tuple, at_once.collect()))


def test_places_in_one_long_series(spark):
    points = spark.range(20_000).selectExpr(
        "if(id % 10 = 0, null, 'long') AS run", "if(id % 10 = 0, 't' || id % 3, 't') AS tag", "id * 7919 % 5000 AS step", "'f' || id % 2 AS event_file", "id / 2D AS value"
    )
    found = series_index(points)
    assert found.columns == [*points.columns, "series_index"]
    rows = found.collect()
    series = {}
    for r in rows:
        series.setdefault((r["run"], r["tag"]), []).append(r)
    assert len(rows) == 20_000 and len(series) == 4
    for own in series.values():
        own.sort(key=lambda r: r["series_index"])
        assert [r["series_index"] for r in own] == list(range(1, len(own) + 1))
        order = [(r["step"], r["event_file"]) for r in own]
        assert order == sorted(order)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert plan.count("Window [") == 1 and "Aggregate" in window.split("Relation")[0]
    assert series_index(points.limit(0)).count() == 0
