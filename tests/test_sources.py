import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmill import schemas
from prefmill.operators import selection as S
from prefmill.operators import series as R
from prefmill.operators.lengths import length_counts, length_stats
from prefmill.operators.taxonomy import combination_by_index, combinations
from prefmill.session import clear_scratch, exists, saved, scratch_path, shared_dir
from prefmill.sources import readers as I
from prefmill.sources import writers as O
from prefmill.sources.arrow_files import as_uri, read_arrow, write_arrow

TAXONOMY = {
    "beta": {"libraries": ["l2", "l1"], "tasks": [{"name": "t1", "code_forms": ["a", "b"]}, {"name": "t0"}]},
    "alpha": {"tasks": [{"code_forms": ["c"]}]},
    "empty": {"libraries": ["x"]},
}


@pytest.mark.parametrize("kind", ["json", "yaml"])
def test_taxonomy_files(spark, tmp_path, kind):
    path = tmp_path / f"taxonomy.{kind}"
    if kind == "yaml":
        yaml = pytest.importorskip("yaml")
        path.write_text(yaml.safe_dump(TAXONOMY, sort_keys=False))
    else:
        path.write_text(json.dumps(TAXONOMY))
    combos = combinations(I.read_taxonomy(spark, str(path)))
    rows = [tuple(r) for r in combos.orderBy("domain_pos", "task_pos").select("domain", "task", "libraries", "code_form").collect()]
    expected = [("beta", "t1", ["l2", "l1"], ["a", "b"]), ("beta", "t0", ["l2", "l1"], []), ("alpha", "", [], ["c"])]
    assert rows == expected
    assert combination_by_index(combos, 2).first().domain == "alpha"
    assert combination_by_index(combos, 3).count() == combination_by_index(combos, -1).count() == 0


def test_splits(spark):
    path = scratch_path(spark, "splits")
    df = spark.range(100).withColumn("split", F.when(F.col("id") < 70, "train").otherwise("test"))
    O.write_pairs(df, path, ["split"])
    assert I.read_split(spark, path).count() == 70
    assert I.read_split(spark, f"{path}:test").count() == 30
    assert I.read_split(spark, path, "test").count() == 30
    assert I.eval_split_pick(I.read_pairs(spark, path)).count() == 30
    with pytest.raises(ValueError, match="no split 'dev'"):
        I.read_split(spark, f"{path}:dev")
    plain = scratch_path(spark, "plain")
    O.write_pairs(df.drop("split"), plain)
    assert I.read_split(spark, plain).count() == 100
    with pytest.raises(ValueError, match="has no splits"):
        I.read_split(spark, plain, "train")


def test_other_splits_are_read_whole(spark):
    path = scratch_path(spark, "splits")
    O.write_pairs(spark.range(10).withColumn("split", F.lit("dev")), path, ["split"])
    assert I.read_split(spark, path).count() == 10


def test_shards_in_number_order_with_a_broken_file(spark, tmp_path):
    for n in (10, 2, 1):
        spark.range(n).withColumn("id", F.col("id") + n * 100).coalesce(1).write.parquet(str(tmp_path / f"gen_data_{n}" / "dataset"))
    spark.range(3).selectExpr("id", "'x' AS more").coalesce(1).write.parquet(str(tmp_path / "gen_data_3" / "dataset"))
    broken = tmp_path / "gen_data_4" / "dataset"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"not a parquet file")
    spark.range(5).write.parquet(str(tmp_path / "other" / "dataset"))
    with pytest.raises(Exception, match="part-0.parquet|not a Parquet file"):
        I.fuse_shards(spark, str(tmp_path)).count()
    fused = I.fuse_shards(spark, str(tmp_path), skip_unreadable=True)
    numbers = [r.shard_no for r in I.shard_sort(fused, "id").collect()]
    assert numbers == [1] + [2] * 2 + [3] * 3 + [10] * 10
    assert fused.filter("more = 'x'").count() == 3
    unread = I.unread_shards(spark, str(tmp_path)).collect()
    assert [r.shard_no for r in unread] == [4]
    declared = T.StructType([T.StructField("id", T.LongType())])
    assert I.fuse_shards(spark, str(tmp_path), schema=declared, skip_unreadable=True).columns == ["id", "shard_no"]


def test_damaged_pages_are_no_silent_loss(spark, tmp_path):
    """The footer is whole, the data is not: the job fails, or the whole shard is left out and named."""
    for n in (1, 2):
        spark.range(5000).selectExpr("id", "md5(CAST(id AS STRING)) AS t").repartition(2).write.parquet(str(tmp_path / f"gen_data_{n}" / "dataset"))
    victim = sorted((tmp_path / "gen_data_2" / "dataset").glob("*.parquet"))[0]
    content = bytearray(victim.read_bytes())
    content[200 : len(content) // 2] = bytes(len(content) // 2 - 200)
    victim.write_bytes(bytes(content))
    with pytest.raises(Exception):
        I.fuse_shards(spark, str(tmp_path)).agg(F.max("t")).collect()
    whole = I.fuse_shards(spark, str(tmp_path), skip_unreadable=True)
    assert whole.groupBy("shard_no").count().collect() == [(1, 5000)]
    report = I.unread_shards(spark, str(tmp_path)).collect()
    assert [(r.shard_no, r.file.rsplit("/", 1)[1]) for r in report] == [(2, victim.name)] and report[0].error


def test_arrow_shards(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id", "CONCAT('gen_data_', id % 3, '/dataset') AS shard")
    schema = T.StructType([T.StructField("id", T.LongType())])
    write_arrow(rows, str(tmp_path / "with blank"), "shard")
    base = str(tmp_path / "with blank")
    fused = I.fuse_shards(spark, base, kind="arrow", schema=schema)
    assert sorted(map(tuple, fused.collect())) == [(i, i % 3) for i in range(3000)]
    victim = next((tmp_path / "with blank" / "gen_data_1" / "dataset").glob("data-*.arrow"))
    victim.write_bytes(victim.read_bytes()[:-600])
    with pytest.raises(Exception):
        I.fuse_shards(spark, base, kind="arrow", schema=schema).collect()
    assert I.fuse_shards(spark, base, kind="arrow", schema=schema, skip_unreadable=True).count() == 2000
    assert [r.shard_no for r in I.unread_shards(spark, base, kind="arrow").collect()] == [1]


def test_names_of_stores():
    assert as_uri("s3a://bucket/a b.arrow") == "s3://bucket/a%20b.arrow" and as_uri("hdfs://host:1/a") == "hdfs://host:1/a"


def test_fuse_union_keeps_duplicates(spark):
    a = spark.createDataFrame([(1, "x")], "id int, t string")
    assert I.fuse_union([a, a.select("t", "id"), a]).count() == 3


def test_prompts_jsonl_is_utf8(spark, tmp_path):
    path = str(tmp_path / "prompts")
    O.write_prompts_jsonl(spark.createDataFrame([("é\n日",)], "prompt string").coalesce(1), path)
    (file,) = (tmp_path / "prompts").glob("part-*")
    assert file.read_text("utf-8").strip() == '{"prompt":"é\\n日"}'


def test_responses_round_trip(spark):
    df = spark.createDataFrame([("1", "a\nb", None), ("2", None, "e")], schemas.RESPONSE)
    path = scratch_path(spark, "responses")
    O.write_responses(df, path)
    assert sorted(map(tuple, I.read_responses(spark, path, schemas.RESPONSE).collect())) == sorted(map(tuple, df.collect()))


def test_length_summary_file(spark, tmp_path):
    counts = length_counts(spark.createDataFrame([(1, 2, 3), (3, 4, 5)], "prompt int, chosen int, rejected int"))
    O.write_length_stats(length_stats(counts), str(tmp_path / "s"), "data", "words")
    (file,) = (tmp_path / "s").glob("part-*.json")
    saved = json.loads(file.read_text())
    assert saved["dataset_info"] == {"path": "data", "size": 2, "tokenizer": "words"}
    assert saved["chosen"] == {
        "mean": 3.0, "median": 3.0, "min": 2.0, "max": 4.0, "std": 1.0, "q25": 2.5, "q75": 3.5, "q90": pytest.approx(3.8),
        "q95": pytest.approx(3.9), "q99": pytest.approx(3.98),
    }


def test_eval_summaries_of_models(spark, tmp_path):
    summary = spark.createDataFrame(
        [(None, "m1", 1.0), (None, "m2", None), ("default", "m1", 2.0)], "prompt_type string, metric string, value double"
    )
    O.write_eval_results(None, summary, str(tmp_path / "a"))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text('{"results": []}')
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.json").write_text("{broken")
    paths = {f"{tmp_path}/a/summary": ("A", "base"), f"{tmp_path}/b": ("B", "base"), f"{tmp_path}/c": ("C", "base")}
    rows = I.read_eval_results(spark, paths).collect()
    assert [(r.model, r.type, r.metrics, r.prompt_type_metrics) for r in rows] == [
        ("A", "base", {"m1": 1.0, "m2": None}, {"default": {"m1": 2.0}})
    ]


def test_summaries_of_many_models_are_one_scan(spark, tmp_path):
    """Folders, files in them, patterns and odd names, each with the model it was registered for."""
    for k, name in enumerate(("a+b c%20", "d", "d/inner", "k=1")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(f'{{"metrics": {{"m": {k}.0}}}}')
    paths = {f"{tmp_path}/{n}": (n, "base") for n in ("a+b c%20", "d", "k=1", "gone")}
    paths |= {f"file://{tmp_path}/d/x.json": ("file", "base"), f"{tmp_path}/[dk]*": ("both", "tuned")}
    read = I.read_eval_results(spark, paths)
    got = sorted((r.model, r.type, r.metrics["m"]) for r in read.collect())
    assert got == [("a+b c%20", "base", 0.0), ("both", "tuned", 1.0), ("both", "tuned", 3.0), ("d", "base", 1.0), ("file", "base", 1.0), ("k=1", "base", 3.0)]
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("json") == 1 and "Union" not in plan
    assert [tuple(r) for r in I.unread_results(spark, paths).collect()] == [(f"{tmp_path}/gone", "gone", "missing")]
    assert I.read_eval_results(spark, {}).count() == I.unread_results(spark, {}).count() == 0


def test_incremental_scoring_scores_each_row_once(spark):
    path = scratch_path(spark, "scores")
    rows = spark.range(10).selectExpr("id AS k", "CAST(id AS STRING) AS t")

    def score(df):
        return df.select("k", F.length("t").alias("n"))

    O.score_incremental(rows.filter("k < 4"), None, ["k"], score, path)
    O.score_incremental(rows, spark.read.parquet(path), ["k"], score, path)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == list(range(10))


@pytest.mark.parametrize("kind", ["parquet", "json", "csv"])
def test_scalar_logs(spark, kind):
    points = spark.createDataFrame([("r", "f", "train/loss", 1, 0.5), ("r", "f", "x", 2, 1.0)], schemas.SCALARS)
    path = scratch_path(spark, "logs")
    points.write.format(kind).option("header", "true").save(path)
    assert [tuple(r) for r in I.read_scalar_logs(spark, path, ["train/loss"], kind).collect()] == [("r", "f", "train/loss", 1, 0.5)]


def test_series(spark):
    rows = [("r1", "f2", "train/loss", 3, 0.1), ("r1", "f1", "train/loss", 3, 0.2), ("r1", "f1", "train/loss", 1, 0.3), ("r2", "f", "eval/loss", 1, 0.4),
            ("r2", "f", "other", 1, 0.5)]
    points = spark.createDataFrame(rows, schemas.SCALARS)
    got = [(r.run, r.step, r.event_file, r.title, r.split, r.label) for r in R.run_series(points).collect()]
    assert got == [
        ("r1", 1, "f1", "Loss", "Train", "loss"),
        ("r1", 3, "f1", "Loss", "Train", "loss"),
        ("r1", 3, "f2", "Loss", "Train", "loss"),
        ("r2", 1, "f", "Loss", "Eval", "loss"),
    ]
    registry = spark.createDataFrame([("r2", "Two"), ("r9", "Nine")], "run string, name string")
    assert [r.name for r in R.multi_run_series(points, registry).collect()] == ["Two"]
    missing = R.missing_tags(points, {"a": ["train/loss", "eval/loss"]}).collect()
    assert sorted(tuple(r) for r in missing) == [("r1", "f1", "eval/loss"), ("r1", "f2", "eval/loss"), ("r2", "f", "train/loss")]


def test_split_sides_are_disjoint_whole_and_stable(spark):
    df = spark.range(5000)
    split = S.train_test_split(df, ["id"], 0.2, seed=3)
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(counts.values()) == 5000
    assert 850 < counts["test"] < 1150
    again = S.train_test_split(df.repartition(3), ["id"], 0.2, seed=3)
    assert split.exceptAll(again).count() == 0
    assert S.train_test_split(df, ["id"], 0.0).filter("split = 'test'").count() == 0
    assert S.train_test_split(df, ["id"], 1.0).filter("split = 'train'").count() == 0


@pytest.mark.parametrize("n", [1, 7, 100, 999, 1000, 5000])
def test_samples_are_the_smallest_hashes(spark, n):
    df = spark.range(1000)
    sample = S.sample_n(df, n, ["id"], 4)
    order = sorted(range(1000), key=lambda i: hashlib.md5(f"4|{i}".encode()).hexdigest())
    assert sorted(r.id for r in sample.collect()) == sorted(order[:n])


def test_samples_among_equal_keys(spark):
    df = spark.range(900).selectExpr("id % 3 AS k", "id")
    for n in (1, 299, 300, 301, 899):
        sample = S.sample_n(df, n, ["k"], 4)
        assert sample.count() == n and sample.exceptAll(S.sample_n(df.repartition(5), n, ["k"], 4)).count() == 0


def test_first_rows(spark):
    rows = [(k % 7 if k % 5 else None, k) for k in range(200)] + [(3, 1000)] * 4
    df = spark.createDataFrame(rows, "a int, b int").repartition(6)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for n in (0, 1, 40, 41, 100, 203, 204, 500):
        assert sorted(map(str, map(tuple, S.first_n(df, n, ["a", "b"]).collect()))) == sorted(map(str, order[:n]))
    for place in (0, 39, 40, 120, 203):
        assert [tuple(r) for r in S.nth_row(df, place, ["a", "b"]).collect()] == [order[place]]
    assert S.nth_row(df, 204, ["a", "b"]).count() == S.nth_row(df, -1, ["a", "b"]).count() == 0
    part = S.first_n(df, 50, ["a"])
    assert part.count() == 50 and part.exceptAll(S.first_n(df.repartition(3), 50, ["a"])).count() == 0
    assert S.first_n(df.limit(0), 5, ["a"]).count() == 0


def test_no_number_means_all(spark):
    assert S.sample_n(spark.range(9), 0, ["id"]).count() == S.sample_n(spark.range(9), None, ["id"]).count() == 9


def test_shared_dir_is_the_one_of_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_shared_dir_of_a_cluster(spark, monkeypatch):
    class Cluster:
        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app"

            @staticmethod
            def getConf():
                return {"spark.checkpoint.dir": Cluster.named}

    for named, fine in (("hdfs:///shared", True), ("file:///mnt/shared", True), ("/tmp/x", False), ("file:/tmp/x", False), ("file:///var/tmp/x", False), ("/tmpfoo/x", True)):
        Cluster.named = named
        if fine:
            assert shared_dir(Cluster) == named
        else:
            with pytest.raises(ValueError, match="one machine"):
                shared_dir(Cluster)


def test_scratch_is_cleared(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    other = f"{shared_dir(spark)}/kept"
    spark.range(3).write.mode("overwrite").parquet(other)
    assert exists(spark, path)
    clear_scratch(spark)
    assert not exists(spark, path) and exists(spark, other)


def test_null_keys_are_refused(spark):
    pairs = spark.createDataFrame([(1, "a"), (None, "b")], "k int, t string")
    with pytest.raises(Exception, match="null in its key"):
        I.unscored_only(pairs, pairs.select("k").limit(0), ["k"]).collect()


def test_missing_logs_and_summaries(spark, tmp_path):
    here, gone = str(tmp_path / "run + 1 %"), str(tmp_path / "run 2")
    spark.range(4).selectExpr("'t' AS tag", "id AS step", "0.5D AS value").coalesce(1).write.json(here)
    points = I.read_scalar_logs(spark, [here, gone], kind="json").collect()
    assert {r.run for r in points} == {"run + 1 %"} and all(r.event_file.endswith(".json") for r in points) and len(points) == 4
    assert I.missing_paths(spark, [here, gone]) == [gone]
    assert I.read_scalar_logs(spark, gone).count() == 0
    for name, text in (("m/sum", '{"metrics":{"a":1.0}}'), ("sum", '{"metrics":{"a":2.0}}'), ("bad", "{")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    paths = {str(tmp_path / n): (n, "base") for n in ("m/sum", "sum", "bad", "none")}
    assert {r.model: r.metrics["a"] for r in I.read_eval_results(spark, paths).collect()} == {"m/sum": 1.0, "sum": 2.0}
    assert {(r.model, r.reason) for r in I.unread_results(spark, paths).collect()} == {("bad", "no metrics"), ("none", "missing")}


def test_arrow_stream_files(spark, tmp_path):
    """A dataset as other tools save it: one stream file per shard, one folder per split."""
    import pyarrow as pa

    message = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))
    schema = pa.schema([("task", pa.string()), ("prompt", message), ("chosen", message), ("extra", pa.int64())])
    for split, shards in (("train", 3), ("test", 1)):
        for shard in range(shards):
            file = tmp_path / split / f"data-{shard:05d}-of-{shards:05d}.arrow"
            file.parent.mkdir(exist_ok=True)
            rows = [
                {"task": f"{split}{shard}", "prompt": [{"role": "user", "content": str(i)}], "chosen": None, "extra": i}
                for i in range(2500)
            ]
            with pa.ipc.new_stream(str(file), schema) as out:
                for start in (0, 1000, 2000):
                    out.write_batch(pa.RecordBatch.from_pylist(rows[start : start + 1000], schema))
    (tmp_path / "train" / "state.json").write_text("{}")
    whole = I.read_pairs(spark, str(tmp_path), "arrow")
    assert whole.schema == schemas.PAIR
    assert whole.count() == 10_000
    test = read_arrow(spark, str(tmp_path), split="test")
    assert test.select("task").distinct().collect()[0].task == "test0"
    assert I.read_split(spark, str(tmp_path), kind="arrow").count() == 7500
    assert I.read_split(spark, f"{tmp_path}/test", kind="arrow").count() == 2500
    assert I.read_split(spark, f"{tmp_path}:test", kind="arrow").count() == 2500
    with pytest.raises(ValueError, match="no split 'dev'"):
        I.read_split(spark, f"{tmp_path}:dev", kind="arrow")
    row = test.orderBy(F.col("prompt")[0].content.cast("int").desc()).first()
    assert (row.prompt[0].content, row.chosen, row.domain) == ("2499", None, None)


def test_saved_tables_keep_rows_and_schema(spark):
    df = spark.createDataFrame([(1, [("u", "x")]), (2, None)], "k int, m array<struct<role string, content string>>")
    again = saved(df, "rows")
    assert again.dtypes == df.dtypes
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
