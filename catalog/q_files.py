"""Readers and writers: each query writes a table to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.inputs import table, view
from catalog.q_evaluation import scored as scored_predictions
from catalog.q_evaluation import summary_sql
from catalog.q_lengths import STATS, counts, sides_sql
from catalog.q_pairs import PAIRS, flat_pairs, results
from catalog.q_taxonomy import FLAT, combos, combos_sql, flat
from catalog.registry import query, rounded
from prefmill.functions.codetext import comment_density
from prefmill.operators.compare import summary_rows
from prefmill.operators.evaluation import eval_summary
from prefmill.operators.lengths import length_stats as length_stats_of
from prefmill.operators.pairs import build_pairs
from prefmill.operators.selection import train_test_split
from prefmill.operators.taxonomy import combinations, taxonomy_from_table
from prefmill.session import scratch_path
from prefmill.sources import event_files, ledger, readers, writers
from prefmill.sources.arrow_files import write_arrow
from prefmill.streaming import follow, pairs_from_responses


@query("read_taxonomy", combos_sql(f"SELECT {FLAT} FROM combos"), ("fx_code",))
def read_taxonomy(spark, sf_dir):
    rows = taxonomy_from_table(view(spark, sf_dir, "fx_code"), "domain", "task", "code_form", "library")
    entry = F.struct("domain", F.struct("libraries", "tasks"))
    path = scratch_path(spark, "taxonomy") + ".json"
    # A taxonomy has one row per domain, so its single JSON object stays small.
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.text(path)
    return flat(combinations(readers.read_taxonomy(spark, path)))


@query("read_pairs", PAIRS, ("fx_code",))
def read_pairs(spark, sf_dir):
    path = scratch_path(spark, "pairs")
    built = build_pairs(results(spark, sf_dir), ["result_id"])
    writers.write_pairs(built, path, kind="json")
    return flat_pairs(readers.read_pairs(spark, path, "json", built.schema), "result_id")


@query("write_pairs", PAIRS, ("fx_code",))
def write_pairs(spark, sf_dir):
    path = scratch_path(spark, "pairs")
    writers.write_pairs(build_pairs(results(spark, sf_dir), ["result_id"]), path, ["domain"])
    return flat_pairs(readers.read_pairs(spark, path), "result_id")


IN_TEST = "substr(md5('7|' || CAST(doc_id AS VARCHAR)), 1, 8) < '1999999a'"


def saved_splits(spark, sf_dir) -> str:
    path = scratch_path(spark, "splits")
    writers.write_pairs(train_test_split(table(spark, sf_dir, "documents"), ["doc_id"], 0.1, seed=7), path, ["split"])
    return path


@query("read_split", f"SELECT doc_id, text, 'test' AS split FROM documents WHERE {IN_TEST}")
def read_split(spark, sf_dir):
    return readers.read_split(spark, saved_splits(spark, sf_dir) + ":test").select("doc_id", "text", "split")


@query("read_split_default", f"SELECT doc_id, text, 'train' AS split FROM documents WHERE NOT {IN_TEST}")
def read_split_default(spark, sf_dir):
    return readers.read_split(spark, saved_splits(spark, sf_dir)).select("doc_id", "text", "split")


@query("eval_split_pick", f"SELECT doc_id, lang FROM documents WHERE {IN_TEST}")
def eval_split_pick(spark, sf_dir):
    return readers.eval_split_pick(readers.read_pairs(spark, saved_splits(spark, sf_dir))).select("doc_id", "lang")


def saved_shards(spark, sf_dir) -> str:
    """The documents of each source as one generated shard."""
    path = scratch_path(spark, "shards")
    shards = view(spark, sf_dir, "fx_shards").withColumn("part", F.concat(F.lit("gen_data_"), F.col("shard_no")))
    writers.write_pairs(shards.drop("shard_no"), path, ["part"])
    return path


SHARDS = "part=gen_data_[0-9]*"


@query("fuse_shards", "SELECT doc_id, text, source, shard_no FROM fx_shards", ("fx_shards",))
def fuse_shards(spark, sf_dir):
    path = saved_shards(spark, sf_dir)
    return readers.fuse_shards(spark, path, SHARDS, schema=SHARD_ROWS).select("doc_id", "text", "source", "shard_no")


SHARD_ROWS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())]
)


@query("fuse_shards_arrow", "SELECT doc_id, text, source, shard_no FROM fx_shards", ("fx_shards",))
def fuse_shards_arrow(spark, sf_dir):
    path = scratch_path(spark, "arrow-shards")
    shards = view(spark, sf_dir, "fx_shards").withColumn("part", F.concat(F.lit("part=gen_data_"), F.col("shard_no")))
    write_arrow(shards.drop("shard_no"), path, "part")
    return readers.fuse_shards(spark, path, SHARDS, kind="arrow", schema=SHARD_ROWS)


@query("shard_sort", "SELECT doc_id, shard_no FROM fx_shards ORDER BY shard_no, doc_id", ("fx_shards",))
def shard_sort(spark, sf_dir):
    fused = readers.fuse_shards(spark, saved_shards(spark, sf_dir), SHARDS, schema=SHARD_ROWS, skip_unreadable=True)
    return readers.shard_sort(fused, "doc_id").select("doc_id", "shard_no")


@query(
    "fuse_union",
    "SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM documents JOIN labels USING (doc_id)",
)
def fuse_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return readers.fuse_union([docs, labelled.select("text", "doc_id")])


@query(
    "write_responses",
    "SELECT result_id, domain, task, code_form, first_content, second_content FROM fx_responses",
    ("fx_responses",),
)
def write_responses(spark, sf_dir):
    path = scratch_path(spark, "responses")
    rows = view(spark, sf_dir, "fx_responses")
    writers.write_responses(rows, path)
    return readers.read_responses(spark, path, rows.schema)


@query("read_responses", PAIRS, ("fx_code",))
def read_responses(spark, sf_dir):
    from prefmill.operators.responses import parse_responses

    saved = write_responses(spark, sf_dir)
    return flat_pairs(build_pairs(parse_responses(saved), ["result_id"]), "result_id")


@query("write_prompts_jsonl", "SELECT conv_id, turn, prompt_text FROM fx_text_pairs", ("fx_text_pairs",))
def write_prompts_jsonl(spark, sf_dir):
    path = scratch_path(spark, "prompts")
    rows = view(spark, sf_dir, "fx_text_pairs").select("conv_id", "turn", "prompt_text")
    writers.write_prompts_jsonl(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query(
    "write_length_stats",
    sides_sql(
        f", stats AS ({STATS.strip()})\nSELECT 'documents' AS path, 'words' AS tokenizer, "
        "max(n_rows) AS size, max(mean) FILTER (WHERE side = 'prompt') AS prompt_mean, max(median) FILTER (WHERE side = 'chosen') AS chosen_median, "
        "max(q99) FILTER (WHERE side = 'rejected') AS rejected_q99 FROM stats"
    ),
    ("fx_sides",),
)
def write_length_stats(spark, sf_dir):
    path = scratch_path(spark, "length-stats")
    writers.write_length_stats(length_stats_of(counts(spark, sf_dir)), path, "documents", "words")
    stat = "struct<" + ",".join(f"{n}:double" for n in writers.STAT_NAMES) + ">"
    saved = spark.read.schema(
        f"dataset_info struct<path:string,size:bigint,tokenizer:string>, prompt {stat}, chosen {stat}, rejected {stat}"
    ).json(path)
    return saved.select(
        "dataset_info.*",
        F.round("prompt.mean", 6).alias("prompt_mean"),
        F.round("chosen.median", 6).alias("chosen_median"),
        F.round("rejected.q99", 6).alias("rejected_q99"),
    )


SUMMARY = (
    summary_sql("prompt_type, ", "GROUP BY prompt_type")
    + "\nUNION ALL "
    + summary_sql("CAST(NULL AS VARCHAR) AS prompt_type, ")
)


def saved_summary(spark, sf_dir) -> str:
    path = scratch_path(spark, "evaluation")
    rows = scored_predictions(spark, sf_dir)
    writers.write_eval_results(rows.drop("block_metrics"), eval_summary(rows), path)
    return path


@query("write_eval_results", SUMMARY, ("fx_row_means",))
def write_eval_results(spark, sf_dir):
    path = saved_summary(spark, sf_dir)
    again = eval_summary(spark.read.parquet(f"{path}/results"))
    return again.select("prompt_type", "metric", *rounded("value"))


@query(
    "read_eval_results",
    "SELECT 'a' AS model, 'base' AS type, * FROM (" + SUMMARY + ") s UNION ALL SELECT 'b', 'fine-tuned', * FROM (" + SUMMARY + ") s",
    ("fx_row_means",),
)
def read_eval_results(spark, sf_dir):
    paths = {f"{saved_summary(spark, sf_dir)}/summary": info for info in (("a", "base"), ("b", "fine-tuned"))}
    rows = summary_rows(readers.read_eval_results(spark, paths))
    return rows.select("model", "type", "prompt_type", "metric", *rounded("value"))


@query(
    "read_eval_results_missing",
    "SELECT 'a b' AS model, 'base' AS type, * FROM (" + SUMMARY + ") s",
    ("fx_row_means",),
)
def read_eval_results_missing(spark, sf_dir):
    """One summary under a name with a blank, one that is not there."""
    path = scratch_path(spark, "one model")
    rows = scored_predictions(spark, sf_dir)
    writers.write_eval_results(None, eval_summary(rows), path)
    paths = {f"{path}/summary": ("a b", "base"), f"{path}/other summary": ("c", "fine-tuned")}
    read = summary_rows(readers.read_eval_results(spark, paths))
    return read.select("model", "type", "prompt_type", "metric", *rounded("value"))


@query(
    "read_scalar_logs_folders",
    "SELECT 'run ' || substr(run, 4) AS run, tag, count(*) AS n, round(sum(value), 4) AS total FROM fx_scalars WHERE tag IN ('train/loss', 'eval/loss') GROUP BY ALL",
    ("fx_scalars",),
)
def read_scalar_logs_folders(spark, sf_dir):
    """Logs that do not name their run lie in a folder of its name; one run has none."""
    path = scratch_path(spark, "all runs")
    points = view(spark, sf_dir, "fx_scalars")
    for k in range(3):
        points.filter(F.col("run") == f"run{k}").select("tag", "step", "value").write.parquet(f"{path}/run {k}")
    folders = [f"{path}/run {k}" for k in range(4)]
    read = readers.read_scalar_logs(spark, folders, ["train/loss", "eval/loss"])
    return read.groupBy("run", "tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "read_scalar_logs",
    "SELECT run, event_file, tag, step, value FROM fx_scalars WHERE tag IN ('train/loss', 'eval/loss')",
    ("fx_scalars",),
)
def read_scalar_logs(spark, sf_dir):
    path = scratch_path(spark, "scalars")
    view(spark, sf_dir, "fx_scalars").write.parquet(path)
    return readers.read_scalar_logs(spark, path, ["train/loss", "eval/loss"])


@query(
    "read_event_files",
    """
SELECT run, tag, step, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM fx_scalars WHERE tag IN ('train/loss', 'eval/loss')""",
    ("fx_scalars",),
)
def read_event_files(spark, sf_dir):
    path = scratch_path(spark, "events")
    event_files.write_event_files(view(spark, sf_dir, "fx_scalars"), path)
    return readers.read_scalar_logs(spark, path, ["train/loss", "eval/loss"], kind="events").drop("event_file")


@query("unscored_only", "SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unscored_only(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return readers.unscored_only(docs, table(spark, sf_dir, "labels"), ["doc_id"])


def _densities(df):
    return df.select("doc_id", F.round(comment_density(F.col("text")), 6).alias("density"))


@query("score_incremental", "SELECT doc_id, count(*) AS n_results FROM documents GROUP BY doc_id")
def score_incremental(spark, sf_dir):
    path = scratch_path(spark, "scores")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    writers.score_incremental(labelled, None, ["doc_id"], _densities, path)
    writers.score_incremental(docs, spark.read.parquet(path), ["doc_id"], _densities, path)
    return spark.read.parquet(path).groupBy("doc_id").agg(F.count("*").alias("n_results"))


def _sizes(df):
    return df.withColumn("n_chars", F.length("text"))


@query(
    "score_changed",
    """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id IN (SELECT doc_id FROM labels) THEN 2 ELSE 1 END AS n_results,
       CAST(length(text) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS n_chars
FROM documents""",
)
def score_changed(spark, sf_dir):
    path = scratch_path(spark, "ledger")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    for rows in (labelled, changed, docs.filter("doc_id % 5 <> 0")):
        ledger.score_changed(rows, path, ["doc_id"], ["text"], _sizes, buckets=8)
    counted = ledger.results(spark, path).groupBy("doc_id").agg(F.count("*").cast("int").alias("n_results"))
    now = ledger.results_for(changed, path, ["doc_id"], ["text"], buckets=8).select("doc_id", "n_chars")
    return now.join(counted, "doc_id")


@query("stream_pairs", PAIRS, ("fx_code",))
def stream_pairs(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_responses")
    source, target, checkpoint = (scratch_path(spark, f"stream-{n}") for n in ("in", "out", "checkpoint"))
    writers.write_responses(rows, source)
    work = pairs_from_responses(keep=["result_id"])
    follow(spark, source, rows.schema, work, target, checkpoint).awaitTermination()
    return flat_pairs(readers.read_pairs(spark, target), "result_id")
