"""Whole jobs on small data, and the streaming form of the row-wise operators."""

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from prefmill import schemas
from prefmill.functions.text import TOKEN
from prefmill.plans import dataset_quality, finetune_data, generate, model_quality, statistics, training_logs
from prefmill.session import scratch_path
from prefmill.sources import writers
from prefmill.streaming import follow, pairs_from_responses, scores_from_pairs

# The workers cannot import test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TAXONOMY = [
    (0, "web", ["flask"], [("serve", ["function", "class"]), ("fail first", ["class"])]),
    (1, "data", ["pandas"], [("clean", ["function"]), ("fail second", ["function"])]),
]


def model():
    """A stand-in model that answers the two stages and fails where the task says so."""
    import json

    def answer(prompts):
        out = []
        for p in prompts:
            header, test = '"header' in p, "prompt_default" in p or '{"use_case": "...", "code": "..."}' in p
            second = "Rewrite" in p
            task = p.split("Task: ")[1].split("\n")[0]
            code = f"x = '{task}'"
            if "fail first" in p:
                raise ValueError("overloaded")
            if "fail second" in p and second:
                out.append('{"broken"')
            elif test and second:
                prompts_ = {"prompt_default": "d", "prompt_code_form": "c", "prompt_code_form_types": "t"}
                out.append(json.dumps({"use_case": "u", "original_code": code, "improved_code": code + "  # ok", **prompts_}))
            elif test:
                out.append(json.dumps({"use_case": "u", "code": code}))
            else:
                key, items = ("header", "headers") if header else ("code", "examples")
                if second:
                    entry = {"use_case": "u", f"original_{key}": code, f"improved_{key}": code + "  # ok"}
                    out.append(json.dumps({f"improved_{items}": [entry]}))
                else:
                    out.append(json.dumps({items: [{"use_case": "u", key: code, "prompt": f"write {task}"}]}))
        return out

    return answer


def run(spark, **options):
    taxonomy = spark.createDataFrame(TAXONOMY, schemas.TAXONOMY)
    out = scratch_path(spark, "generated")

    def load():
        return model()

    return generate.generate(spark, taxonomy, load, out, **options), out


def test_generate_train_pairs(spark):
    for header in (False, True):
        pairs, out = run(spark, is_header=header)
        rows = {r.task: (r.prompt[0].content, r.chosen[0].content, r.rejected[0].content, r.code_form) for r in pairs.collect()}
        assert rows == {
            "serve": ("write serve", "x = 'serve'  # ok", "x = 'serve'", "['function', 'class']"),
            "clean": ("write clean", "x = 'clean'  # ok", "x = 'clean'", "['function']"),
        }
        saved = spark.read.json(f"{out}/second_responses")
        assert saved.count() == 4
    assert tuple(generate.report(pairs).first()) == (2, 2, 2, 2)
    assert pairs.select("pair_id").distinct().count() == 2


def test_generate_test_pairs(spark):
    pairs, _ = run(spark, is_test=True)
    assert {(r.task, r.prompt_type, r.code_form) for r in pairs.collect()} == {
        (t, p, "function") for t in ("serve", "clean") for p in ("default", "code_form", "code_form_types")
    }
    assert pairs.select("pair_id").distinct().count() == 6


def test_a_system_message_is_sent_as_a_message_list(spark):
    taxonomy = spark.createDataFrame(TAXONOMY, schemas.TAXONOMY)
    out = scratch_path(spark, "generated")

    def load():
        import json

        return lambda prompts: [json.dumps([m["role"] for m in json.loads(p)]) for p in prompts]

    generate.generate(spark, taxonomy, load, out, num_samples=1, system="be brief")
    assert json.loads(spark.read.json(f"{out}/first_responses").first().first_content) == ["system", "user"]


def saved_pairs(spark):
    path = scratch_path(spark, "pairs")
    rows = [(i, f"ask {i}", f"```\ndef f(a: int) -> int:\n    return a + {i}\n```", "def f(a):\n    return a", "even" if i % 2 == 0 else "odd") for i in range(12)]
    df = spark.createDataFrame(rows, "k int, prompt string, chosen string, rejected string, parity string")
    writers.write_pairs(df.withColumn("split", F.when(F.col("k") < 10, "train").otherwise("test")), path, ["split"])
    return path


def test_statistics(spark):
    import re

    out = scratch_path(spark, "stats")
    tables = statistics.statistics(spark, saved_pairs(spark), out)
    words = re.compile(TOKEN.replace(r"\p{L}\p{N}_", r"\w").replace("++", "+"))
    sizes = [len(words.findall(f"ask {i}")) for i in range(10)]
    row = tables["stats"].filter("side = 'prompt'").first()
    assert (row.n_rows, row["mean"], row["max"]) == (10, sum(sizes) / 10, max(sizes))
    assert tables["histogram"].agg(F.sum("n")).first()[0] == 30
    assert spark.read.json(f"{out}/token_length_stats").first().dataset_info["size"] == 10


def test_dataset_quality_scores_each_row_once(spark):
    path, out = saved_pairs(spark), scratch_path(spark, "quality")
    first = dataset_quality.dataset_quality(spark, path, out, ["k"], num_examples=4)
    assert sorted(r.k for r in first["scored"].collect()) == [0, 1, 2, 3]
    tables = dataset_quality.dataset_quality(spark, path, out, ["k"])
    assert sorted(r.k for r in tables["scored"].collect()) == list(range(10))
    means = {(r.metric, r.side): r["mean"] for r in tables["side_means"].collect()}
    assert means["type_annotation_coverage", "chosen"] == 1.0
    assert means["type_annotation_coverage", "rejected"] == 0.0
    assert {(r.category, r.category_value) for r in tables["category_means"].collect()} == {("parity", "even"), ("parity", "odd")}
    assert tables["category_box"].count() == 2 * tables["side_box"].count()


def test_model_quality_and_comparison(spark):
    examples = spark.createDataFrame(
        [(1, "p1", "default", "c", "r"), (2, "p2", "code_form", "c", "r"), (3, None, "code_form", "c", "r")],
        "example_id int, prompt string, prompt_type string, chosen string, rejected string",
    )

    def typed():
        return lambda prompts: ["```\ndef f(a: int) -> int:\n    return a\n```" for _ in prompts]

    def plain():
        return lambda prompts: ["def f(a):\n    return a" if "1" in p else "no code at all" for p in prompts]

    paths = {}
    for name, kind, loader in (("tuned", "fine-tuned", typed), ("start", "base", plain)):
        out = scratch_path(spark, name)
        predictions = model_quality.generate_predictions(spark, examples, loader, out)
        tables = model_quality.evaluate(spark, examples, predictions.drop("error"), out)
        assert tables["results"].count() == 3
        assert tables["fails"].count() == (0 if name == "tuned" else 1)
        paths[f"{out}/summary"] = (name, kind)
    rows = model_quality.compare_models(spark, paths).filter("metric = 'type_annotation_coverage'").collect()
    got = {(r.prompt_type, r.model): (r.value, r.delta) for r in rows}
    assert got == {("default", "start"): (0.0, None), ("default", "tuned"): (1.0, 1.0), ("code_form", "tuned"): (1.0, None)}


def test_training_series(spark):
    path = scratch_path(spark, "logs")
    spark.createDataFrame([("r", "f", "eval/loss", 2, 0.5), ("r", "f", "zzz", 1, 1.0)], schemas.SCALARS).write.parquet(path)
    tables = training_logs.training_series(spark, path)
    assert [(r.title, r.step) for r in tables["series"].collect()] == [("Loss", 2)]
    assert "train/loss" in {r.tag for r in tables["missing"].collect()}
    registry = spark.createDataFrame([("r", "Run")], "run string, name string")
    assert training_logs.training_series(spark, path, registry)["series"].first().name == "Run"


def test_finetune_data(spark):
    df = spark.createDataFrame([(1, "a b", "c"), (2, "d", "e f g")], "k int, prompt string, chosen string")
    rows = {r.k: (r.text, r.tokens) for r in finetune_data.finetune_data(df, ["k"], max_length=3).collect()}
    assert rows == {1: ("a b\nc", ["a", "b", "c"]), 2: ("d\ne f g", ["d", "e", "f"])}
    alone = finetune_data.finetune_data(df.withColumn("split", F.lit("train")), ["k"], combine=False).collect()
    assert {(r.text, r.split) for r in alone} == {("c", "train"), ("e f g", "train")}


FIRST = '{"examples":[{"use_case":"u","code":"def f(a): pass","prompt":"p"}]}'
SECOND = '{"improved_examples":[{"use_case":"u","original_code":"def f(a): pass","improved_code":"def f(a: int) -> int: pass"}]}'


def test_streams_take_new_files_once(spark):
    schema = "domain string, task string, code_form string, first_content string, second_content string"
    source, target, scores = (scratch_path(spark, n) for n in ("in", "pairs", "scores"))
    checkpoints = [scratch_path(spark, "checkpoint") for _ in range(2)]

    def arrive(domain, second):
        df = spark.createDataFrame([(domain, "t", "f", FIRST, second)], schema)
        df.write.mode("append").json(source)
        row_schema = df.schema
        follow(spark, source, row_schema, pairs_from_responses(), target, checkpoints[0]).awaitTermination()
        follow(spark, target, schemas.PAIR, scores_from_pairs, scores, checkpoints[1], "parquet").awaitTermination()

    arrive("one", SECOND)
    arrive("bad", SECOND + "}")
    arrive("two", SECOND)
    rows = spark.read.parquet(scores).collect()
    assert sorted(r.domain for r in rows) == ["one", "two"]
    assert {r.chosen_metrics.type_annotation_coverage for r in rows} == {1.0}
    assert {r.rejected_metrics.type_annotation_coverage for r in rows} == {0.0}
