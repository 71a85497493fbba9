"""Taxonomy to pair dataset.

The two model calls are the costly part and are not repeatable, so the answers of each stage are
written before anything is derived from them: a lost executor never asks the model again for rows that
were already saved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmill.functions.messages import wrap_messages
from prefmill.operators.batch import Loader, generate_batch
from prefmill.operators.journal import generate_resumable
from prefmill.operators.pairs import build_pairs, build_test_pairs, dataset_card
from prefmill.operators.prompts import mode_guard, render_stage1, render_stage2
from prefmill.operators.responses import classify_error, parse_stage
from prefmill.operators.selection import sample_n
from prefmill.operators.taxonomy import combinations
from prefmill.session import exists
from prefmill.sources.writers import write_pairs, write_responses


def request_id(*parts: str) -> Column:
    """A stable id of some columns; as JSON, no two rows of different values read alike."""
    return F.md5(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))


def _ask(
    df: DataFrame, prompt: str, into: str, loader: Loader, system: str | None, partitions: int | None, journal: str | None
) -> DataFrame:
    """Send prompts; with a system message the function gets the message list as JSON."""
    shown = F.to_json(wrap_messages(F.col(prompt), F.lit(system))) if system else F.col(prompt)
    rows = df.withColumn("_shown", shown)
    if journal:
        asked = generate_resumable(rows, "_shown", loader, journal, "request_id", into, partitions)
    else:
        asked = generate_batch(rows, "_shown", loader, into, partitions)
    return asked.drop("_shown").withColumnRenamed("error", "request_error")


def _stage(
    df: DataFrame, prompt: str, into: str, loader: Loader, system: str | None, partitions: int | None, path: str, resume: bool
) -> DataFrame:
    """The answers of a stage as saved. When resuming, a finished stage is read, and an unfinished one asks for what its journal lacks."""
    kept = [f for f in df.schema.fields if f.name not in (into, "request_error")]
    schema = T.StructType([*kept, T.StructField(into, T.StringType()), T.StructField("request_error", T.StringType())])
    if not (resume and exists(df.sparkSession, f"{path}/_SUCCESS")):
        asked = _ask(df, prompt, into, loader, system, partitions, f"{path}_journal" if resume else None)
        write_responses(asked, path, "overwrite" if resume else "errorifexists")
    return df.sparkSession.read.schema(schema).json(path)


def generate(
    spark: SparkSession,
    taxonomy: DataFrame,
    loader: Loader,
    out: str,
    is_test: bool = False,
    is_header: bool = False,
    num_samples: int | None = None,
    seed: int = 0,
    system: str | None = None,
    partitions: int | None = None,
    resume: bool = False,
) -> DataFrame:
    """Write the answers of both stages and the pairs below ``out``, and return the pair dataset.

    Each pair has a ``pair_id`` of its own, short enough to join on.
    ``loader`` gives the model function (see :mod:`prefmill.operators.batch`). ``partitions`` is the
    number of calls in flight. With ``resume`` each batch of answers is kept as it comes (see
    :mod:`prefmill.operators.journal`), and a repeated call goes on where a failed one stopped.
    """
    mode = mode_guard(is_test, is_header)
    combos = combinations(taxonomy)
    # Names may repeat; places in the taxonomy do not.
    place = [c for c in ("domain_pos", "domain", "task_pos", "task") if c in combos.columns]
    combos = sample_n(combos, num_samples, place, seed).withColumn("request_id", request_id(*place))
    prompts = render_stage1(combos, mode)

    first_path, second_path = f"{out}/first_responses", f"{out}/second_responses"
    answered = _stage(prompts, "first_prompt", "first_content", loader, system, partitions, first_path, resume)

    parsed = parse_stage(answered, 1, mode)
    good = F.col("error_info").isNull()
    shown = render_stage2(parsed, mode).withColumn("second_prompt", F.when(good, F.col("second_prompt")))
    finished = _stage(shown, "second_prompt", "second_content", loader, system, partitions, second_path, resume)

    results = classify_error(parse_stage(finished, 2, mode))
    if is_test:
        pairs, place = build_test_pairs(results, ["request_id"]), ["request_id", "prompt_type"]
    else:
        place = ["request_id", "item_pos"]
        pairs = build_pairs(results, place)
    pairs = pairs.withColumn("pair_id", request_id(*place)).drop("request_id", "item_pos")
    write_pairs(pairs, f"{out}/dataset", mode="overwrite" if resume else "errorifexists")
    return spark.read.parquet(f"{out}/dataset")


def report(pairs: DataFrame) -> DataFrame:
    """Rows and distinct domains, tasks and code forms of the finished dataset."""
    return dataset_card(pairs)
