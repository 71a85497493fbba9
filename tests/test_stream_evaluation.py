"""A stopped stream of evaluations goes on where it was and meets the batch result."""

import pytest

from prefmill.operators.evaluation import eval_summary
from prefmill.session import scratch_path
from prefmill.streaming.evaluation import follow_evaluation, followed_summary


def rows_of(df):
    return {(r["prompt_type"], r["metric"]): None if r["value"] is None else round(r["value"], 9) for r in df.collect()}


def test_every_row_counts_once_over_a_restart(spark):
    source, target, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "checkpoint"))
    scored = spark.range(900).selectExpr(
        "if(id % 50 = 0, null, 'type' || id % 3) AS prompt_type", "if(id % 7 = 0, null, id % 2 = 0) AS exec_success",
        "if(id % 5 = 0, null, id / 9D) AS comment_density", "cast(null as double) AS code_complexity",
    )
    scored.repartition(8).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def fail(batch):
        if batch == 2:
            raise RuntimeError("stopped midway")

    def follow(after=None):
        return follow_evaluation(spark, source, schema, lambda rows: rows, target, checkpoint, files_per_trigger=2, after_batch=after)

    with pytest.raises(Exception, match="stopped midway"):
        follow(fail).awaitTermination()
    part = followed_summary(spark, target)
    assert rows_of(part) != rows_of(eval_summary(spark.read.parquet(source)))
    follow().awaitTermination()
    assert rows_of(followed_summary(spark, target)) == rows_of(eval_summary(spark.read.parquet(source)))
    # New files add to what is there; a run without new files changes nothing.
    scored.limit(10).write.mode("append").parquet(source)
    follow().awaitTermination()
    follow().awaitTermination()
    assert rows_of(followed_summary(spark, target)) == rows_of(eval_summary(spark.read.parquet(source)))


def test_nothing_saved_yet(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        followed_summary(spark, str(tmp_path))
