"""Declared schemas of the tables that operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

STRING = T.StringType()

MESSAGE = T.StructType([T.StructField("role", STRING), T.StructField("content", STRING)])
MESSAGES = T.ArrayType(MESSAGE)

TASK = T.StructType([T.StructField("name", STRING), T.StructField("code_forms", T.ArrayType(STRING))])

#: One row per domain of a taxonomy file; ``domain_pos`` keeps the order of the file.
TAXONOMY = T.StructType(
    [
        T.StructField("domain_pos", T.IntegerType()),
        T.StructField("domain", STRING),
        T.StructField("libraries", T.ArrayType(STRING)),
        T.StructField("tasks", T.ArrayType(TASK)),
    ]
)

#: The same taxonomy as one JSON object, domain -> entry.
TAXONOMY_MAP = T.MapType(
    STRING,
    T.StructType(
        [T.StructField("libraries", T.ArrayType(STRING)), T.StructField("tasks", T.ArrayType(TASK))]
    ),
)

PAIR = T.StructType(
    [
        T.StructField("prompt", MESSAGES),
        T.StructField("chosen", MESSAGES),
        T.StructField("rejected", MESSAGES),
        T.StructField("domain", STRING),
        T.StructField("task", STRING),
        T.StructField("code_form", STRING),
    ]
)

TEST_PAIR = T.StructType([*PAIR.fields, T.StructField("prompt_type", STRING)])

RESPONSE = T.StructType(
    [T.StructField("request_id", STRING), T.StructField("response", STRING), T.StructField("error", STRING)]
)

#: Scalar points of training logs.
SCALARS = T.StructType(
    [
        T.StructField("run", STRING),
        T.StructField("event_file", STRING),
        T.StructField("tag", STRING),
        T.StructField("step", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)

METRIC_MAP = T.MapType(STRING, T.DoubleType())

#: Summary file of one evaluated model.
EVAL_SUMMARY = T.StructType(
    [T.StructField("metrics", METRIC_MAP), T.StructField("prompt_type_metrics", T.MapType(STRING, METRIC_MAP))]
)

#: Summaries of several models.
EVAL_RESULTS = T.StructType([T.StructField("model", STRING), T.StructField("type", STRING), *EVAL_SUMMARY.fields])

#: What the Arrow scorer returns for one parsable snippet.
AST_SCORES = T.StructType(
    [
        T.StructField("annotation_any", T.DoubleType()),
        T.StructField("annotation_some", T.DoubleType()),
        T.StructField("annotation_all", T.DoubleType()),
        T.StructField("docstring_coverage", T.DoubleType()),
        T.StructField("code_complexity", T.DoubleType()),
    ]
)
