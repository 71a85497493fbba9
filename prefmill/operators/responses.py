"""Model responses: bring them to their requests, parse them, and say what went wrong per row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmill.functions.strict_json import is_json, json_object, json_objects, json_wrapped
from prefmill.functions.text import let


@dataclass(frozen=True)
class ListKeys:
    """Member names of the two responses of a mode whose responses hold lists."""

    first_list: str
    first_code: str
    second_list: str
    original: str
    improved: str


# The member names of the responses.
LIST_KEYS = {
    "train": ListKeys("examples", "code", "improved_examples", "original_code", "improved_code"),
    "header": ListKeys("headers", "header", "improved_headers", "original_header", "improved_header"),
}
TEST_FIRST_KEYS = ("use_case", "code")
TEST_SECOND_KEYS = (
    "use_case",
    "original_code",
    "improved_code",
    "prompt_default",
    "prompt_code_form",
    "prompt_code_form_types",
)
ERROR_TEXTS = {
    "request": "Request error: ",
    "json": "JSON parse error: ",
    "processing": "Processing error: ",
}

_ERROR = "struct<kind: string, stage: int, detail: string>"


#: Bytes from which on a text may be beyond what the parser holds as one value.
LARGE_TEXT = 16 << 20


def _error(kind: str, stage: int, detail: str | Column) -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(kind).alias("kind"), F.lit(stage).alias("stage"), text.alias("detail"))


def join_responses(
    prompts: DataFrame, responses: DataFrame, key: str = "request_id", into: str = "first_content"
) -> DataFrame:
    """Place each response next to its request; a missing or failed one leaves a request error.

    ``responses`` has ``response`` and may have ``error``. Both sides are keyed by unique request ids,
    so the join spreads evenly however large it is.
    """
    error = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    answers = responses.select(
        key, F.when(error.isNull(), F.col("response")).alias(into), error.alias("request_error")
    )
    failed = F.when(F.col(into).isNull(), F.coalesce("request_error", F.lit("no response")))
    return prompts.join(answers, key, "left").withColumn("request_error", failed)


def _text(entry: Column, key: str) -> Column:
    return F.try_element_at(entry, F.lit(key))


def _first_items(wrapped: Column, mode: str) -> Column:
    """Items of a stage-1 response; null when members that stage 2 needs are not there."""
    if mode == "test":
        return let(
            json_object(wrapped),
            lambda o: F.when(
                o.isNotNull(), F.array(F.struct(*[F.coalesce(_text(o, k), F.lit("")).alias(k) for k in TEST_FIRST_KEYS]))
            ),
        )
    keys = LIST_KEYS[mode]

    def complete(entry: Column) -> Column:
        return F.map_contains_key(entry, "use_case") & F.map_contains_key(entry, keys.first_code)

    def item(entry: Column) -> Column:
        return F.struct(
            _text(entry, "use_case").alias("use_case"),
            _text(entry, keys.first_code).alias("code"),
            _text(entry, "prompt").alias("prompt"),
        )

    return let(
        json_objects(wrapped, keys.first_list), lambda list_: F.when(F.forall(list_, complete), F.transform(list_, item))
    )


def _second_items(wrapped: Column, mode: str) -> Column:
    """Items of a stage-2 response; null when it is no object with a list of objects."""
    if mode == "test":
        return let(
            json_object(wrapped),
            lambda o: F.when(
                o.isNotNull(), F.array(F.struct(*[F.coalesce(_text(o, k), F.lit("")).alias(k) for k in TEST_SECOND_KEYS]))
            ),
        )
    keys = LIST_KEYS[mode]

    def item(entry: Column) -> Column:
        return F.struct(
            _text(entry, "use_case").alias("use_case"),
            F.coalesce(_text(entry, keys.original), F.lit("")).alias("original_code"),
            F.coalesce(_text(entry, keys.improved), F.lit("")).alias("improved_code"),
        )

    return F.transform(json_objects(wrapped, keys.second_list), item)


def parse_stage(df: DataFrame, stage: int, mode: str = "train", content: str | None = None) -> DataFrame:
    """Parse the response of one stage into ``first_items`` or ``second_items``.

    Adds (or completes) ``error_info``. A row that failed in an earlier stage keeps its first error and
    gets no items. No row is dropped and no bad row fails the job.

    The parsed columns come out of a one-row ``inline``. Filters on them (such as :func:`drop_errors`)
    then stay above it, where Catalyst would otherwise push them down and parse every text again.
    """
    name = "first" if stage == 1 else "second"
    content = content or f"{name}_content"
    earlier = F.col("error_info") if "error_info" in df.columns else F.lit(None).cast(_ERROR)
    request = F.col("request_error") if "request_error" in df.columns else F.lit(None).cast("string")
    text = F.when(earlier.isNull(), F.col(content))
    read_items = _first_items if stage == 1 else _second_items

    def read(wrapped: Column) -> Column:
        valid = is_json(wrapped, F.col(content))
        return F.struct(valid.alias("valid"), F.when(valid, read_items(wrapped, mode)).alias("items"))

    def judge(found: Column) -> Column:
        items = found.getField("items")
        error = (
            F.when(earlier.isNotNull(), earlier)
            .when(F.col(content).isNull(), _error("request", stage, F.coalesce(request, F.lit("no response"))))
            .when(~found.getField("valid") & (F.octet_length(F.col(content)) > LARGE_TEXT), _error("json", stage, f"stage {stage} response is too large to be read, or not one JSON value"))
            .when(~found.getField("valid"), _error("json", stage, f"stage {stage} response is not one JSON value"))
            .when(items.isNull(), _error("processing", stage, f"stage {stage} response lacks the expected members"))
            .cast(_ERROR)
        )
        return F.struct(error.alias("error_info"), items.alias(f"{name}_items"))

    parsed = let(let(json_wrapped(text), read), judge)
    carried = [c for c in df.columns if c not in ("error_info", "request_error")]
    return df.select(*carried, F.inline(F.array(parsed)))


def classify_error(parsed: DataFrame) -> DataFrame:
    """Replace ``error_info`` by ``error`` (null when good), ``error_kind`` and ``error_stage``."""
    info = F.col("error_info")
    prefix = F.create_map(*[F.lit(x) for pair in ERROR_TEXTS.items() for x in pair])
    return parsed.withColumns(
        {
            "error": F.concat(F.element_at(prefix, info.getField("kind")), info.getField("detail")),
            "error_kind": info.getField("kind"),
            "error_stage": info.getField("stage"),
        }
    ).drop("error_info")


def parse_responses(df: DataFrame, mode: str = "train") -> DataFrame:
    """Parse both stages of finished rows and classify what failed."""
    return classify_error(parse_stage(parse_stage(df, 1, mode), 2, mode))


def drop_errors(results: DataFrame) -> DataFrame:
    """Rows without an error."""
    return results.filter(F.col("error").isNull())


def error_rows(results: DataFrame) -> DataFrame:
    """The complement of :func:`drop_errors`, for reporting."""
    return results.filter(F.col("error").isNotNull())
