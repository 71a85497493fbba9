"""Code quality of chosen against rejected answers, overall and by category.

Scores are kept wide (one struct per side) until after aggregation: the means of all metrics and both
sides come from one partial aggregate, and only its few result rows are turned into long form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmill.functions.codescore import CODE_METRICS, ast_scores_each, code_metrics, is_valid_python
from prefmill.functions.codetext import clean_blocks, extract_fences
from prefmill.functions.messages import unwrap_content
from prefmill.functions.text import strip_text
from prefmill.operators.quantiles import box_summary
from prefmill.session import saved

# The compared sides, the metrics and the columns that are no category.
QUALITY_SIDES = ("chosen", "rejected")
QUALITY_METRICS = (*CODE_METRICS, "execution_result")
NOT_CATEGORIES = (
    "prompt", "chosen", "rejected", "chosen_code", "rejected_code", "chosen_metrics", "rejected_metrics",
    "pair_id", "request_id", "split",
)


def require_columns(df: DataFrame, names: Sequence[str] = QUALITY_SIDES) -> DataFrame:
    """The table itself, refused at planning time when a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def with_code_blocks(df: DataFrame, text: Column, prefix: str = "", first_only: bool = False, level: int = 2) -> DataFrame:
    """Add ``{prefix}blocks`` (cleaned code of a text) and ``{prefix}block_metrics``.

    A text without fences counts as code only when it parses as a whole. The scorer already tells that
    for a text that cleaning left as it is, so each text is parsed once; only a text changed by
    cleaning is checked separately. Both calls share one pass through the Python workers.
    """
    fences, whole, cleaned, found = (f"_{prefix}{n}" for n in ("fences", "whole", "cleaned", "scores"))
    out = df.withColumns({fences: extract_fences(text), whole: strip_text(text)})
    fenced = F.size(fences) > 0
    out = out.withColumn(cleaned, clean_blocks(F.when(fenced, F.col(fences)).otherwise(F.array(whole))))
    same = F.coalesce(F.get(cleaned, F.lit(0)) == F.col(whole), F.lit(False))
    scored = F.slice(cleaned, 1, 1) if first_only else F.col(cleaned)
    out = out.withColumn(f"_{prefix}check", F.when(~fenced & ~same, F.col(whole))).withColumn(f"_{prefix}scored", scored)
    out = out.withColumns(
        {found: ast_scores_each(F.col(f"_{prefix}scored")), f"_{prefix}valid": is_valid_python(F.col(f"_{prefix}check"))}
    )
    is_code = fenced | F.coalesce(f"_{prefix}valid", F.get(found, F.lit(0)).isNotNull())
    metrics = F.zip_with(f"_{prefix}scored", found, lambda b, s: code_metrics(b, s, level))
    none = F.array()
    return out.withColumns(
        {
            f"{prefix}blocks": F.when(is_code, F.col(cleaned)).otherwise(none),
            f"{prefix}block_metrics": F.when(is_code, metrics).otherwise(none),
        }
    ).drop(fences, whole, cleaned, found, f"_{prefix}check", f"_{prefix}scored", f"_{prefix}valid")


def result_meta(df: DataFrame) -> list[str]:
    """Columns that scoring carries along: all but the three texts."""
    return [c for c in df.columns if c not in ("prompt", *QUALITY_SIDES)]


def score_pairs(pairs: DataFrame, level: int = 2) -> DataFrame:
    """Metrics of the first code block of chosen and rejected, next to prompt, code and categories.

    ``chosen_execution`` and ``rejected_execution`` (struct with ``success``), where present, are put
    into the metrics as ``execution_result``: snippets are run elsewhere, never on executors. A side
    without a usable block has null metrics.
    """
    require_columns(pairs)
    executions = {s: f"{s}_execution" for s in QUALITY_SIDES}
    carried = [c for c in result_meta(pairs) if c not in executions.values()]
    texts = {f"{s}_code": F.when(F.col(s).isNotNull(), unwrap_content(pairs, s)) for s in QUALITY_SIDES}
    prompt = [unwrap_content(pairs, "prompt").alias("prompt")] if "prompt" in pairs.columns else []
    ran = [c for c in executions.values() if c in pairs.columns]
    out = pairs.select(*carried, *ran, *prompt, *[c.alias(n) for n, c in texts.items()])
    for side in QUALITY_SIDES:
        out = with_code_blocks(out, F.col(f"{side}_code"), f"{side}_", first_only=True, level=level)
    for side, execution in executions.items():
        first = F.get(f"{side}_block_metrics", F.lit(0))
        fields = [first.getField(m).alias(m) for m in CODE_METRICS]
        if execution in ran:
            fields.append(F.col(execution).alias("execution_result"))
        out = out.withColumn(f"{side}_metrics", F.when(F.size(f"{side}_blocks") > 0, F.struct(*fields)))
    return out.select(
        *carried, *(["prompt"] if prompt else []), *texts, *[f"{s}_metrics" for s in QUALITY_SIDES]
    )


def category_columns(scored: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Category columns: everything that is not text, code, metrics, an id that jobs here add, or excluded.

    Exclude key columns of your own: a category with a value per row gives a result as long as the table."""
    return [c for c in scored.columns if c not in NOT_CATEGORIES and c not in exclude]


def exec_to_int(execution: Column) -> Column:
    """An execution outcome as 1 or 0."""
    return execution.getField("success").cast("int")


def metric_names(scored: DataFrame) -> list[str]:
    """Metrics that the table holds, in report order."""
    present = scored.schema["chosen_metrics"].dataType.names
    return [m for m in QUALITY_METRICS if m in present]


def metric_values(scored: DataFrame) -> dict[tuple[str, str], Column]:
    """One double expression per (metric, side)."""
    values = {}
    for metric in metric_names(scored):
        for side in QUALITY_SIDES:
            field = F.col(f"{side}_metrics").getField(metric)
            value = exec_to_int(field) if metric == "execution_result" else field
            values[metric, side] = value.cast("double")
    return values


def metrics_long(scored: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per side and metric value; nulls are left out."""
    entries = [
        F.when(
            value.isNotNull(),
            F.struct(F.lit(metric).alias("metric"), F.lit(side).alias("side"), value.alias("value")),
        )
        for (metric, side), value in metric_values(scored).items()
    ]
    return scored.select(*keep, F.inline(F.array_compact(F.array(*entries))))


def _mean_aggregates(scored: DataFrame) -> list[Column]:
    aggregates = []
    for (metric, side), value in metric_values(scored).items():
        aggregates += [F.avg(value).alias(f"{metric}|{side}|mean"), F.count(value).alias(f"{metric}|{side}|n")]
    return aggregates


def _means_to_rows(wide: DataFrame, metrics: Sequence[str], keep: Sequence[str | Column] = ()) -> DataFrame:
    """Long form of the wide means, for metrics with values on both sides."""
    entries = []
    for metric in metrics:
        counts = [F.col(f"`{metric}|{side}|n`") for side in QUALITY_SIDES]
        both = (counts[0] > 0) & (counts[1] > 0)
        for side, n in zip(QUALITY_SIDES, counts):
            mean = F.col(f"`{metric}|{side}|mean`")
            fields = (F.lit(metric).alias("metric"), F.lit(side).alias("side"), mean.alias("mean"), n.alias("n"))
            entries.append(F.when(both, F.struct(*fields)))
    return wide.select(*keep, F.inline(F.array_compact(F.array(*entries))))


def side_means(scored: DataFrame) -> DataFrame:
    """Mean of each metric for chosen and rejected, where both sides have values."""
    return _means_to_rows(scored.agg(*_mean_aggregates(scored)), metric_names(scored))


def _category_sets(df: DataFrame, categories: Sequence[str]):
    return df.groupingSets([[c] for c in categories], *categories)


def _grouped_category(categories: Sequence[str]) -> list[Column]:
    """Name and value of the column that a grouping-sets row stands for."""
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in categories:
        name = F.when(F.grouping(c) == 0, F.lit(c)).otherwise(name)
        value = F.when(F.grouping(c) == 0, F.col(c).cast("string")).otherwise(value)
    return [name.alias("category"), value.alias("category_value")]


def category_means(scored: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """:func:`side_means` for every value of every category column, in one grouping-sets pass."""
    categories = list(categories or category_columns(scored))
    grouped = _category_sets(scored, categories).agg(*_grouped_category(categories), *_mean_aggregates(scored))
    return _means_to_rows(grouped.drop(*categories), metric_names(scored), ("category", "category_value"))


def both_sides_only(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """Summary rows of the groups in which both sides occur; a group has one row per side."""
    group = Window.partitionBy(*by)
    sides = [F.min("side").over(group).alias("_low"), F.max("side").over(group).alias("_high")]
    return summary.select("*", *sides).filter("_low <> _high").drop("_low", "_high")


def side_box(scored: DataFrame) -> DataFrame:
    """Box summary of each metric for chosen and rejected, where both sides have values.

    The values are saved in long form first: they are read several times, and made once.
    """
    values = saved(metrics_long(scored), "box-values")
    return both_sides_only(box_summary(values, ["metric", "side"], "value"), ["metric"])


def category_box(scored: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """:func:`side_box` for every value of every category column."""
    categories = list(categories or category_columns(scored))
    by = ["category", "category_value", "metric", "side"]
    values = saved(metrics_long(scored, categories), "box-values")
    named = [F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("category_value")) for c in categories]
    tall = values.select("metric", "side", "value", F.inline(F.array(*named)))
    return both_sides_only(box_summary(tall, by, "value"), ["category", "category_value", "metric"])
