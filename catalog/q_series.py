"""Training-log series and preference rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import table, view
from catalog.registry import query, rounded
from prefmill.functions import rewards
from prefmill.operators import series as S
from prefmill.operators.preference import reward_columns, reward_metrics

PARTS = (
    "CASE WHEN contains(tag, 'train/') THEN 'Train' WHEN contains(tag, 'eval/') THEN 'Eval' ELSE '' END AS split, "
    "string_split(tag, '/')[-1] AS label"
)
GROUPS = """
, shown(title, tag) AS (VALUES ('Loss', 'train/loss'), ('Loss', 'eval/loss'), ('Reward Margins', 'train/rewards/margins'), ('All Train', 'train/loss'), ('All Train', 'train/rewards/margins'))"""

#: Titles that share tags, so that one point belongs to several.
SHARED_GROUPS = {
    "Loss": ["train/loss", "eval/loss"],
    "Reward Margins": ["train/rewards/margins"],
    "All Train": ["train/loss", "train/rewards/margins"],
}


def points(spark, sf_dir):
    return view(spark, sf_dir, "fx_scalars")


@query(
    "read_scalar_logs_tags",
    "SELECT run, event_file, tag, step, value FROM fx_scalars WHERE tag IN ('train/loss', 'eval/loss', 'train/rewards/margins')",
    ("fx_scalars",),
)
def keep_tags(spark, sf_dir):
    return S.keep_tags(points(spark, sf_dir))


@query(
    "missing_tags",
    """
SELECT DISTINCT run, event_file, tag FROM (SELECT DISTINCT run, event_file FROM fx_scalars) f,
       (VALUES ('train/loss'), ('train/accuracy'), ('eval/loss'), ('eval/rewards/margins')) w(tag)
WHERE (run, event_file, tag) NOT IN (SELECT (run, event_file, tag) FROM fx_scalars)""",
    ("fx_scalars",),
)
def missing_tags(spark, sf_dir):
    groups = {"a": ["train/loss", "train/accuracy"], "b": ["eval/loss", "eval/rewards/margins"]}
    return S.missing_tags(points(spark, sf_dir), groups)


@query(
    "join_metric_groups",
    f"{GROUPS.strip()}\nSELECT run, event_file, tag, step, value, title FROM fx_scalars JOIN shown USING (tag)",
    ("fx_scalars",),
)
def join_metric_groups(spark, sf_dir):
    return S.join_metric_groups(points(spark, sf_dir), SHARED_GROUPS)


@query("tag_parts", f"SELECT run, step, tag, {PARTS} FROM fx_scalars", ("fx_scalars",))
def tag_parts(spark, sf_dir):
    return S.tag_parts(points(spark, sf_dir)).select("run", "step", "tag", "split", "label")


@query(
    "series_sort",
    "SELECT run, event_file, tag, step, value FROM fx_scalars ORDER BY run, tag, step, event_file",
    ("fx_scalars",),
)
def series_sort(spark, sf_dir):
    return S.series_sort(points(spark, sf_dir))


@query(
    "series_index",
    """
SELECT run, event_file, tag, step, value, row_number() OVER (PARTITION BY run, tag ORDER BY step, event_file) AS series_index
FROM fx_scalars""",
    ("fx_scalars",),
)
def series_index(spark, sf_dir):
    return S.series_index(points(spark, sf_dir))


@query(
    "series_union",
    "SELECT run, event_file, tag, step, value FROM fx_scalars WHERE event_file IN ('file0', 'file1')",
    ("fx_scalars",),
)
def series_union(spark, sf_dir):
    files = [points(spark, sf_dir).filter(F.col("event_file") == name) for name in ("file0", "file1")]
    return S.series_union(files)


@query(
    "run_series",
    f"""
SELECT run, event_file, tag, step, value, CASE WHEN tag = 'train/rewards/margins' THEN 'Reward Margins' ELSE 'Loss' END AS title, {PARTS}
FROM fx_scalars WHERE tag NOT LIKE 'other/%'""",
    ("fx_scalars",),
)
def run_series(spark, sf_dir):
    return S.run_series(points(spark, sf_dir))


@query(
    "multi_run_series",
    f"""
SELECT run, event_file, tag, step, value, CASE WHEN tag = 'train/rewards/margins' THEN 'Reward Margins' ELSE 'Loss' END AS title, {PARTS}, n_name AS name
FROM fx_scalars JOIN nation ON run = 'run' || CAST(n_nationkey + 1 AS VARCHAR) WHERE tag NOT LIKE 'other/%'""",
    ("fx_scalars",),
)
def multi_run_series(spark, sf_dir):
    registry = table(spark, sf_dir, "nation").selectExpr("'run' || CAST(n_nationkey + 1 AS STRING) AS run", "n_name AS name")
    return S.multi_run_series(points(spark, sf_dir), registry)


Z = f"{rewards.BETA} * ((policy_chosen_logp - policy_rejected_logp) - (ref_chosen_logp - ref_rejected_logp))"
LOGIT = "((policy_chosen_logp - policy_rejected_logp) - (ref_chosen_logp - ref_rejected_logp))"
NEG_LOG_SIGMOID = f"(greatest(-({Z}), 0.0) + ln(1.0 + exp(-abs({Z}))))"
LOSS_SQL = {
    "sigmoid": f"0.9 * {NEG_LOG_SIGMOID} + 0.1 * {NEG_LOG_SIGMOID.replace(f'-({Z})', f'({Z})')}",
    "hinge": f"greatest(0.0, 1.0 - {Z})",
    "ipo": f"pow({LOGIT} - {1.0 / (2 * rewards.BETA)}, 2)",
}


def reward_sql(loss: str) -> str:
    chosen, rejected = (f"{rewards.BETA} * (policy_{s}_logp - ref_{s}_logp)" for s in ("chosen", "rejected"))
    return f"""
SELECT l_returnflag, '{loss}' AS loss_name, round(avg({LOSS_SQL[loss]}), 6) AS loss, round(avg({chosen}), 6) AS rewards_chosen,
       round(avg({rejected}), 6) AS rewards_rejected, round(avg(CASE WHEN {chosen} > {rejected} THEN 1.0 ELSE 0.0 END), 6) AS rewards_accuracies,
       round(avg({chosen} - {rejected}), 6) AS rewards_margins, round(avg(policy_chosen_logp), 6) AS logps_chosen,
       round(avg(policy_rejected_logp), 6) AS logps_rejected
FROM fx_logps GROUP BY l_returnflag"""


REWARD_NAMES = (
    "loss", "rewards_chosen", "rewards_rejected", "rewards_accuracies", "rewards_margins", "logps_chosen", "logps_rejected",
)


def _rewards(loss: str):
    def run(spark, sf_dir):
        rows = reward_metrics(view(spark, sf_dir, "fx_logps"), ["l_returnflag"], loss, label_smoothing=0.1)
        return rows.select("l_returnflag", F.lit(loss).alias("loss_name"), *rounded(*REWARD_NAMES))

    return run


for _loss, _name in (("sigmoid", "reward_metrics"), ("hinge", "reward_metrics_hinge"), ("ipo", "reward_metrics_ipo")):
    query(_name, reward_sql(_loss), ("fx_logps",))(_rewards(_loss))


@query(
    "reward_columns",
    f"""
SELECT l_orderkey, l_linenumber, round({rewards.BETA} * (policy_chosen_logp - ref_chosen_logp), 6) AS reward_chosen,
       round({rewards.BETA} * (policy_rejected_logp - ref_rejected_logp), 6) AS reward_rejected, round({NEG_LOG_SIGMOID}, 6) AS loss
FROM fx_logps""",
    ("fx_logps",),
)
def reward_rows(spark, sf_dir):
    rows = reward_columns(view(spark, sf_dir, "fx_logps"))
    return rows.select("l_orderkey", "l_linenumber", *rounded("reward_chosen", "reward_rejected", "loss"))
