"""Logged quantities of preference training, from log-probability columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmill.functions import rewards


def reward_columns(
    df: DataFrame,
    loss: str = "sigmoid",
    beta: float = rewards.BETA,
    label_smoothing: float = rewards.LABEL_SMOOTHING,
) -> DataFrame:
    """Add reward of each side, margin, accuracy and loss of every pair."""
    policy_chosen, ref_chosen = F.col("policy_chosen_logp"), F.col("ref_chosen_logp")
    policy_rejected, ref_rejected = F.col("policy_rejected_logp"), F.col("ref_rejected_logp")
    logit = (policy_chosen - policy_rejected) - (ref_chosen - ref_rejected)
    chosen = rewards.reward(policy_chosen, ref_chosen, beta)
    rejected = rewards.reward(policy_rejected, ref_rejected, beta)
    return df.withColumns(
        {
            "reward_chosen": chosen,
            "reward_rejected": rejected,
            "reward_margin": chosen - rejected,
            "reward_accuracy": (chosen > rejected).cast("double"),
            "loss": rewards.preference_loss(logit, loss, beta, label_smoothing),
        }
    )


def reward_metrics(
    df: DataFrame,
    by: Sequence[str] = (),
    loss: str = "sigmoid",
    beta: float = rewards.BETA,
    label_smoothing: float = rewards.LABEL_SMOOTHING,
) -> DataFrame:
    """Means of the reward quantities, one partial aggregate per partition."""
    rows = reward_columns(df, loss, beta, label_smoothing)
    return rows.groupBy(*by).agg(
        F.avg("loss").alias("loss"),
        F.avg("reward_chosen").alias("rewards_chosen"),
        F.avg("reward_rejected").alias("rewards_rejected"),
        F.avg("reward_accuracy").alias("rewards_accuracies"),
        F.avg("reward_margin").alias("rewards_margins"),
        F.avg("policy_chosen_logp").alias("logps_chosen"),
        F.avg("policy_rejected_logp").alias("logps_rejected"),
    )
