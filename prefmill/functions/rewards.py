"""Preference-optimisation quantities from log-probabilities (DPO, hinge and IPO papers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The loss names and the default settings.
LOSSES = ("sigmoid", "hinge", "ipo")
BETA = 0.3
LABEL_SMOOTHING = 0.0


def neg_log_sigmoid(z: Column) -> Column:
    """-log(sigmoid(z)) without overflow."""
    return F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def reward(policy_logp: Column, ref_logp: Column, beta: float = BETA) -> Column:
    return F.lit(beta) * (policy_logp - ref_logp)


def preference_loss(
    logit: Column, loss: str = "sigmoid", beta: float = BETA, label_smoothing: float = LABEL_SMOOTHING
) -> Column:
    """Loss of one pair; ``logit`` is (policy chosen - policy rejected) - (ref chosen - ref rejected)."""
    scaled = F.lit(beta) * logit
    if loss == "sigmoid":
        return F.lit(1.0 - label_smoothing) * neg_log_sigmoid(scaled) + F.lit(
            label_smoothing
        ) * neg_log_sigmoid(-scaled)
    if loss == "hinge":
        return F.greatest(F.lit(0.0), 1.0 - scaled)
    if loss == "ipo":
        return F.pow(logit - F.lit(1.0 / (2.0 * beta)), F.lit(2.0))
    raise ValueError(f"unknown loss {loss!r}; known: {', '.join(LOSSES)}")
