import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmill.functions import rewards
from prefmill.operators import lengths as L
from prefmill.operators import quantiles as Q
from prefmill.operators.preference import reward_columns, reward_metrics
from prefmill.session import scratch_path

PROBS = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "p999": 0.999, "p100": 1.0}


def groups():
    rng = np.random.default_rng(5)
    return {
        "spread": rng.normal(size=4000),
        "ties": np.repeat([1.0, 2.0, 3.0], [3000, 1, 500]),
        "one": np.array([4.25]),
        "two": np.array([1.0, 2.0]),
        "far": np.concatenate([rng.random(999), [1e300]]),
        None: rng.integers(0, 50, 777).astype(float),
    }


@pytest.fixture(scope="module")
def table(spark):
    rows = [(g, float(v)) for g, vs in groups().items() for v in vs] + [("nothing", None)]
    return spark.createDataFrame(rows, "g string, x double")


@pytest.mark.parametrize(("accuracy", "whole"), [(None, Q.WHOLE), (100, 10), (1000, 100), (20, 1)])
def test_quantiles_equal_numpy(table, accuracy, whole):
    got = {r.g: r for r in Q.exact_quantiles(table, ["g"], "x", PROBS, accuracy, whole).collect()}
    assert set(got) == set(groups())
    for g, values in groups().items():
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.percentile(values, 100 * p), rel=1e-9), (g, name)


def test_box_summary(table):
    got = {r.g: r for r in Q.box_summary(table, ["g"], "x", 100, 10).collect()}
    for g, values in groups().items():
        q1, q3 = np.percentile(values, [25, 75])
        kept = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
        assert (got[g].whisker_low, got[g].whisker_high, got[g].n_values) == (kept.min(), kept.max(), len(values))


def test_groups_without_a_broadcast(spark, table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.g: r.m for r in Q.exact_quantiles(table, ["g"], "x", {"m": 0.5}, 100, 10).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {g: pytest.approx(np.percentile(v, 50)) for g, v in groups().items()}


@pytest.fixture(scope="module")
def lengths(spark):
    rng = np.random.default_rng(3)
    data = {"prompt": rng.integers(5, 60, 500), "chosen": rng.integers(0, 900, 500), "rejected": np.full(500, 10_000)}
    rows = list(zip(*[map(int, v) for v in data.values()]))
    return data, L.length_counts(spark.createDataFrame(rows, "prompt int, chosen int, rejected int"))


def test_length_stats_equal_numpy(lengths):
    data, counts = lengths
    got = {r.side: r for r in L.length_stats(counts).collect()}
    for side, v in data.items():
        expected = {"mean": v.mean(), "min": v.min(), "max": v.max(), "std": v.std(), "n_rows": len(v)}
        expected |= {name: np.percentile(v, 100 * p) for name, p in L.QUANTILES.items()}
        for name, value in expected.items():
            assert got[side][name] == pytest.approx(value, abs=1e-9), (side, name)


def test_histogram_equals_numpy(lengths):
    data, counts = lengths
    edges = np.linspace(0, max(v.max() for v in data.values()) + 50, 50)
    rows = L.length_histogram(counts).collect()
    for side, v in data.items():
        mine = sorted((r for r in rows if r.side == side), key=lambda r: r.bin)
        assert [r.n for r in mine] == list(np.histogram(v, bins=edges)[0])
        assert [r.density for r in mine] == pytest.approx(list(np.histogram(v, bins=edges, density=True)[0]))
        assert [r.bin_start for r in mine] + [mine[-1].bin_end] == pytest.approx(list(edges))


def test_density_covers_one(lengths):
    _, counts = lengths
    areas = L.length_density(counts).groupBy("side").agg(F.sum(F.expr("density * (bin_end - bin_start)")).alias("a"))
    assert [r.a for r in areas.collect()] == pytest.approx([1.0] * 3)


def test_token_lengths_take_messages_and_text(spark):
    df = spark.createDataFrame([([("user", "a b.")], "c", None)], "prompt array<struct<role string, content string>>, chosen string, rejected string")
    assert tuple(L.token_lengths(df).first()) == (3, 1, 0)


LOGPS = [(-1.0, -2.0, -3.0, -1.0), (-5.0, -1.0, -1.0, -4.0), (-900.0, 0.0, 0.0, -900.0), (0.0, 0.0, 0.0, 0.0)]


@pytest.mark.parametrize("loss", rewards.LOSSES)
def test_losses_equal_the_formulas(spark, loss):
    beta, eps = 0.3, 0.1
    names = "policy_chosen_logp double, ref_chosen_logp double, policy_rejected_logp double, ref_rejected_logp double"
    df = spark.createDataFrame(LOGPS, names)
    pc, rc, pr, rr = np.array(LOGPS).T
    h = (pc - pr) - (rc - rr)
    formula = {
        "sigmoid": (1 - eps) * np.logaddexp(0, -beta * h) + eps * np.logaddexp(0, beta * h),
        "hinge": np.maximum(0, 1 - beta * h),
        "ipo": (h - 1 / (2 * beta)) ** 2,
    }[loss]
    got = [r.loss for r in reward_columns(df, loss, beta, eps).collect()]
    assert got == pytest.approx(list(formula))
    row = reward_metrics(df, loss=loss, beta=beta, label_smoothing=eps).first()
    assert row.loss == pytest.approx(formula.mean())
    assert row.rewards_accuracies == pytest.approx((beta * (pc - rc) > beta * (pr - rr)).mean())
    assert row.rewards_margins == pytest.approx((beta * h).mean())


def test_unknown_loss(spark):
    with pytest.raises(ValueError, match="unknown loss"):
        rewards.preference_loss(F.lit(1.0), "other")


def test_rows_are_never_broadcast_to_their_groups(spark):
    """Repeated values make a small file of many rows, which looks smaller than what is known of its groups."""
    path = scratch_path(spark, "repeated")
    spark.range(200_000).selectExpr("CAST(id % 3 AS string) AS g", "id % 5 / 2D AS x").write.parquet(path)
    rows = spark.read.parquet(path)
    boxes = Q.box_summary(rows, ["g"], "x")
    plan = boxes._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BuildLeft" not in plan
    assert sorted(tuple(r) for r in boxes.collect()) == [(g, 0.5, 1.0, 1.5, 0.0, 2.0, n) for g, n in (("0", 66_667), ("1", 66_667), ("2", 66_666))]


def test_rows_of_groups_without_brackets_give_nothing(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), (None, 3.0)], "g string, x double")
    known = Q._brackets(Q.group_values(rows, ["g"], "x"), ["g"], [0.5], 100, 10).filter("g = 'a' OR g IS NULL")
    got = Q.exact_quantiles(rows, ["g"], "x", {"m": 0.5}, brackets=known).collect()
    assert {r.g: r.m for r in got} == {"a": 1.5, None: 3.0}


@pytest.mark.parametrize("few", [10_000, 1])
def test_boxes_are_the_same_however_groups_are_looked_up(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW", few)
    rows = spark.createDataFrame([(g, float(k)) for g in ("a", None) for k in range(9)], "g string, x double")
    got = {tuple(r) for r in Q.box_summary(rows, ["g"], "x").collect()}
    assert got == {(g, 2.0, 4.0, 6.0, 0.0, 8.0, 9) for g in ("a", None)}
