"""Exact ranks, quantiles and bootstrap intervals that no task computes over a whole group."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemark.functions.axis import Axis
from tidemark.functions.ranks import quantiles, ranked
from tidemark.operators import metrics, scoring

AXIS = Axis()


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(8)
    rows = [(g, float(v) if rng.random() > 0.05 else None) for g, n in (("a", 900), ("b", 40), ("c", 1), (None, 60)) for v in np.round(rng.normal(size=n), 1 if g == "b" else 6)]
    return [*rows, ("none", None)]


def by_group(values):
    out = {}
    for g, v in values:
        if v is not None:
            out.setdefault(g, []).append(v)
    return {g: np.array(v) for g, v in out.items()}


def test_ranks_by_group(spark, values):
    got = ranked(spark.createDataFrame(values, "g string, x double"), ["g"], "x").collect()
    want = {(g, float(x)): ((v == x).sum(), (v < x).sum(), len(v)) for g, v in by_group(values).items() for x in np.unique(v)}
    assert {(r["g"], r["x"]): (r["here"], r["below"], r["all"]) for r in got} == want


def test_quantiles_by_group_and_of_all(spark, values):
    df = spark.createDataFrame(values, "g string, x double")
    at = {"lo": 0.0, "q": 0.1, "mid": 0.5, "hi": 0.937, "top": 1.0}
    got = {r["g"]: [r[c] for c in at] for r in quantiles(df, ["g"], "x", at).collect()}
    want = {g: np.quantile(v, list(at.values())) for g, v in by_group(values).items()}
    assert got.keys() == want.keys()
    for g in want:
        np.testing.assert_allclose(got[g], want[g], atol=1e-12)
    every = np.concatenate(list(by_group(values).values()))
    np.testing.assert_allclose(quantiles(df, [], "x", at).first(), np.quantile(every, list(at.values())), atol=1e-12)
    assert quantiles(df.where("false"), ["g"], "x", at).count() == 0


def test_continuous_scores_of_one_key_over_many_tasks(spark):
    rng = np.random.default_rng(2)
    p = rng.random(20_000)
    y = (rng.random(20_000) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"k": "one", "p": p, "y": y})).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        tasks = ranked(df, ["k"], "p").groupBy(F.spark_partition_id()).count().collect()
        auc = scoring.roc_auc(df, ["k"], "p", "y").first()["roc_auc"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 12_000
    order = np.argsort(p)
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    n1 = y.sum()
    assert auc == pytest.approx((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)), abs=1e-12)


@pytest.mark.parametrize(("n", "block"), [(100, 24), (96, 24), (30, 30), (20, 30), (31, 30)])
def test_bootstrap_states_give_what_drawn_returns_give(spark, n, block):
    import hashlib

    r = np.random.default_rng(n).normal(0.001, 0.05, n)
    r[n // 2] = -1.0  # a total loss: no division may hide in the growth
    p = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "r": r})
    statistics = {"sharpe": metrics.sharpe_of(252), "total": F.col("growth") - 1, "mean": F.col("s1") / F.col("n")}
    got = metrics.bootstrap(spark.createDataFrame(p), AXIS, "r", statistics, block=block, resamples=60, seed=3).first()
    if n < block:
        assert list(got)[1:] == [None] * 6
        return
    drawn = []
    for rep in range(60):
        x = []
        for b in range(math.ceil(n / block)):
            start = int(hashlib.md5(f"a:{rep}:{b}:3".encode()).hexdigest()[:15], 16) % n
            x += [r[(start + k) % n] for k in range(min(block, n - b * block))]
        x = np.array(x)
        assert len(x) == n
        drawn.append((x.mean() / x.std(ddof=1) * math.sqrt(252), np.prod(1 + x) - 1, x.mean()))
    want = [v for c in np.array(drawn).T for v in np.percentile(c, [2.5, 97.5])]
    np.testing.assert_allclose(list(got)[1:], want, atol=1e-9)


@pytest.mark.parametrize("joins", ["10m", "-1"])
def test_bootstrap_takes_rings_whole_however_spark_merges_partitions(spark, joins):
    """Starts near a series' end and last blocks lose nothing where Spark makes fewer tasks of some shuffles."""
    import hashlib

    rng, n, block, reps = np.random.default_rng(5), 1499, 24, 40
    series = {s: rng.normal(0.001, 0.05, n - i) for i, s in enumerate("abcdefg")}
    p = pd.concat([pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=len(r), freq="h"), "r": r}) for s, r in series.items()])
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": joins, "spark.sql.adaptive.autoBroadcastJoinThreshold": joins, "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = metrics.bootstrap(spark.createDataFrame(p), AXIS, "r", {"mean": F.col("s1") / F.col("n"), "total": F.col("growth") - 1}, block=block, resamples=reps, alpha=0.9)
        got = {r["symbol"]: list(r)[1:] for r in out.collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got.keys() == series.keys()
    for s, r in series.items():
        m, drawn = len(r), []
        for rep in range(reps):
            starts = [int(hashlib.md5(f"{s}:{rep}:{b}:0".encode()).hexdigest()[:15], 16) % m for b in range(math.ceil(m / block))]
            x = np.concatenate([r[(a + np.arange(block)) % m] for a in starts])[:m]
            drawn.append((x.mean(), np.prod(1 + x) - 1))
        want = [v for c in np.array(drawn).T for v in np.percentile(c, [45, 55])]
        np.testing.assert_allclose(got[s], want, atol=1e-9, err_msg=s)


def test_bootstrap_draws_are_not_broadcast(spark, capsys):
    """Few blocks make many draws, which Spark takes for few as well."""
    p = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=300, freq="h"), "r": np.random.default_rng(1).normal(0.001, 0.05, 300)})
    out = metrics.bootstrap(spark.createDataFrame(p), AXIS, "r", {"mean": F.col("s1") / F.col("n")}, block=3, resamples=500)
    assert len(out.collect()) == 1
    out.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    assert any("isFinalPlan=true" in line for line in plan) and any("md5(" in line for line in plan)
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = "".join(itertools.takewhile(lambda x: depth(x) > depth(line), plan[i + 1 :]))
            assert "md5(" not in below or "percentile(" in below  # the intervals, a row a key, may be
