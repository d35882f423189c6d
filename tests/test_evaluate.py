"""Resampling by blocks and exact order statistics against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import evaluate


def tree_draws(n, b):
    """A round's draws, each number of the tree computed in Python."""
    p = 2_147_483_647

    def draw(node, level, t, width):
        z1 = (b * 48271 + node * 16807 + (level + 1)) % p
        z2 = (z1 * z1 + t * 69621 + 11) % p
        z3 = (z2 * 48271 + z1) % p
        z4 = (z3 * z3 + 7) % p
        z5 = (z4 * 69621 + z2) % p
        return (z5 * p + z4) % width

    size, level = 64, 0
    while size < n:
        size, level = size * 64, level + 1
    nodes = {0: n}
    while size > 64:
        children = {}
        for node, c in nodes.items():
            for t in range(c):
                child = (node * size + draw(node, level, t, min(size, n - node * size))) // (size // 64)
                children[child] = children.get(child, 0) + 1
        nodes, size, level = children, size // 64, level - 1
    return nodes, [node * 64 + draw(node, 0, t, min(64, n - node * 64)) for node, c in nodes.items() for t in range(c)]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 300, 4097])
def test_means_of_draws_match_plain_python(spark, n):
    rng = random.Random(n)
    values = [(i, rng.uniform(-1, 1), rng.randrange(1, 5)) for i in range(n)]
    got = {r.b: r.mean for r in evaluate.bootstrap_means(spark.createDataFrame(values, "i long, x double, w long"), 6).collect()}
    assert sorted(got) == list(range(6))
    for b in range(6):
        counts, units = tree_draws(n, b)
        assert sum(counts.values()) == n == len(units) and all(0 <= u < n for u in units)
        assert got[b] == pytest.approx(sum(values[u][1] for u in units) / sum(values[u][2] for u in units))


def test_draws_are_spread_as_they_should():
    """Over many rounds every unit is drawn once on average, with the variance of a multinomial, and blocks vary alike."""
    n, rounds = 200, 3000
    times = np.zeros((rounds, n))
    blocks = np.zeros((rounds, 4))
    for b in range(rounds):
        counts, units = tree_draws(n, b)
        times[b] = np.bincount(units, minlength=n)
        blocks[b] = [counts.get(k, 0) for k in range(4)]
    assert abs(times.mean(axis=0) - 1).max() < 0.1
    assert abs(times.var(axis=0).mean() - (1 - 1 / n)) < 0.03
    share = np.array([64, 64, 64, 8]) / n
    assert np.allclose(blocks.mean(axis=0), n * share, atol=0.6)
    assert np.allclose(blocks.var(axis=0), n * share * (1 - share), rtol=0.12)


def test_only_counts_move(spark):
    """What is shuffled of 20,000 units in 50 rounds: counts by round and block, never a row for each unit and round."""
    drawn = evaluate.block_draws(spark, 20_000, 50)
    assert drawn.count() <= 50 * (20_000 // 64 + 1)
    assert drawn.groupBy("b").agg(F.sum("c").alias("n")).select("n").distinct().collect()[0].n == 20_000
    assert evaluate.bootstrap_means(spark.createDataFrame([], "i long, x double, w long"), 5).count() == 0


def test_draws_are_not_broadcast(spark):
    """Ten thousand rounds are a few KB, their draws of each block many million rows."""
    values = spark.range(200).selectExpr("id as i", "cast(id as double) as x", "1 as w")
    assert "Broadcast" not in evaluate.bootstrap_means(values, 10_000)._jdf.queryExecution().executedPlan().toString()


WANTED = {"low": (0.0, "linear"), "q": (0.25, "linear"), "median": (0.5, "linear"), "p95": (0.95, "linear"), "p95_floor": (0.95, "floor"), "high": (1.0, "floor")}


def test_order_statistics_are_exact(spark):
    rng = random.Random(5)
    groups = {
        "one": [3.5],
        "two": [1.0, -2.0],
        "equal": [7.0] * 500,
        "even": [rng.uniform(-5, 5) for _ in range(1001)],
        "skewed": [10.0 ** rng.randrange(-9, 12) for _ in range(700)],
        "near": [1.0 + rng.randrange(50) * 1e-15 for _ in range(900)] + [1e9],
        "ties": [float(rng.randrange(4)) for _ in range(3000)],
        None: [rng.gauss(0, 1) for _ in range(64)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("even", float("nan")), ("nothing", None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "name string, v double").repartition(3)
    renamed = frame.withColumnsRenamed({"name": "kind", "v": "value"})
    for few in (200_000, 0):
        evaluate.BROADCAST_GROUPS, before = few, evaluate.BROADCAST_GROUPS
        try:
            got = {r.kind: r for r in evaluate.order_statistics(renamed, ["kind"], "value", WANTED).collect()}
        finally:
            evaluate.BROADCAST_GROUPS = before
        assert set(got) == set(groups)
        for g, vs in groups.items():
            for name, (share, rule) in WANTED.items():
                want = float(np.quantile(vs, share)) if rule == "linear" else sorted(vs)[int((len(vs) - 1) * share)]
                assert got[g][name] == pytest.approx(want, rel=1e-12), (g, name)


def test_a_group_of_many_values_isn_t_gathered(spark):
    frame = spark.range(2_000_000).select(F.lit("all").alias("kind"), ((F.col("id") * 7919) % 2_000_003).cast("double").alias("value"))
    found = evaluate.order_statistics(frame, ["kind"], "value", {"median": (0.5, "floor"), "p99": (0.99, "linear")})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "percentile" not in plan
    values = np.sort((np.arange(2_000_000) * 7919) % 2_000_003)
    row = found.first()
    assert row["median"] == values[(len(values) - 1) // 2] and row["p99"] == pytest.approx(np.quantile(values, 0.99))


def test_strict_pairs_fail_where_arms_differ(spark):
    frame = lambda rows: spark.createDataFrame(rows, "probe long, score double")
    a = frame([(1, 0.5), (2, 1.0), (3, None)])
    got = {r.probe: r.diff for r in evaluate.strictly_paired(a, frame([(2, 3.0), (1, 0.5), (3, 1.0)]), "probe", "score").collect()}
    assert got == {1: 0.0, 2: 2.0, 3: None}
    for other in ([(1, 0.5), (2, 1.0)], [(1, 0.5), (2, 1.0), (3, 1.0), (4, 1.0)], [(1, 0.5), (2, 1.0), (3, 1.0), (3, 1.0)]):
        with pytest.raises(Exception, match="not paired"):
            evaluate.strictly_paired(a, frame(other), "probe", "score").collect()
    row = evaluate.aa_control(a, frame([(1, 0.5), (2, 3.0), (3, None)]), "probe", "score").first()
    assert (row.n, row.differing, row.flat) == (3, 1, True)
