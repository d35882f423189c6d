"""Versions of slots that span tasks, and walks over typed edges, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from memlake.operators import facts, graph, sweep

FACTS = "slot string, area int, valid_from long, fact_id long, value string"


def versions(seed=3):
    """A third of all versions in one slot; equal times, a null slot, slots of one version."""
    rng = random.Random(seed)
    slots = ["hot"] * 10 + [None] + [f"s{k}" for k in range(19)]
    return [((s := rng.choice(slots)), 1 if s == "hot" else rng.randrange(2), rng.randrange(200), i, f"v{i}") for i in range(900)]


@pytest.mark.parametrize("most_rows", [0, 10**9])
def test_intervals_of_a_hot_slot(spark, most_rows):
    rows = versions()
    got = facts.version_intervals(spark.createDataFrame(rows, FACTS).repartition(3), ["slot", "area"], most_rows=most_rows)
    assert got.columns == ["slot", "area", "valid_from", "fact_id", "value", "valid_to", "version"]
    want = set()
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: r[2:4])
        want |= {(*r, own[k + 1][2] if k + 1 < len(own) else None, k + 1) for k, r in enumerate(own)}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("most_rows", [0, 10**9])
def test_as_of_in_a_hot_slot(spark, most_rows):
    rows = versions(4)
    rng = random.Random(5)
    probes = [(rng.choice(["hot", "hot", "s1", "s2", "nowhere", None]), 1, rng.randrange(-5, 210), k) for k in range(400)]
    asked = spark.createDataFrame(probes, "slot string, area int, as_of long, probe long")
    got = facts.as_of(asked, spark.createDataFrame(rows, FACTS), ["slot", "area"], most_rows=most_rows)
    want = set()
    for p in probes:
        held = max((r for r in rows if r[:2] == p[:2] and r[2] <= p[2]), key=lambda r: r[2:4], default=(None,) * 5)
        want.add((*p, *held[2:]))
    assert {tuple(r) for r in got.select("slot", "area", "as_of", "probe", "valid_from", "fact_id", "value").collect()} == want


def test_a_hot_slot_spreads_over_parts(spark):
    rows = spark.createDataFrame(versions(), FACTS)
    parts = sweep.dealt(rows, ["slot"], ["valid_from", "fact_id"])
    of_hot = parts.where("slot = 'hot'").groupBy("_part").count().collect()
    assert len(of_hot) > 1 and max(r["count"] for r in of_hot) < 300
    assert sweep.crossing(parts, ["slot"], F.count("*").alias("n")).count() <= 2 * parts.select("_part").distinct().count()
    assert sweep.largest_slot(rows.limit(0), ["slot"]) == 0


def walk(edges, seeds, hops, weight, types):
    out, frontier = dict.fromkeys(seeds, 0), set(seeds)
    for hop in range(1, hops + 1):
        frontier = {b for a, b, w, t in edges if a in frontier and w >= weight and (types is None or t in types)} - set(out)
        out |= dict.fromkeys(frontier, hop)
    return out


def test_walks_over_typed_edges(spark):
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.random(), rng.choice("abc")) for _ in range(120)]
    frame = spark.createDataFrame(edges, "source string, target string, weight double, edge_type string")
    seeds = spark.createDataFrame([("n1",), ("n2",), ("n1",)], "node string")
    for hops, weight, types in ((0, 0.0, None), (2, 0.0, None), (4, 0.3, ("a", "b")), (9, 0.0, ("c",)), (3, 1.0, None), (2, 0.0, ())):
        got = graph.reach(frame, seeds, hops, weight, types)
        assert {r.node: r.hops for r in got.collect()} == walk(edges, ["n1", "n2"], hops, weight, types)
        # The result reads what the hops wrote: its plan has one scan and no join.
        assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    for bad in ({"min_weight": 1.5}, {"min_weight": -0.1}, {"max_hops": -1}):
        with pytest.raises(ValueError):
            graph.reach(frame, seeds, **bad)
