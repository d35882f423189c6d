"""Evaluation: grades, summaries, paired comparison, retention, resampling, planning."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.operators import sweep

# Acklam's coefficients of the inverse normal distribution.
ACKLAM_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
ACKLAM_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
ACKLAM_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
ACKLAM_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def inverse_normal(p: Column) -> Column:
    """The standard normal's quantile (Acklam); null outside of 0 < p < 1."""
    tail = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    outer = _polynomial(tail, ACKLAM_C) / _polynomial(tail, (*ACKLAM_D, 1.0))
    q = p - 0.5
    middle = _polynomial(q * q, ACKLAM_A) * q / _polynomial(q * q, (*ACKLAM_B, 1.0))
    value = F.when(p < 0.02425, outer).when(p > 1 - 0.02425, -outer).otherwise(middle)
    return F.when((p > 0) & (p < 1), value)


def paired_mde(n: Column, sd: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Least paired difference that n pairs detect."""
    return (inverse_normal(F.lit(1 - alpha / 2)) + inverse_normal(F.lit(power))) * sd / F.sqrt(n)


def sample_size(effect: Column, sd: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    z = inverse_normal(F.lit(1 - alpha / 2)) + inverse_normal(F.lit(power))
    return F.greatest(F.lit(2), F.ceil(F.pow(z * sd / effect, F.lit(2.0)))).cast("long")


def surface_summary(grades: DataFrame) -> DataFrame:
    """Counts and rates of each surface from ``grades(surface, kind, answer_hit, returned_rows, stale_first, expired)``."""
    answerable, fabricated = F.col("kind") == "answerable", F.col("kind") == "fabricated"
    rate = lambda hit, of: F.round(F.try_divide(F.count_if(hit & of).cast("double"), F.count_if(of).cast("double")), 6)
    return grades.groupBy("surface").agg(
        F.count("*").alias("probes"),
        F.count_if(answerable).alias("answerable"),
        rate(F.col("answer_hit"), answerable).alias("answer_recall"),
        F.count_if(fabricated & (F.col("returned_rows") > 0)).alias("fabricated_with_rows"),
        F.count_if(F.col("stale_first")).alias("stale_above_current"),
        F.sum("expired").alias("expired_served"),
    )


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """``key, a, b, diff`` of both arms' common probes."""
    left, right = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    return left.join(right, key).withColumn("diff", F.col("b") - F.col("a"))


def strictly_paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """``paired`` of arms that must have the same probes, each once: a probe that only one arm has, or that one has twice, fails the job."""
    left, right = a.groupBy(key).agg(F.count("*").alias("n_a"), F.first(value).alias("a")), b.groupBy(key).agg(F.count("*").alias("n_b"), F.first(value).alias("b"))
    met = left.join(right, key, "full_outer")
    fine = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    sure = F.when(F.coalesce(fine, F.lit(False)), F.col("b") - F.col("a")).otherwise(F.raise_error(F.concat(F.lit("not paired: "), F.col(key).cast("string"))).cast("double"))
    return met.select(key, "a", "b", sure.alias("diff"))


def aa_control(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """``n, differing, flat``: whether two runs that should be alike differ on no more than a hundredth of the probes, or on one."""
    counted = strictly_paired(a, b, key, value).agg(F.count("*").alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b")) | (F.col("diff") != 0)).alias("differing"))
    return counted.withColumn("flat", F.col("differing") <= F.greatest(F.lit(1.0), F.col("n") / 100))


def exact_share(a: Column, b: Column) -> Column:
    """Share of pairs with equal values; null without pairs."""
    return F.round(F.avg(a.eqNullSafe(b).cast("double")), 6)


def unpaired_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one arm has; a strict comparison wants none."""
    left, right = a.select(key, F.lit(True).alias("in_a")), b.select(key, F.lit(True).alias("in_b"))
    return left.join(right, key, "full_outer").where("in_a is null or in_b is null").select(key)


def stage_of(rows: DataFrame, by: str, at: str, stages: int = 4) -> DataFrame:
    """``stage`` 0 .. stages - 1 by rank of the distinct times; equal times stay together."""
    rank = F.dense_rank().over(Window.partitionBy(by).orderBy(at)) - 1
    ranked = rows.withColumn("_r", rank)
    n = F.max("_r").over(Window.partitionBy(by)) + 1
    return ranked.withColumn("stage", F.floor(F.col("_r") * stages / n).cast("int")).drop("_r")


def retention_matrix(grades: DataFrame, stages: int = 4) -> DataFrame:
    """Recall of each cohort at each stage; null where a cell has no probe."""
    return grades.groupBy("stage").pivot("cohort", list(range(stages))).agg(F.round(F.avg(F.col("hit").cast("double")), 6))


def backward_transfer(grades: DataFrame, last: int = 3) -> DataFrame:
    """For each life: mean of the final hit less the hit when the cohort was first probed."""
    first = grades.where("stage = cohort").select("life_id", "probe_id", F.col("hit").cast("int").alias("then"))
    final = grades.where(F.col("stage") == last).select("life_id", "probe_id", F.col("hit").cast("int").alias("now"))
    return first.join(final, ["life_id", "probe_id"]).groupBy("life_id").agg(F.round(F.avg(F.col("now") - F.col("then")), 6).alias("transfer"), F.count("*").alias("probes"))


#: Children of a node in the tree of blocks, and units of a block.
FAN = 64
_PRIME = 2_147_483_647


def draw(b: Column, node: Column, level: int, t: Column, width: Column) -> Column:
    """A number 0 .. width - 1 for draw ``t`` of a node in round ``b``, in whole numbers below 2^63: the same on every engine."""
    z1 = (b * 48271 + node * 16807 + (level + 1)) % _PRIME
    z2 = (z1 * z1 + t * 69621 + 11) % _PRIME
    z3 = (z2 * 48271 + z1) % _PRIME
    z4 = (z3 * z3 + 7) % _PRIME
    z5 = (z4 * 69621 + z2) % _PRIME
    return (z5 * _PRIME + z4) % width


def block_draws(spark: SparkSession, n: int, rounds: int) -> DataFrame:
    """``b, node, c``: how many of round b's n draws fall into each block of ``FAN`` of n units.

    Draws go down a tree: a node of a range of units deals its draws to its ``FAN``
    children, each by the share of units that it has, so a round's counts are
    multinomial.  A node's draws are counted where they are made: between tasks only
    counts by round and child move.
    """
    size, level = FAN, 0
    while size < n:
        size, level = size * FAN, level + 1
    nodes = spark.range(rounds).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("node"), F.lit(n).cast("long").alias("c"))
    while size > FAN:
        width = F.least(F.lit(size), F.lit(n) - F.col("node") * size)
        drawn = nodes.select("b", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("t"))
        child = F.expr(f"(node * {size} + u) div {size // FAN}")
        nodes = drawn.withColumn("u", draw(F.col("b"), F.col("node"), level, F.col("t"), width)).select("b", child.alias("node")).groupBy("b", "node").agg(F.count("*").alias("c"))
        size, level = size // FAN, level - 1
    return nodes


def bootstrap_means(values: DataFrame, rounds: int) -> DataFrame:
    """``b, mean`` of resampled ``values(i, x, w)``: ``i`` counts from 0, ``w`` observations sum to ``x``.

    Every round draws as many units as there are.  ``block_draws`` says how many fall
    into each block of units; a block makes its draws itself and adds up its own sums,
    so no row of a unit and a round ever moves.  Spark judges the draws by the few rounds
    that they are made from; they are never broadcast.
    """
    n = values.count()
    if n == 0:
        return values.select(F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("mean")).limit(0)
    blocks = values.groupBy(F.expr(f"i div {FAN}").alias("node")).agg(F.sort_array(F.collect_list(F.struct("i", "x", "w"))).alias("own"))
    drawn = block_draws(values.sparkSession, n, rounds).hint("merge").join(blocks, "node").select("b", "node", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("t"))
    unit = F.element_at("own", (draw(F.col("b"), F.col("node"), 0, F.col("t"), F.size("own").cast("long")) + 1).cast("int"))
    units = drawn.select("b", unit.alias("u"))
    return units.groupBy("b").agg((F.sum("u.x") / F.sum("u.w")).alias("mean"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """The rows with ``i``, counted from 0 in the order of the key: parts are numbered by themselves, then moved by those before."""
    parts = sweep.dealt(rows, [key], [])
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"))
    # One row for each part.
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    placed = parts.withColumn("_own", own).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return placed.withColumn("i", (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


def interval(means: DataFrame, observed: DataFrame) -> DataFrame:
    """The 2.5 % and 97.5 % percentiles (linear), whether they leave out 0, the mean, and the share of rounds on the other side of 0.

    ``observed(mean)`` is one row, the mean of the values themselves.
    """
    low, high = F.percentile("mean", 0.025), F.percentile("mean", 0.975)
    joined = means.crossJoin(F.broadcast(observed.select(F.col("mean").alias("seen"))))
    other = F.when(F.col("seen") > 0, F.col("mean") <= 0).otherwise(F.col("mean") >= 0)
    return joined.groupBy("seen").agg(low.alias("low"), high.alias("high"), F.count("*").alias("rounds"), F.avg(other.cast("double")).alias("other")).select(
        F.round("seen", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), ((F.col("low") > 0) | (F.col("high") < 0)).alias("excludes_zero"), F.round("other", 6).alias("other_side"), "rounds"
    )


def mean_of(values: DataFrame) -> DataFrame:
    return values.agg((F.sum("x") / F.sum("w")).alias("mean"))


#: Buckets of a histogram, passes of refining, and groups whose limits are broadcast (a few dozen bytes each).
BUCKETS, PASSES, BROADCAST_GROUPS = 1024, 2, 200_000


def _place(share: float, rule: str) -> tuple[Column, Column]:
    """Whole place and rest of the way from it, counted from 0, of a share of ``n`` sorted values."""
    at = (F.col("n") - 1) * F.lit(share)
    below = F.floor(at).cast("long")
    return below, (at - below if rule == "linear" else F.lit(0.0))


def order_statistics(rows: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, tuple[float, str]]) -> DataFrame:
    """For each group exact percentiles, ``wanted`` by name as (share, rule).

    The rule ``linear`` weighs the two values beside the place ``(n - 1) * share``,
    ``floor`` takes the one at the whole place below.  Null and NaN values are left
    out; a group without others has no row.  A histogram between a group's least and
    greatest value shows in which bucket a place lies, a second one divides that
    bucket, and the few values left are counted.  Histograms are added up where the
    rows are: no group's values are gathered, however many or equal they are.
    """
    names = list(by)
    by, outer = [f"g{k}" for k in range(len(names))], [f"t{k}" for k in range(len(names))]
    own = rows.select(*[F.col(c).alias(g) for c, g in zip(names, by, strict=True)], F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    groups = own.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = []
    for name, (share, rule) in wanted.items():
        below, rest = _place(share, rule)
        asked.append(F.struct(F.lit(name).alias("name"), below.alias("place"), F.lit(0).alias("side"), rest.alias("rest")))
        if rule == "linear":
            asked.append(F.struct(F.lit(name).alias("name"), F.least(below + 1, F.col("n") - 1).alias("place"), F.lit(1).alias("side"), rest.alias("rest")))
    targets = groups.select(*by, "lo", "hi", F.explode(F.array(*asked)).alias("a")).select(*by, "a.*", "lo", "hi")
    key = [*by, "name", "side"]
    few = groups.count() <= BROADCAST_GROUPS

    def within(limits: DataFrame) -> DataFrame:
        side = limits.withColumnsRenamed(dict(zip(by, outer, strict=True)))
        side = F.broadcast(side) if few else side
        same = reduce(and_, [F.col(g).eqNullSafe(F.col(t)) for g, t in zip(by, outer, strict=True)], F.lit(True))
        return own.join(side, same & F.col("v").between(F.col("lo"), F.col("hi"))).drop(*outer)

    for _ in range(PASSES):
        bucket = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(0)
        counts = within(targets).groupBy(*key, "place", "rest", bucket.alias("bucket")).agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        targets = _holding(counts, key, "bucket").select(*key, "place", "rest", "lo", "hi")
    counts = within(targets).groupBy(*key, "place", "rest", "v").agg(F.count("*").alias("m"))
    found = _holding(counts, key, "v").groupBy(*by, "name").agg(F.max("rest").alias("rest"), *[F.max(F.when(F.col("side") == k, F.col("v"))).alias(f"v{k}") for k in (0, 1)])
    exact = found.withColumn("v", F.col("v0") + F.when(F.col("rest") > 0, F.col("rest") * (F.col("v1") - F.col("v0"))).otherwise(0.0))
    exact = exact.select(*[F.col(g).alias(c) for c, g in zip(names, by, strict=True)], F.col("name").alias("_name"), F.col("v").alias("_v"))
    return exact.groupBy(*names).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in wanted])


def _holding(counts: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Of each target's buckets the one that its place is in, the place counted from there."""
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("before", before).where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("m")))
    return placed.withColumn("place", F.col("place") - F.col("before"))


def holm(tests: DataFrame) -> DataFrame:
    """Holm's adjusted p of ``tests(name, p)``: the running maximum of p times the tests left, 1 at most."""
    # One row for each test of a family, a handful: their order needs one window.
    order = Window.orderBy("p", "name")
    ranked = tests.withColumn("_k", F.row_number().over(order)).withColumn("_m", F.count("*").over(Window.partitionBy()))
    step = F.least(F.lit(1.0), F.col("p") * (F.col("_m") - F.col("_k") + 1))
    return ranked.withColumn("adjusted", F.round(F.max(step).over(order.rowsBetween(Window.unboundedPreceding, 0)), 6)).drop("_k", "_m")


def set_grades(cases: DataFrame) -> DataFrame:
    """Missing, forbidden and extra ids of ``cases(id, expected, allowed, forbidden, got)``, precision and recall."""
    hit = F.size(F.array_intersect("got", "expected"))
    return cases.select(
        "id",
        F.size(F.array_except("expected", "got")).alias("missing"),
        F.size(F.array_intersect("got", "forbidden")).alias("forbidden"),
        F.size(F.array_except("got", F.array_union("expected", "allowed"))).alias("extra"),
        F.round(F.try_divide(hit.cast("double"), F.size("got").cast("double")), 6).alias("precision"),
        F.round(F.try_divide(hit.cast("double"), F.size("expected").cast("double")), 6).alias("recall"),
    )


def normal_power(n: int, effect: float, alpha: float = 0.05) -> float:
    """Chance that a paired test finds the effect (unit deviation)."""
    from statistics import NormalDist

    return NormalDist().cdf(effect * math.sqrt(n) - NormalDist().inv_cdf(1 - alpha / 2))
