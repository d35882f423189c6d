"""Versioned facts: intervals, as-of lookup, triples, canonical slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators import sweep


def version_intervals(facts: DataFrame, slot: list[str], at: str = "valid_from", tie: str = "fact_id", most_rows: int | None = None) -> DataFrame:
    """Each version of a slot with ``valid_to``, the next one's start; null while it holds.

    A slot of more than ``most_rows`` versions spreads over tasks by ranges of time:
    the last version of a part takes the first start of the next one, and versions
    are numbered on from those of the parts before.
    """
    order = Window.partitionBy(*slot).orderBy(at, tie)
    if sweep.largest_slot(facts, slot) <= (sweep.MOST_ROWS if most_rows is None else most_rows):
        return facts.withColumn("valid_to", F.lead(at).over(order)).withColumn("version", F.row_number().over(order).cast("long"))
    parts = sweep.dealt(facts, slot, [at, tie])
    within = Window.partitionBy("_part", *slot).orderBy(at, tie)
    own = parts.withColumn("valid_to", F.lead(at).over(within)).withColumn("version", F.row_number().over(within).cast("long")).withColumn("_last", F.lead(tie).over(within).isNull() & F.col("valid_to").isNull())
    each = Window.partitionBy(*slot).orderBy("_part")
    ends = sweep.crossing(parts, slot, F.min_by(at, F.struct(at, tie)).alias("_first"), F.count("*").alias("_n"))
    ends = ends.select(*slot, "_part", F.lead("_first").over(each).alias("_next"), F.coalesce(F.sum("_n").over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    met = sweep.handed(own, ends, slot)
    met = met.withColumn("valid_to", F.when(F.col("_last"), F.col("_next")).otherwise(F.col("valid_to"))).withColumn("version", F.col("version") + F.coalesce("_before", F.lit(0)))
    return met.select(*facts.columns, "valid_to", "version")


def holds_at(moment: Column | str) -> Column:
    """Half-open interval; a null end is open."""
    t = F.col(moment) if isinstance(moment, str) else moment
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


def as_of(probes: DataFrame, facts: DataFrame, slot: list[str], moment: str = "as_of", at: str = "valid_from", tie: str = "fact_id", most_rows: int | None = None) -> DataFrame:
    """For each probe the version of its slot that held at its moment, if any.

    Probes and versions of a slot are merged and sorted, and a probe takes the last
    version before it: one shuffle by slot and no range join, so a slot with many
    versions doesn't multiply its probes.  A slot of more than ``most_rows`` probes
    and versions spreads over tasks by ranges of time, and the last version of a part
    is carried over to those behind it.
    """
    names = [c for c in facts.columns if c not in slot]
    left = probes.select(*slot, F.col(moment).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), F.struct(*[c for c in probes.columns if c not in slot]).alias("_probe"))
    right = facts.select(*slot, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), F.struct(*names).alias("_fact"))
    both = left.unionByName(right, allowMissingColumns=True)
    keys = ["_t", "_side", "_tie"]
    out = [*slot, "_probe.*", *[F.col(f"_fact.{c}").alias(c) for c in names]]
    until = lambda *by: Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    if sweep.largest_slot(both, slot) <= (sweep.MOST_ROWS if most_rows is None else most_rows):
        return both.withColumn("_fact", F.last("_fact", ignorenulls=True).over(until(*slot))).where("_side = 1").select(*out)
    parts = sweep.dealt(both, slot, keys)
    own = parts.withColumn("_fact", F.last("_fact", ignorenulls=True).over(until("_part", *slot))).where("_side = 1")
    last = sweep.crossing(parts, slot, F.max_by("_fact", F.when(F.col("_side") == 0, F.struct(*keys))).alias("_own"))
    before = Window.partitionBy(*slot).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*slot, "_part", F.last("_own", ignorenulls=True).over(before).alias("_carried"))
    return sweep.handed(own, carried, slot).withColumn("_fact", F.coalesce("_fact", "_carried")).select(*out)


def is_current(now: Column) -> Column:
    return (F.col("valid_until").isNull() | (F.col("valid_until") > now)) & F.col("superseded_by").isNull()


def match_triples(triples: DataFrame, subject: str | None = None, predicate: str | None = None, object_: str | None = None, moment: Column | None = None) -> DataFrame:
    """Triples that agree with every bound part and hold at the moment, if one is given."""
    out = triples
    for name, value in (("subject", subject), ("predicate", predicate), ("object", object_)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out.where(holds_at(moment)) if moment is not None else out
