"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same real number of copies: the source's
target divided by its size.  The whole part is taken; the fractions are rounded
so that a source's words stay at its target.  Two fractional documents transfer
mass (words) at random until one fraction is 0 or 1, which leaves the sum and
each document's expectation as they are.  Fractions are combined in a tree: a
source's documents are dealt to groups of about ``fan_in`` by a hash, each group
leaves one residual, and residuals meet in groups of the next level.  A group
takes its documents by falling size, so that small ones settle the large ones;
the last fraction of a source is rounded to the nearer whole number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: Fractions this close to a whole number count as whole.
EPSILON = 1e-9


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``source, source_size, target`` for each source of ``sizes(source, size)``.

    Sources in code point order, null last, get the weights in turn and share all
    sizes by weight; a target stops at ``most`` times its source's size and the rest
    is shared anew.  The level at which weights fill up is found in one pass over
    the sources by their limit per weight, not by repeated resharing.
    """
    totals = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    # Windows without keys: these rows are one for each source, pre-aggregated.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    limited = totals.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    turn_to_fill = F.row_number().over(by_limit)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = limited.withColumn("level", level).withColumn("place", turn_to_fill)
    # The first source that isn't full at its level sets the level of all that follow, of equal limits too.
    water = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("place", "level"))).over(everything)["level"]
    return levelled.withColumn("water", water).select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("water") * F.col("weight"), F.col("limit"))).alias("target"))


def _uniform(*parts: Column | int) -> Column:
    """A number from [0, 1) that depends on the parts alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 11)
    return bits.cast("double") / float(1 << 53)


def _step(state: Column, x: Column, level: int, seed: int) -> Column:
    """One transfer between the residual ``state.rest`` and the next fraction ``x``."""
    a = state["rest"]
    mass_a, mass_b = a["size"].cast("double"), x["size"].cast("double")
    # Up: words move from x to the residual, as many as fill it or empty x.  Down: the other way.
    up = F.least((1 - a["p"]) * mass_a, x["p"] * mass_b)
    down = F.least(a["p"] * mass_a, (1 - x["p"]) * mass_b)
    goes_up = _uniform(a["h"], x["h"], level, seed + 1) * (up + down) < down
    moved = F.when(goes_up, up).otherwise(-down)
    to_a = F.when(goes_up & (up == (1 - a["p"]) * mass_a), 1.0).when(~goes_up & (down == a["p"] * mass_a), 0.0).otherwise(a["p"] + moved / mass_a)
    to_b = F.when(goes_up & (up == x["p"] * mass_b), 0.0).when(~goes_up & (down == (1 - x["p"]) * mass_b), 1.0).otherwise(x["p"] - moved / mass_b)

    def entry(e: Column, p: Column) -> Column:
        return F.struct(e["size"].alias("size"), e["h"].alias("h"), e["doc_id"].alias("doc_id"), e["text_hash"].alias("text_hash"), p.alias("p"))

    whole_a = (to_a <= EPSILON) | (to_a >= 1 - EPSILON)
    done = F.when(whole_a, entry(a, F.round(to_a))).otherwise(entry(x, F.round(to_b)))
    rest = F.when(whole_a, entry(x, to_b)).otherwise(entry(a, to_a))
    return F.when(a.isNull(), F.struct(x.alias("rest"), state["done"].alias("done"))).otherwise(F.struct(rest.alias("rest"), F.array_append(state["done"], done).alias("done")))


def _stepper(level: int, seed: int):
    return lambda state, x: _step(state, x, level, seed)


def mix(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    most: float = 3.0,
    seed: int = 17,
    fan_in: int = 128,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken, text_hash`` for each row.

    ``size`` counts a text's words (null: none); documents without words are taken
    ``floor`` of the source's copies times, which adds no word.  ``taken = copies *
    size``; the sum over a source is its target but for half a document.
    The same rows give the same result on every run: draws are hashes of id, text,
    seed and, for rows that repeat another one whole, a running number; which of
    these rows gets which copies is open.  Ties of size go by the draws' hash.  A
    null source is a source of its own, a null id one like any other.  A text longer
    than its source's target is taken a whole number of times, so that source may
    miss its target by half that text.  An empty table gives no rows.  Other columns
    are ignored.  ``text_hash`` is ``xxhash64`` of the text, null as empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text).alias("text_hash"),
    )
    # Equal rows are counted and numbered, so that each has draws, and a group, of its own.
    kinds = rows.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("n"))
    numbered = kinds.select("doc_id", "source", "size", "text_hash", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    rows = checkpointed(numbered.select("doc_id", "source", "size", "text_hash", F.xxhash64("doc_id", "text_hash", "k", F.lit(seed)).alias("h")))
    targets = source_targets(rows.select("source", "size"), weights, most)
    counts = rows.where("size > 0").groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "s")
    targets = checkpointed(targets.join(counts, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", F.coalesce("n", F.lit(0)).alias("n")))
    # One row for each source: Spark broadcasts it while it is small, and splits hot sources otherwise.
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    dealt = rows.join(targets, rows["source"].eqNullSafe(targets["s"])).drop("s").withColumn("ratio", ratio)
    dealt = dealt.withColumn("floor", F.floor(F.col("ratio") + EPSILON)).withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - F.col("floor")))

    keys = ["source", "source_size", "target", "floor"]
    whole = (F.col("p") <= EPSILON) | (F.col("size") == 0)
    settled = dealt.where(whole).select("doc_id", "text_hash", "size", *keys, F.lit(0.0).alias("p"))
    open_rows = dealt.where(~whole).select("doc_id", "text_hash", "size", *keys, "p", "h", F.ceil(F.col("n") / fan_in).alias("groups"))
    start = F.struct(F.lit(None).cast("struct<size:bigint,h:bigint,doc_id:bigint,text_hash:bigint,p:double>").alias("rest"), F.expr("cast(array() as array<struct<size:bigint,h:bigint,doc_id:bigint,text_hash:bigint,p:double>>)").alias("done"))
    level, parts = 0, [settled]
    while True:
        group = F.pmod(F.xxhash64("h", F.lit(level)), F.col("groups"))
        item = F.struct("size", "h", "doc_id", "text_hash", "p")
        folded = open_rows.groupBy(*keys, "groups", group.alias("group")).agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
        folded = checkpointed(folded.select(*keys, "groups", F.aggregate("items", start, _stepper(level, seed)).alias("out")).select(*keys, "groups", "out.rest", "out.done"))
        parts.append(folded.select(*keys, F.explode("done").alias("e")).select("e.doc_id", "e.text_hash", "e.size", *keys, "e.p"))
        if folded.where("groups > 1").isEmpty():
            last = folded.where("rest is not null").select("rest.doc_id", "rest.text_hash", "rest.size", *keys, F.round("rest.p").alias("p"))
            parts.append(last)
            break
        open_rows = folded.where("rest is not null").select("rest.doc_id", "rest.text_hash", "rest.size", *keys, "rest.p", "rest.h", F.ceil(F.col("groups") / fan_in).alias("groups"))
        level += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    copies = (F.col("floor") + F.round("p")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "text_hash")
