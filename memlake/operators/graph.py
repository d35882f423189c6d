"""Graphs and entities: reachability, relation expansion, lineage, fuzzy names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import one_edit, one_edit_keys, similarity
from memlake.sources.tables import shared_folder


def reach(edges: DataFrame, seeds: DataFrame, max_hops: int = 2, min_weight: float = 0.0, edge_types: Sequence[str] | None = None) -> DataFrame:
    """``node, hops``: nodes within ``max_hops`` of the seeds along ``edges(source, target, weight, edge_type)``, by their shortest way.

    Only edges of the given types (all, if none are given) and of ``min_weight``, 0 to
    1, or more count; ``edge_type`` may be missing where no types are given.  Breadth
    first: each hop reads what the last one found, and only that, from the shared
    folder, joins it with the edges and drops the nodes of the hops before.
    """
    if not 0 <= min_weight <= 1:
        raise ValueError("min_weight must be 0 to 1")
    if max_hops < 0:
        raise ValueError("max_hops must not be negative")
    usable = edges.where(F.col("weight") >= min_weight)
    if edge_types is not None:
        usable = usable.where(F.col("edge_type").isin(*edge_types))
    usable = usable.select("source", "target")
    spark = edges.sparkSession
    folder = shared_folder(spark, "reach")
    seeds.select("node").dropna().distinct().write.parquet(f"{folder}/hops=0")
    for hop in range(1, max_hops + 1):
        frontier = spark.read.parquet(f"{folder}/hops={hop - 1}")
        found = usable.join(frontier, usable["source"] == frontier["node"], "left_semi").select(F.col("target").alias("node")).dropna().distinct()
        seen = spark.read.parquet(*[f"{folder}/hops={h}" for h in range(hop)])
        found.join(seen, "node", "left_anti").write.parquet(f"{folder}/hops={hop}")
        if spark.read.parquet(f"{folder}/hops={hop}").isEmpty():
            break
    return spark.read.parquet(folder).select("node", F.col("hops").cast("int").alias("hops"))


def expand_relations(results: DataFrame, relations: DataFrame, excluded: DataFrame) -> DataFrame:
    """Results of kind relation give way to their participants, but for the excluded ones."""
    parts = results.where("kind = 'relation'").join(relations, "id").select("query_id", F.explode("participants").alias("id"))
    others = results.where("kind <> 'relation'").select("query_id", "id")
    return others.union(parts).distinct().join(excluded, "id", "left_anti")


def visible_lineage(summaries: DataFrame, visible_ids: DataFrame) -> DataFrame:
    """Of each summary's sources those that can be seen, in order, and whether any was lost."""
    sources = summaries.select("id", F.size("summary_of").alias("_n"), F.posexplode("summary_of").alias("at", "source"))
    seen = sources.join(visible_ids.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    kept = seen.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "source"))).alias("s"))
    kept = kept.select("id", F.transform("s", lambda e: e["source"]).alias("sources"))
    return summaries.select("id", F.size("summary_of").alias("_n")).join(kept, "id", "left").select(
        "id", F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"), (F.coalesce(F.size("sources"), F.lit(0)) < F.col("_n")).alias("lost")
    )


def collapse_lineage(results: DataFrame) -> DataFrame:
    """Results without degraded copies whose parent is among the same query's results."""
    parents = results.select("query_id", F.col("id").alias("degraded_from")).distinct()
    return results.join(parents, ["query_id", "degraded_from"], "left_anti")


def _grams(name: Column, size: int) -> Column:
    """Runs of ``size`` letters in their order, for pairs with marks at both ends."""
    padded = F.concat(F.lit("\u0002"), name, F.lit("\u0003")) if size == 2 else name
    n = F.length(padded) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(padded, i, F.lit(size)))).otherwise(F.expr("cast(array() as array<string>)"))


def edit_candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` of ``left(a)`` and ``right(b)``: names that may differ in a share of ``1 - threshold`` of the longer one's letters.

    A name of n letters has n + 1 pairs of neighbours with its ends; an edit changes
    two of them, so a partner has ``n + 1 - 2 * (1 - threshold) * n`` of them, too.
    Below a threshold of a half this is nothing, and single letters stand in, of which
    an edit changes one.  Of the pairs that the edits leave, the rarest is among each
    name's rarest ones, those but for so many that the rest are too few, and edits move
    it by no more places than their number: only names that have such a pair at such
    places meet, if their lengths allow it.  Nothing is lost at any threshold.
    """
    size = 2 if threshold >= 0.5 else 1
    least = lambda n: F.ceil((n + 1 if size == 2 else n) - size * (1 - threshold) * n - 1e-9)
    sides = left.select(F.col("a").alias("name")).union(right.select("b")).distinct()
    tokens = sides.select("name", F.posexplode(_grams(F.col("name"), size)).alias("place", "gram"))
    counts = tokens.groupBy("gram").agg(F.count("*").alias("n"))
    ranked = tokens.join(counts, "gram").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("n", "gram", "place"))).alias("own"))
    n = F.length("name")
    last = F.element_at("own", F.greatest(F.lit(1), F.least(F.size("own"), F.size("own") - least(n) + 1)).cast("int"))
    # All places of the last kind of pair stay: any of them may be the one that the edits leave.
    prefix = F.filter("own", lambda e: F.struct(e["n"], e["gram"]) <= F.struct(last["n"], last["gram"]))
    kept = ranked.select("name", n.alias("size"), F.explode(prefix).alias("e")).select("name", "size", "e.gram", "e.place")
    x, y = kept.join(left.select(F.col("a").alias("name")), "name", "left_semi"), kept.join(right.select(F.col("b").alias("name")), "name", "left_semi")
    x, y = (side.select(F.col("name").alias(c), F.col("size").alias(f"n_{c}"), "gram", F.col("place").alias(f"at_{c}")) for side, c in ((x, "a"), (y, "b")))
    # Few bytes make many pairs: as many tasks as a shuffle has, not as few as the bytes would fill.
    parts = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = x.repartition(parts, "gram").join(y.repartition(parts, "gram"), "gram")
    longer = F.greatest("n_a", "n_b")
    fits = (F.least("n_a", "n_b") >= threshold * longer - 1e-9) & (F.abs(F.col("at_a") - F.col("at_b")) <= (1 - threshold) * longer + 1e-6)
    return met.where(fits).select("a", "b").distinct()


def prefix_candidates(left: DataFrame, right: DataFrame, least_ratio: float) -> DataFrame:
    """``a, b`` where one name begins with the other and the lengths' ratio is ``least_ratio`` or more."""
    first = F.greatest(F.lit(0), F.ceil(F.lit(least_ratio) * F.length("name") - 1e-9)).cast("int")
    heads = lambda side, name: side.select(F.col(name).alias("name")).select("name", F.explode(F.transform(F.sequence(first, F.length("name")), lambda i: F.substring(F.col("name"), F.lit(1), i))).alias("head"))
    longer_a = heads(left, "a").join(right, F.col("head") == F.col("b")).select(F.col("name").alias("a"), "b")
    longer_b = heads(right, "b").join(left, F.col("head") == F.col("a")).select("a", F.col("name").alias("b"))
    return longer_a.union(longer_b)


def inner_candidates(left: DataFrame, right: DataFrame, least_ratio: float) -> DataFrame:
    """``a, b`` where one name may hold the other: it has the other's rarest pair of letters, or its letter; the empty name is in all."""

    def pieces(name: Column) -> Column:
        pairs = F.when(F.length(name) > 1, F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substring(name, i, F.lit(2))))
        return F.array_distinct(F.concat(F.coalesce(pairs, F.expr("cast(array() as array<string>)")), F.split(name, ""), F.array(F.lit(""))))

    names = left.select(F.col("a").alias("name")).union(right.select("b")).distinct()
    all_pieces = names.select("name", F.explode(pieces(F.col("name"))).alias("piece"))
    counts = all_pieces.groupBy("piece").agg(F.count("*").alias("n"))
    own = all_pieces.where(F.length("piece") == F.least(F.length("name"), F.lit(2))).join(counts, "piece").groupBy("name").agg(F.min(F.struct("n", "piece"))["piece"].alias("piece"))
    held = own.select(F.col("name").alias("short"), "piece").join(all_pieces.select(F.col("name").alias("long"), "piece"), "piece")
    held = held.where((F.length("short") >= least_ratio * F.length("long") - 1e-9) & F.contains("long", F.col("short"))).select("short", "long")
    a_short = held.toDF("a", "b").join(left, "a", "left_semi").join(right, "b", "left_semi")
    b_short = held.toDF("b", "a").join(left, "a", "left_semi").join(right, "b", "left_semi")
    return a_short.select("a", "b").union(b_short.select("a", "b"))


def fuzzy_candidates(candidates: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: the pairs of distinct names that ``fuzzy_matches`` compares."""
    left, right = candidates.select(F.col("name").alias("a")).dropna().distinct(), known.select(F.col("name").alias("b")).dropna().distinct()
    met = edit_candidates(left, right, threshold).union(prefix_candidates(left, right, (threshold - 0.7) / 0.3))
    if threshold <= 0.8:
        met = met.union(inner_candidates(left, right, (threshold - 0.5) / 0.3))
    return met.distinct()


def fuzzy_matches(candidates: DataFrame, known: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``a, b, similarity``: pairs of names at least ``threshold`` alike (more than 0, 1 at most), null names aside.

    Distinct names meet by rare pairs of letters, by being the beginning of the other,
    or by what one holds of the other, never each with each.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be more than 0, and 1 at most")
    met = fuzzy_candidates(candidates, known, threshold)
    return met.withColumn("similarity", F.round(similarity(F.col("a"), F.col("b")), 6)).where(F.col("similarity") >= threshold)


def one_edit_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """``a, b``: names that are equal less one letter each at most, and begin with the same two letters in some order."""
    l, r = left.select(F.col("name").alias("a")).distinct(), right.select(F.col("name").alias("b")).distinct()  # noqa: E741
    keys = lambda side, name: side.select(name, F.explode(one_edit_keys(F.col(name))).alias("key"))
    return keys(l, "a").join(keys(r, "b"), "key").select("a", "b").distinct()


def one_edit_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of names at most one edit apart, by an index of the names less one letter."""
    return one_edit_candidates(left, right).where(one_edit(F.col("a"), F.col("b")))
