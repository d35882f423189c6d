"""Near-duplicate grouping by an inverted join on MinHash signature coordinates.

A document's signature has ``coordinates`` values; each (coordinate, value) pair
is a token that the document is posted under.  A pair of documents of the wanted
similarity shares about that share of its tokens, so pairs below a match
threshold (``deviations`` standard deviations under the mean) are dropped, and
the rest is confirmed on the full shingle sets.

* Tokens that only one document has can't collide: they go first, and with them
  every document that keeps fewer tokens than the threshold.
* Prefix: two documents that share ``t`` of their tokens share one among the
  ``size - t + 1`` rarest of either.  Only these are posted; the longest lists
  are skipped and met only when whole signatures are compared.
* Lists are split by set size, as sets whose sizes differ too much can't match.
* Groups of equal sets are one entry.  Each list first links its members with one
  pivot.  Members that stay outside the list's largest component are then described
  by their difference from the pivot's set.  Two such differences of small size are
  always near each other, so the member of the smallest difference links them like
  a hub, in a few rounds; pairs that remain must share elements of their
  differences and are joined on the rarest of them, prefixes again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.components import components
from memlake.llm.session import checkpointed, row_key
from memlake.llm.textscan import chunks, grams, long_lists, mix, multipliers, words

#: Most document ids that are broadcast (some 50 MB); beyond, the ids are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rounds in which lists are linked by hubs: they only spare work, what they leave is joined exactly.
HUB_ROUNDS = 4
#: Differences that one task takes: few of them take few tasks, as many tiny ones would leave many tiny files.
DELTAS_PER_TASK = 20_000


def _shingles(column: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each chunk: sizes of the documents' shingle sets, and their sorted distinct hashes."""
    for chunk in chunks(column):
        found = words(chunk)
        at, g = grams(found.doc, found.hash, n, short=True)
        doc = found.doc[at] if len(at) else np.zeros(0, np.int64)
        order = np.lexsort((g, doc))
        doc, g = doc[order], g[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        doc, g = doc[new], g[new]
        yield np.bincount(doc, minlength=len(chunk.bounds) - 1), g


def _sign(n: int, coordinates: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips, factors = multipliers(coordinates, 3), multipliers(coordinates, 5)
        for batch in batches:
            sizes, sums, folds, signatures = [], [], [], []
            for counts, g in _shingles(batch.column(2), n):
                some = np.flatnonzero(counts)
                firsts = np.r_[0, np.cumsum(counts[some])[:-1]] if len(some) else some
                signature = np.zeros((len(some), coordinates), np.uint64)
                a, b = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
                if len(some):
                    for k in range(coordinates):
                        signature[:, k] = np.minimum.reduceat((g ^ flips[k]) * factors[k], firsts)
                    signature = mix(signature + np.arange(coordinates, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    a[some] = np.add.reduceat(g, firsts)
                    b[some] = np.bitwise_xor.reduceat(mix(g + np.uint64(1)), firsts)
                sizes.append(counts)
                sums.append(a)
                folds.append(b)
                signatures.append((signature.ravel(), np.where(counts > 0, coordinates, 0)))
            if sizes:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(np.concatenate(sizes), pa.int64()),
                        pa.array(np.concatenate(sums).view(np.int64)),
                        pa.array(np.concatenate(folds).view(np.int64)),
                        long_lists(np.concatenate([s for s, _ in signatures]), np.concatenate([c for _, c in signatures])),
                    ],
                    ["doc_id", "id", "n_shingles", "set_sum", "set_fold", "tokens"],
                )

    return sign


def _sets(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for counts, g in _shingles(batch.column(1), n):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), long_lists(g, counts)], ["id", "shingles"])
                first += len(counts)

    return sets


def match_threshold(similarity: float, coordinates: int, deviations: float = 5.0) -> int:
    """Least number of equal coordinates: a pair of just this similarity has fewer with odds of about 1 in a million."""
    spread = math.sqrt(coordinates * similarity * (1 - similarity))
    return max(1, math.floor(coordinates * similarity - deviations * spread))


def _semi_by_id(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of ``ids(id)``, whose number is checked before it is broadcast."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``id, shingles`` of the documents of ``ids(id)``."""
    return checkpointed(_semi_by_id(docs, ids).mapInArrow(_sets(n), "id long, shingles array<long>").dropDuplicates(["id"]))


def _colliding(entries: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """``a, b, n_a, n_b`` of the pairs that share ``least`` tokens of their whole signatures."""
    tokens = entries.select("rep", "tokens", "n_shingles")
    joined = pairs.join(tokens.toDF("a", "tokens_a", "n_a"), "a").join(tokens.toDF("b", "tokens_b", "n_b"), "b")
    return checkpointed(joined.where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= least).select("a", "b", "n_a", "n_b"))


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of ``pairs(a, b, n_a, n_b)`` those with den * shared >= num * union on full sets."""
    joined = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return joined.withColumn("shared", shared).where(F.col("shared") * den >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * num).select("a", "b")


def _mixed(deltas: DataFrame, tasks: int) -> DataFrame:
    """The lists that have members of several roots, with the root that most of them have."""
    sizes = deltas.groupBy("pivot", "root").agg(F.count("*").alias("m")).coalesce(tasks)
    largest = sizes.groupBy("pivot").agg(F.max_by("root", F.struct("m", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1").drop("roots").coalesce(tasks)
    return deltas.join(largest, "pivot").coalesce(tasks)


def _apart(x: str, y: str) -> Column:
    """Size of the symmetric difference of two sets."""
    return F.size(x) + F.size(y) - 2 * F.size(F.array_intersect(x, y))


def _links_of_roots(deltas: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: roots that the links among the lists' members join.

    ``deltas(pivot, rep, root, n, delta)`` has the members of each list by their
    difference from its pivot.  Members x and y are linked if ``(den + num) * |x - y|
    <= (den - num) * (n_x + n_y)``, where x - y is the symmetric difference.  With
    ``gap = (den + num) * |delta| - (den - num) * n`` this is so whenever their gaps
    sum to 0 or less; then the member of the least gap is linked with both.  Other
    linked pairs share (gap_x + gap_y) / (2 * (den + num)) elements of their deltas.
    """
    tasks = max(1, math.ceil(deltas.count() / DELTAS_PER_TASK))
    gap = (den + num) * F.size("delta") - (den - num) * F.col("n")
    deltas = deltas.withColumn("gap", gap).coalesce(tasks)
    edges = deltas.select(F.col("root").alias("a"), F.col("root").alias("b")).limit(0)
    for turn in range(HUB_ROUNDS):
        current = checkpointed(_mixed(deltas, tasks))
        if current.isEmpty():
            return edges
        # Two hubs for each list: the member of the least gap of all, and of those outside the largest component.
        member = F.struct("rep", "root", "n", "delta")
        rank = F.struct("gap", F.xxhash64("rep", F.lit(turn)))
        hubs = current.groupBy("pivot").agg(F.min_by(member, rank).alias("first"), F.min_by(member, F.when(F.col("root") != F.col("largest"), F.struct(F.xxhash64("rep", F.lit(turn)) if turn % 2 else F.col("gap"), F.xxhash64("rep")))).alias("second"))
        tried = current.join(hubs.select("pivot", F.explode(F.array("first", "second")).alias("hub")), "pivot").where(F.col("root") != F.col("hub.root")).coalesce(tasks)
        linked = (den + num) * (F.size("delta") + F.size("hub.delta") - 2 * F.size(F.array_intersect("delta", F.col("hub.delta")))) <= (den - num) * (F.col("n") + F.col("hub.n"))
        more = checkpointed(tried.where(linked).select(F.greatest("root", "hub.root").alias("a"), F.least("root", "hub.root").alias("b")).distinct().coalesce(tasks))
        if more.isEmpty():
            break
        edges = edges.union(more)
        moved = components(more).toDF("root", "to")
        deltas = current.drop("largest").join(moved, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to").coalesce(tasks)
    current = _mixed(deltas, tasks).join(deltas.groupBy("pivot").agg(F.min("gap").alias("least_gap")).coalesce(tasks), "pivot").coalesce(tasks)
    shares = F.greatest(F.lit(1), F.ceil((F.col("gap") + F.col("least_gap")) / (2 * (den + num)))).cast("int")
    current = checkpointed(current.select("pivot", "rep", "root", "n", "delta", (F.col("root") != F.col("largest")).alias("outside"), shares.alias("shares")))
    # Elements that only members of one root have are in no intersection that counts.
    elements = current.select("pivot", "rep", "root", "shares", F.explode("delta").alias("element"))
    if current.isEmpty():
        return edges
    common = elements.groupBy("pivot", "element").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("pivot", "element", "m").coalesce(tasks)
    own = elements.join(common, ["pivot", "element"]).groupBy("pivot", "rep", "shares").agg(F.sort_array(F.collect_list(F.struct("m", "element"))).alias("own")).coalesce(tasks)
    own = own.where(F.size("own") >= F.col("shares")).select("pivot", "rep", F.slice("own", F.lit(1), F.size("own") - F.col("shares") + 1)["element"].alias("prefix"))
    posted = checkpointed(current.join(own, ["pivot", "rep"]).withColumn("element", F.explode("prefix")).drop("prefix", "shares").coalesce(tasks))
    x = posted.where("outside").select("pivot", "element", *[F.col(c).alias(f"{c}_x") for c in ("rep", "root", "n", "delta")])
    y = posted.select(F.col("pivot").alias("same_pivot"), F.col("element").alias("same_element"), "outside", *[F.col(c).alias(f"{c}_y") for c in ("rep", "root", "n", "delta")])
    room = (den - num) * (F.col("n_x") + F.col("n_y"))
    fits = (F.col("root_x") != F.col("root_y")) & (~F.col("outside") | (F.col("rep_x") < F.col("rep_y")))
    fits = fits & ((den + num) * F.abs(F.size("delta_x") - F.size("delta_y")) <= room) & ((den + num) * _apart("delta_x", "delta_y") <= room)
    more = x.join(y, (F.col("pivot") == F.col("same_pivot")) & (F.col("element") == F.col("same_element")) & fits)
    return edges.union(more.select(F.greatest("root_x", "root_y").alias("a"), F.least("root_x", "root_y").alias("b")).distinct().coalesce(tasks))


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    num: int = 4,
    den: int = 5,
    words_per_shingle: int = 5,
    coordinates: int = 64,
) -> DataFrame:
    """Groups of near-duplicates: ``doc_id, n_shingles, component_id, kept, row_key, group_key`` for each row.

    Two documents are linked if ``den * shared >= num * union`` of their sets of
    shingles (words split at ASCII white space, A-Z folded).  Fewer words than a
    shingle has: the whole sequence is one shingle.  Null, empty and blank texts
    have none and are linked with nothing.  ``component_id`` is the smallest id
    that can be reached.  Every row is a document: rows that repeat an id with its
    text have that document's result each, and an id with several texts has a
    result for each text.  A row without an id is linked by its text; it is kept
    only if no row of its group has an id, whose ``component_id`` is then null.
    ``group_key`` names the group (null for rows without shingles) and ``row_key``
    the row's id and text.  A text of any length is one set.  Other columns are
    ignored, whatever their names.
    """
    # Within, a document goes by its row key, as ids may be null or repeat.
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = checkpointed(docs.mapInArrow(_sign(words_per_shingle, coordinates), "doc_id long, id long, n_shingles long, set_sum long, set_fold long, tokens array<long>"))
    docs = docs.select("id", "text")
    key = ["n_shingles", "set_sum", "set_fold"]
    full = signed.where("n_shingles > 0").drop("doc_id")
    classes = checkpointed(signed.where("n_shingles > 0").groupBy(key).agg(F.min("id").alias("rep"), F.min("doc_id").alias("least_id")))
    # Of a class only one row brings its tokens along.
    entries = full.join(classes.select(*key, F.col("rep").alias("id")), [*key, "id"], "left_semi").dropDuplicates([*key, "id"])
    entries = entries.withColumnRenamed("id", "rep")
    least = match_threshold(num / den, coordinates)

    posted = entries.select("rep", F.explode("tokens").alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    rare_first = F.sort_array(F.collect_list(F.struct("n", "token")))
    prefixes = posted.join(shared, "token").groupBy("rep").agg(rare_first.alias("own")).where(F.size("own") >= least)
    prefixes = prefixes.select("rep", F.slice("own", F.lit(1), F.size("own") - (least - 1)).alias("own"))
    some = checkpointed(entries.join(prefixes, "rep").select("rep", "n_shingles", "tokens", F.col("own.token").alias("prefix")))
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(den / num)) if num < den else F.col("n_shingles")
    lists = checkpointed(
        some.withColumn("band", band.cast("long"))
        .select("rep", F.explode("prefix").alias("token"), "band")
        .select("rep", "token", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    )

    # A pivot for each list: the first of its members by a hash.  Members that share no list have no pair.
    pivots = lists.groupBy("token", "band").agg(F.min_by("rep", F.xxhash64("rep")).alias("pivot"), F.count("*").alias("n")).where("n > 1")
    first = lists.join(pivots, ["token", "band"]).where("rep <> pivot").select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b")).distinct()
    likely = _colliding(some, first, least)
    links = checkpointed(_confirmed(likely, _sets_of(docs, _members(likely), words_per_shingle), num, den))
    found = components(links)

    # What is left: pairs of a list in different components, one of them outside the list's largest.
    labelled = lists.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "token", "band", F.coalesce("root", "rep").alias("root"))
    labelled = checkpointed(labelled)
    sizes = labelled.groupBy("token", "band", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("token", "band").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    open_lists = labelled.join(mixed, ["token", "band"])
    open_lists = checkpointed(open_lists.join(pivots.drop("n"), ["token", "band"]))
    needed = open_lists.select(F.explode(F.array("rep", "pivot")).alias("id")).distinct()
    sets = _sets_of(docs, needed, words_per_shingle)
    # Shingles that no other of these documents has are in no intersection, which bounds the size of a partner.
    shingles = sets.select(F.col("id").alias("rep"), F.explode("shingles").alias("shingle"))
    common = shingles.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    bounds = shingles.join(common, "shingle", "left_semi").groupBy("rep").agg(F.count("*").alias("c"))
    bounds = bounds.join(entries.select("rep", "n_shingles"), "rep").select("rep", F.col("n_shingles").alias("n"), (F.floor(F.col("c") * (num + den) / num) - F.col("n_shingles")).alias("reach"))
    open_lists = open_lists.join(checkpointed(bounds.where("reach >= 1")), "rep")
    smallest = open_lists.groupBy("token", "band").agg(F.min("n").alias("smallest"))
    open_lists = open_lists.join(smallest, ["token", "band"]).where(F.col("reach") >= F.greatest(F.col("smallest"), F.ceil(F.col("n") * num / den)))
    # Members of a list are described by their differences from its pivot's set, which has met them all.
    attached = open_lists.where("rep <> pivot").select("pivot", "rep", "root", "n").distinct()
    deltas = attached.join(sets.toDF("rep", "own"), "rep").join(sets.toDF("pivot", "others"), "pivot")
    delta = F.concat(F.array_except("own", "others"), F.array_except("others", "own"))
    deltas = checkpointed(deltas.select("pivot", "rep", "root", "n", delta.alias("delta")))
    found = components(found.toDF("a", "b").union(_links_of_roots(deltas, num, den)))

    # The roots are no nodes of their own.
    linked = classes.join(found.union(found.select("root", "root").distinct()).toDF("rep", "root"), "rep")
    reached = linked.groupBy("root").agg(F.min("least_id").alias("least_id"))
    linked = linked.select("rep", "root").join(reached, "root")
    roots = classes.join(linked.toDF("root", "rep", "least_linked"), "rep", "left")
    roots = roots.select(*key, F.coalesce("root", "rep").alias("group_key"), F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("least_linked")).alias("least_id"))
    joined = signed.join(roots, key, "left")
    component = F.when(F.col("group_key").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.col("id").alias("row_key"), "group_key")
