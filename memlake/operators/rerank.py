"""Scores and order of recalled rows: vectors, hybrid weights, quality, floors, budgets, greedy folds."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sources of distilled and of raw memories, and their factors.
DISTILLED = ("preference", "correction", "fact", "identity", "insight", "sleep_consolidation")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def vector_topk(vectors: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
    """The ``k`` vectors with the highest cosine to one query vector."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", F.round(cosine(F.col("embedding"), wanted), 6))
    return scored.orderBy(F.desc_nulls_last("score"), F.asc("vec_id")).limit(k)


#: Query vectors of a block, and products that are held at once.
QUERY_BLOCK, PRODUCTS = 1024, 500_000


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; NaN for rows without a length."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have ``width`` numbers, none of them null, and their places."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    fit = np.flatnonzero(sizes == width)
    flat = column.take(pa.array(fit)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(fit), width), fit


def _best(wanted, k: int, digits: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = wanted.value
        step = max(1, PRODUCTS // len(ids))
        # What is held: the query's number, the vector's id and the score of each query's best so far.
        rows, names, held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor = np.full(len(ids), -1.5)
        for batch in batches:
            # A few rows at a time, so that no batch is a matrix of doubles as a whole.
            for at in range(0, len(batch), step):
                piece = batch.slice(at, step)
                vectors, fit = _matrix(piece.column(1), queries.shape[1])
                scores = np.round(queries @ _unit(vectors).T, digits)
                # A vector without a length has no score and reaches no floor.
                least = floor if scores.shape[1] < k else np.maximum(floor, np.partition(np.nan_to_num(scores, nan=-2.0), -k, axis=1)[:, -k])
                query, place = np.nonzero(scores >= least[:, None])
                rows, names, held = np.append(rows, query), np.append(names, np.asarray(piece.column(0))[fit][place]), np.append(held, scores[query, place])
                order = np.lexsort((names, -held, rows))
                rows, names, held = rows[order], names[order], held[order]
                first = np.searchsorted(rows, np.arange(len(ids)))
                kept = np.arange(len(rows)) - first[rows] < k
                rows, names, held = rows[kept], names[kept], held[kept]
                full = np.bincount(rows, minlength=len(ids)) == k
                floor[full] = held[np.searchsorted(rows, np.flatnonzero(full), "right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(names), pa.array(held)], ["query_id", "vec_id", "score"])
        pa.default_memory_pool().release_unused()

    return best


def _query_blocks(asked: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the queries, ``QUERY_BLOCK`` of one width at a time; they come to the driver block by block."""
    held: dict[int, list] = {}

    def block(rows: list) -> tuple[np.ndarray, np.ndarray]:
        matrix = _unit(np.array([r["embedding"] for r in rows]))
        usable = ~np.isnan(matrix).any(axis=1)
        return np.array([r["query_id"] for r in rows], np.int64)[usable], matrix[usable]

    for row in asked.toLocalIterator():
        own = held.setdefault(len(row["embedding"]), [])
        own.append(row)
        if len(own) == QUERY_BLOCK:
            yield block(held.pop(len(row["embedding"])))
    yield from (b for b in map(block, held.values()) if len(b[0]))


def vector_topk_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, digits: int = 5) -> DataFrame:
    """``query_id, vec_id, score, rank``: the ``k`` vectors of the highest cosine to each of ``queries(query_id, embedding)``.

    Queries go to the vectors in blocks of ``QUERY_BLOCK`` as a matrix; a task
    multiplies its vectors with it a slice at a time and keeps the best of each query,
    so a pair of vectors is never a row.  Scores are rounded, and of equal ones the
    smaller id comes first.  Vectors without length, with nulls, or of another width
    than the query's are in no result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and not exists(embedding, x -> x is null)")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("size(embedding) > 0 and not exists(embedding, x -> x is null)")
    parts = []
    for block in _query_blocks(asked):
        sent = spark.sparkContext.broadcast(block)
        parts.append(rows.mapInArrow(_best(sent, k, digits), "query_id long, vec_id long, score double"))
    if not parts:
        return rows.select(F.lit(0).cast("long").alias("query_id"), "vec_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    best = reduce(DataFrame.unionByName, parts)
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def decay(age_hours: Column, half_life: float) -> Column:
    return F.exp(-math.log(2) * age_hours / half_life)


def hybrid(vec: Column, fts: Column, importance: Column, recency: Column, weights: Sequence[float] = (0.5, 0.3, 0.2), floor: float = 0.7) -> Column:
    """Weighted signals, scaled by recency down to ``floor``: this library's own composition."""
    base = weights[0] * F.coalesce(vec, F.lit(0.0)) + weights[1] * F.coalesce(fts, F.lit(0.0)) + weights[2] * F.coalesce(importance, F.lit(0.0))
    return base * (floor + (1 - floor) * recency)


def source_quality(content: Column, source: Column, raw: Sequence[str] = ("conversation",), include_raw_tools: bool = False) -> Column:
    """Usefulness factor of a memory's source and label; 0 for transcripts of the assistant and, unless wanted, of tools."""
    upper, low = F.upper(F.trim(content)), F.lower(source)
    label = F.when(F.startswith(upper, F.lit("[USER]")), 0.68).when(F.startswith(upper, F.lit("[IDENTITY]")), 0.80).when(F.startswith(low, F.lit("memoria_source")), 0.90).otherwise(1.0)
    factor = F.when(low.isin(*DISTILLED), 1.12).otherwise(1.0) * F.when(low.isin(*raw), 0.72).otherwise(1.0) * label
    hidden = F.startswith(upper, F.lit("[ASSISTANT]"))
    if not include_raw_tools:
        hidden = hidden | low.isin("conversation_tool", "conversation_delegation")
    return F.when(hidden, 0.0).otherwise(factor)


def adjusted(score: Column, signal: Column, importance: Column, quality: Column) -> Column:
    return (0.65 * score + 0.35 * signal + 0.05 * F.least(F.greatest(importance, F.lit(0.0)), F.lit(1.0))) * quality


def budget_blocks(lines: DataFrame, key: str, order: list[str], budget: int) -> DataFrame:
    """Lines of each key in order while their characters, and a break after each, stay in the budget."""
    running = F.sum(F.length("line") + 1).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("used", running).where(F.col("used") - 1 <= budget)


def collapse_near_duplicates(rows: DataFrame, jaccard: float = 0.72, containment: float = 0.86) -> DataFrame:
    """Rows of each query that resemble no kept earlier one; rows without tokens go.

    Greedy by rank, so sequential within a query; ``rows(query_id, id, rank, tokens)``
    are a query's candidates, a few dozen at most, folded in one row.
    """
    own = F.sort_array(F.collect_list(F.struct("rank", "id", F.array_distinct("tokens").alias("tokens"))))

    def alike(a: Column, b: Column) -> Column:
        shared, n, m = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
        return (shared / (n + m - shared) >= jaccard) | (shared / F.least(n, m) >= containment)

    def keep(kept: Column, row: Column) -> Column:
        fresh = (F.size(row["tokens"]) > 0) & ~F.exists(kept, lambda k: alike(row["tokens"], k["tokens"]))
        return F.when(fresh, F.array_append(kept, row)).otherwise(kept)

    grouped = rows.groupBy("query_id").agg(own.alias("own"))
    kept = grouped.select("query_id", F.explode(F.aggregate("own", F.filter("own", lambda _: F.lit(False)), keep)).alias("k"))
    return kept.select("query_id", "k.id", "k.rank")


def coverage_rerank(rows: DataFrame, k: int = 5, least_words: int = 4) -> DataFrame:
    """``query_id, id, position``: the ``k`` rows of each query, those first that add most of its words.

    ``rows(query_id, id, rank, words, hits)``: ``words`` is the number of the query's
    words, ``hits`` are those that the row has.  A query of fewer than ``least_words``
    words, or with no more than ``k`` rows, keeps the order of its rows.  A query's
    candidates, a few dozen, are folded in one row; of rows that add alike the first counts.
    """
    own = F.sort_array(F.collect_list(F.struct("rank", "id", "hits")))
    grouped = rows.groupBy("query_id").agg(F.max("words").alias("words"), own.alias("own"))

    def pick(state: Column, _: Column) -> Column:
        gains = F.transform(state["left"], lambda r: F.struct((-F.size(F.array_except(r["hits"], state["covered"]))).alias("less"), r.alias("row")))
        best = F.array_min(gains)["row"]
        left = F.filter(state["left"], lambda r: (r["rank"] != best["rank"]) | (r["id"] != best["id"]))
        return F.struct(left.alias("left"), F.array_union(state["covered"], best["hits"]).alias("covered"), F.array_append(state["out"], best["id"]).alias("out"))

    start = F.struct(F.col("own").alias("left"), F.expr("cast(array() as array<string>)").alias("covered"), F.expr("cast(array() as array<bigint>)").alias("out"))
    greedy = F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, pick)["out"]
    order = F.when((F.col("words") >= least_words) & (F.size("own") > k), greedy).otherwise(F.slice(F.col("own.id"), 1, k))
    return grouped.select("query_id", F.posexplode(order).alias("at", "id")).select("query_id", "id", (F.col("at") + 1).cast("long").alias("position"))
