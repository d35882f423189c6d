"""Keyword retrieval: phrases, BM25, filters, literal search, batched top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.text import ascii_lower, tokens
from memlake.sources.tables import shared_folder

#: BM25 constants of the usual full-text engines, and the least weight of a common term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def phrases(query: str) -> list[list[str]]:
    """The query's white-space separated words as token phrases; words without a letter or digit are dropped."""
    import re

    from memlake.functions.text import ACCENTED, PLAIN

    table = str.maketrans(dict(zip(ACCENTED, PLAIN)) | dict.fromkeys(ACCENTED[len(PLAIN) :], ""))
    found = [re.findall(r"[^\W_]+", word.lower().translate(table)) for word in query.split()]
    return [p for p in found if p]


#: Ids that share a block of postings, and tokens whose postings are made at once in a task.
BLOCK_IDS, RUN_TOKENS = 128, 1_000_000
#: Words of all queries that are sent to every task; more meet the index by a shuffle.
BROADCAST_WORDS = 100_000
#: Weights of terms and texts that a task adds up at once.
PRODUCTS = 4_000_000
#: Scores are rounded to six digits: bounds leave this much room.
ROOM = 1e-5


class Index(NamedTuple):
    """The written index.

    ``blocks(term, block, n, tf_most, dl_least, tf_best, dl_best, ids, dls, tfs,
    positions)``: a term's postings of the ids of one block as parallel arrays, and what
    bounds them; a text's positions follow those of the texts before it.  A row without a
    term has the lengths of a block's texts.  ``terms(term, df)``: the texts of a term.
    ``corpus(n, avgdl)``: one row.
    """

    blocks: DataFrame
    terms: DataFrame
    corpus: DataFrame

    @property
    def bounds(self) -> DataFrame:
        """``term, block, n, top, held``: what no factor of frequency and length in a block exceeds, and one that a text of it has."""
        rows = self.blocks.where("term is not null").crossJoin(F.broadcast(self.corpus.select("avgdl")))
        top, held = (frequency_factor(F.col(f"tf_{a}"), F.col(f"dl_{b}"), F.col("avgdl")) for a, b in (("most", "least"), ("best", "best")))
        return rows.select("term", "block", "n", top.alias("top"), held.alias("held"))

    @property
    def postings(self) -> DataFrame:
        """``term, id, dl, tf``, a row for each text of a term."""
        return self.blocks.where("term is not null").select("term", F.explode(_zipped()).alias("e")).select("term", "e.*")

    @property
    def placed(self) -> DataFrame:
        """``term, id, dl, positions``."""
        before = F.transform("tfs", lambda _, i: F.aggregate(F.slice("tfs", F.lit(1), i), F.lit(0), lambda n, tf: n + tf))
        own = F.transform(F.arrays_zip(F.col("ids").alias("id"), F.col("dls").alias("dl"), "tfs", before.alias("before")), lambda e: F.struct(e["id"].alias("id"), e["dl"].alias("dl"), F.slice("positions", e["before"] + 1, e["tfs"]).alias("positions")))
        return self.blocks.where("term is not null").select("term", F.explode(own).alias("e")).select("term", "e.*")


def _zipped() -> Column:
    return F.arrays_zip(F.col("ids").alias("id"), F.col("dls").alias("dl"), F.col("tfs").alias("tf"))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that tell the values of a column apart, nulls from all others."""
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _postings(rows: pa.Table) -> pa.RecordBatch:
    """Texts that are sorted by block and id as ``term, block, entries``, sorted by term; a null term has their lengths."""
    ids, blocks, lists = (rows.column(c).combine_chunks() for c in ("id", "block", "t"))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32)
    in_block, id_codes = _codes(blocks), _codes(ids)
    # Rows of one id and length count as one text, as do their tokens.
    begins = np.zeros(len(sizes), np.int64)
    begins[_starts(in_block, id_codes)] = 1
    by = np.lexsort((sizes, np.cumsum(begins)))
    firsts = _starts(in_block[by], id_codes[by], sizes[by])
    text_of = np.empty(len(sizes), np.int64)
    text_of[by] = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(by))))
    row_of_text = by[firsts]
    words = lists.flatten().dictionary_encode()
    order = pc.array_sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = (np.arange(1, len(words) + 1) - np.repeat(ends - sizes, sizes)).astype(np.int32)
    term, text = rank[words.indices.to_numpy()], np.repeat(text_of, sizes)
    # The rows of the null term come first: one position, zero, for each text.
    term = np.concatenate([np.zeros(len(firsts), np.int64), term])
    text, at = np.concatenate([np.arange(len(firsts)), text]), np.concatenate([np.zeros(len(firsts), np.int32), at])
    key = term * len(firsts) + text
    sort = np.argsort(key, kind="stable") if len(firsts) == len(sizes) else np.lexsort((at, key))
    key, at = key[sort], at[sort]
    entries = _starts(key)
    term, text = key[entries] // len(firsts), key[entries] % len(firsts)
    row = row_of_text[text]
    groups = _starts(term, in_block[row])
    tf, dl = np.diff(np.append(entries, len(key))).astype(np.int32), sizes[row]
    n = np.diff(np.append(groups, len(entries))).astype(np.int32)
    # Any text of a block is a bound from below; the one that is best by these texts' mean length is close to the best.
    factor = tf / (tf + K1 * (1 - B + B * dl / max(1.0, float(sizes.mean()))))
    of = np.repeat(np.arange(len(groups)), n)
    best = np.flatnonzero(factor == np.maximum.reduceat(factor, groups)[of])
    best = best[_starts(of[best])]
    which, cuts = term[groups], np.append(groups, len(entries)).astype(np.int32)
    names = words.dictionary.take(pa.array(order[np.maximum(which - 1, 0)], mask=which == 0)) if len(order) else pa.nulls(len(groups), pa.string())
    lists = [(cuts, ids.take(pa.array(row))), (cuts, pa.array(dl)), (cuts, pa.array(tf)), (np.append(entries[groups], len(key)).astype(np.int32), pa.array(at))]
    figures = [n, np.maximum.reduceat(tf, groups), np.minimum.reduceat(dl, groups), tf[best], dl[best]]
    columns = [names.cast(pa.string()), blocks.take(pa.array(row[groups])), *map(pa.array, figures), *[pa.ListArray.from_arrays(pa.array(o), v) for o, v in lists]]
    return pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "tf_most", "dl_least", "tf_best", "dl_best", "ids", "dls", "tfs", "positions"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of texts that come sorted by block and id, made for about ``RUN_TOKENS`` tokens at a time.

    A run ends with a block, or within a block of more tokens than that with an id: a
    block in two parts has two bounds, and both hold.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        first, total = 0, sum(len(b.column(2).flatten()) for b in held)
        ends = total + np.cumsum(pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
        while first < len(batch):
            last = min(len(batch), max(first, int(np.searchsorted(ends, RUN_TOKENS))) + 1)
            held.append(batch.slice(first, last - first))
            if ends[last - 1] < RUN_TOKENS:
                break
            rows = pa.Table.from_batches(held)
            marks = [_starts(_codes(rows.column("block").combine_chunks()))[1:], _starts(_codes(rows.column("id").combine_chunks()))[1:]]
            cut = next((int(m[-1]) for m in marks if len(m)), len(rows))
            yield from _pieces(_postings(rows.slice(0, cut)))
            held = rows.slice(cut).to_batches()
            ends = ends - ends[last - 1] + sum(len(b.column(2).flatten()) for b in held)
            first = last
    if sum(map(len, held)):
        yield from _pieces(_postings(pa.Table.from_batches(held)))
    pa.default_memory_pool().release_unused()


def _pieces(rows: pa.RecordBatch, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    for first in range(0, len(rows), most):
        yield rows.slice(first, most)


def build_index(memories: DataFrame, folder: str) -> Index:
    """Tokenise the memories once and write their postings in blocks of ids, with the blocks' bounds.

    The texts are dealt by block, whole: a block's texts meet in one task, are tokenised
    there and become its postings at once, so no row for each token ever moves.  A row
    without a term has the lengths of a block's texts.
    """
    spark = memories.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = memories.select("id", F.floor(F.col("id") / BLOCK_IDS).alias("block"), "content").repartition(parts, "block").sortWithinPartitions("block", "id")
    kinds = dealt.schema
    own = dealt.select("id", "block", tokens("content").alias("t"))
    kind = f"term string, block {kinds['block'].dataType.simpleString()}, n int, tf_most int, dl_least int, tf_best int, dl_best int, ids array<{kinds['id'].dataType.simpleString()}>, dls array<int>, tfs array<int>, positions array<int>"
    # Runs are sorted by term: a query's terms select a few pages of each.
    own.mapInArrow(_posted, kind).write.mode("overwrite").parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    lengths = blocks.where("term is null").select(F.explode("dls").alias("dl"))
    lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{folder}/corpus")
    blocks.where("term is not null").groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{folder}/terms")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> Index:
    """An index that was written before."""
    return Index(*[spark.read.parquet(f"{folder}/{name}") for name in ("blocks", "terms", "corpus")])


def _phrase_frequency(places: list[Column]) -> Column:
    """How often the phrase's tokens follow each other, from each token's positions in a text."""
    hits = places[0]
    for j, other in enumerate(places[1:], 1):
        hits = F.array_intersect(hits, F.transform(other, _less(j)))
    return F.size(hits)


def _less(j: int) -> Callable[[Column], Column]:
    return lambda p: p - j


def rarity(df: Column, n: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def frequency_factor(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25_weight(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column) -> Column:
    return rarity(df, n) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def score(index: Index, query: str) -> DataFrame:
    """``id, score`` of the texts that have every phrase of the query, by BM25.

    Only the postings of the query's tokens are read; the corpus figures are one row
    and are broadcast.  A query without letters or digits matches nothing.
    """
    wanted = phrases(query)
    words = sorted({t for p in wanted for t in p})
    if not wanted:
        return index.postings.where(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    fs = [f"f{i}" for i in range(len(wanted))]
    if all(len(p) == 1 for p in wanted):
        # Without phrases frequencies are enough, and the texts of a term are known: no position is read.
        tfs = [F.max(F.when(F.col("term") == p[0], F.col("tf"))).alias(f) for f, p in zip(fs, wanted)]
        counted = index.postings.where(F.col("term").isin(words)).groupBy("id", "dl").agg(*tfs)
        known = index.terms.where(F.col("term").isin(words)).agg(*[F.max(F.when(F.col("term") == p[0], F.col("df"))).alias(f"d{f}") for f, p in zip(fs, wanted)])
        return _weighed(counted, known.crossJoin(F.broadcast(index.corpus)), fs)
    found = index.placed.where(F.col("term").isin(words))
    places = [F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{k}") for k, w in enumerate(words)]
    rows = found.groupBy("id", "dl").agg(*places)
    counted = rows.select("id", "dl", *[F.coalesce(_phrase_frequency([F.col(f"p{words.index(t)}") for t in p]), F.lit(0)).alias(f"f{i}") for i, p in enumerate(wanted)])
    known = counted.agg(*[F.count_if(F.col(f) > 0).alias(f"d{f}") for f in fs]).crossJoin(F.broadcast(index.corpus))
    return _weighed(counted, known, fs)


def _weighed(counted: DataFrame, known: DataFrame, fs: list[str]) -> DataFrame:
    """``id, score`` of the texts that have all phrases; ``known`` is one row."""
    total = F.lit(0.0)
    fits = F.lit(True)
    for f in fs:
        fits = fits & (F.col(f) > 0)
        total = total + bm25_weight(F.col(f), F.col(f"d{f}"), F.col("n"), F.col("dl"), F.col("avgdl"))
    return counted.where(fits).crossJoin(F.broadcast(known)).select("id", total.alias("score"))


def recall(memories: DataFrame, index: Index, query: str, k: int = 10, namespace: str | None = None, min_importance: int | None = None) -> DataFrame:
    """Top ``k`` (1 to 100) by score, importance, recency and id; literal search if the query has no token.

    Ranking reads narrow columns; the texts of the k rows join at the end.
    """
    k = max(1, min(100, k))
    narrow = memories.drop("content")
    hits = narrow.join(score(index, query), "id") if phrases(query) else literal(memories, query).drop("content").withColumn("score", F.lit(0.0))
    hits = hits.where(predicate(namespace, min_importance)).withColumn("score", F.round("score", 6))
    best = hits.orderBy(F.desc("score"), F.desc("importance"), F.desc("created_at"), F.asc("id")).limit(k)
    return best.join(memories.select("id", "content"), "id").orderBy(F.desc("score"), F.desc("importance"), F.desc("created_at"), F.asc("id"))


def accesses(hits: DataFrame, at: Column) -> DataFrame:
    """``ids, at``: a row for each query of ``hits(query_id, id)``, the texts that it was answered with and when.

    It is what ``store.fold_accesses`` takes; a query without hits touches nothing.
    """
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.max(at).alias("at")).select("ids", "at")


def recall_recorded(memories: DataFrame, index: Index, query: str, at: float, log: str, k: int = 10, namespace: str | None = None, min_importance: int | None = None) -> DataFrame:
    """``recall``, which also appends to the folder ``log`` that its rows were accessed at a time.

    An empty query is refused.  The answer is at most 100 rows; they are written
    first, so that the rows that are returned and those that are counted are the same.
    """
    if not query.strip():
        raise ValueError("query must not be empty")
    hits = recall(memories, index, query, k, namespace, min_importance)
    spark = memories.sparkSession
    rows = spark.createDataFrame(hits.toArrow()) if not hits.isEmpty() else hits
    accesses(rows.select(F.lit(0).alias("query_id"), "id"), F.lit(float(at))).write.mode("append").parquet(log)
    return rows


def predicate(namespace: str | None, min_importance: int | None) -> Column:
    """The filter that recall and count share; an empty namespace is none."""
    out = F.lit(True)
    if namespace:
        out = out & (F.col("namespace") == namespace)
    if min_importance is not None:
        out = out & (F.col("importance") >= min_importance)
    return out


def literal(memories: DataFrame, query: str) -> DataFrame:
    """Memories whose text has the query as it is, but for the case of A-Z."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in query)
    return memories.where(F.contains(ascii_lower("content"), F.lit(low)))


def count_matching(memories: DataFrame, index: Index, query: str, namespace: str | None = None, min_importance: int | None = None) -> DataFrame:
    hits = memories.join(score(index, query).select("id"), "id", "left_semi") if phrases(query) else literal(memories, query)
    return hits.where(predicate(namespace, min_importance)).agg(F.count("*").alias("n"))


def fallback_terms(text: Column | str, most: int = 8) -> Column:
    """The first distinct words of four or more letters, lower case."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0))), 1, most)


class Bounded(NamedTuple):
    """The steps of a pruned recall: query terms, blocks that may hold a result, and its candidates."""

    wanted: DataFrame
    live: DataFrame
    partial: DataFrame


def bounded(index: Index, queries: DataFrame, k: int) -> Bounded:
    """What can be among the ``k`` best texts of each query, by the bounds of terms and blocks.

    The k-th best block of a term holds a text with at least the block's greatest
    weight, so the best such weight of a query's terms is a floor: no result scores
    less.  Terms that together can't reach the floor bring in no text by themselves
    and aren't ``essential``: a term that all texts have usually is none of these.  A
    block is live if its essential terms' bounds and all of what the other terms may
    add reach the floor, and only live blocks are read for essential terms.  Texts
    are dropped once more by their own weights.
    """
    asked = _asked(queries)
    send = _sender(asked)
    corpus = F.broadcast(index.corpus)
    bounds = index.bounds.join(send(asked.select("term").distinct()), "term", "left_semi")
    # A term's k-th best block, by the k best of each part of its blocks: a term of very many blocks isn't one task's.
    part, whole = (Window.partitionBy("term", *salt).orderBy(F.desc("held")) for salt in ([F.pmod("block", F.lit(64))], []))
    some = bounds.select("term", "held", F.row_number().over(part).alias("r")).where(F.col("r") <= k)
    kth = some.select("term", "held", F.row_number().over(whole).alias("r")).where(F.col("r") == k).select("term", F.col("held").alias("kth"))
    of = bounds.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("most")).join(kth, "term", "left")
    known = asked.join(of, "term").crossJoin(corpus).withColumn("idf", rarity(F.col("df"), F.col("n")))
    known = known.select("query_id", "term", "idf", "avgdl", (F.col("idf") * F.col("most")).alias("most"), (F.col("idf") * F.col("kth")).alias("kth"))
    each = Window.partitionBy("query_id")
    known = known.withColumn("floor", F.coalesce(F.max("kth").over(each), F.lit(0.0)) - ROOM)
    rising = F.sum("most").over(each.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    known = known.withColumn("essential", rising >= F.col("floor"))
    known = known.withColumn("others", F.sum(F.when(~F.col("essential"), F.col("most")).otherwise(0.0)).over(each)).drop("most", "kth")
    essential = send(known.where("essential"))
    reach = bounds.join(essential, "term").groupBy("query_id", "block", "floor", "others").agg(F.sum(F.col("idf") * F.col("top")).alias("top"))
    live = reach.where(F.col("top") + F.col("others") >= F.col("floor")).select("query_id", "block")
    posted = index.blocks.where("term is not null").select("term", "block", "ids", "dls", "tfs")
    read = posted.join(essential, "term").join(live, ["query_id", "block"]).select("query_id", "block", "idf", "avgdl", "floor", "others", F.explode(_zipped()).alias("e"))
    weight = F.col("idf") * frequency_factor(F.col("e.tf"), F.col("e.dl"), F.col("avgdl"))
    partial = read.groupBy("query_id", "block", F.col("e.id").alias("id"), F.col("e.dl").alias("dl"), "floor", "others").agg(F.sum(weight).alias("own"))
    return Bounded(known, live, partial.where(F.col("own") + F.col("others") >= F.col("floor")))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))


def _narrowed(index: Index, asked: DataFrame) -> Index:
    """The postings of the queries' words alone, written once and read by every step; the index itself if these are many."""
    if asked.limit(BROADCAST_WORDS + 1).count() > BROADCAST_WORDS:
        return index
    own = index.blocks.drop("positions").join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    folder = shared_folder(asked.sparkSession, "words")
    own.write.parquet(folder)
    blocks = asked.sparkSession.read.parquet(folder)
    return Index(blocks, blocks.groupBy("term").agg(F.sum("n").alias("df")), index.corpus)


def _added(index: Index, texts: DataFrame, others: DataFrame, send: Callable[[DataFrame], DataFrame], *keep: str) -> DataFrame:
    """``query_id, id, score, found``: what ``texts(query_id, block, id, own)`` score with the other terms of their queries, and how many terms they have.

    A text asks for each term's postings of its block; what it has itself goes along
    as a row without a term.
    """
    blocks = index.blocks.where("term is not null").select("term", "block", "ids", "dls", "tfs").join(send(others.select("term").distinct()), "term", "left_semi")
    listed = others.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf", "avgdl", F.lit(0.0).alias("own"))).alias("more"))
    none = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("idf"), F.lit(1.0).alias("avgdl"), F.col("own"))
    rows = texts.join(send(listed), "query_id", "left").select("query_id", "block", "id", *keep, F.explode(F.when(F.col("more").isNull(), F.array(none)).otherwise(F.concat(F.array(none), F.col("more")))).alias("m"))
    met = rows.select("query_id", "block", "id", *keep, "m.*").join(blocks, ["term", "block"], "left").withColumn("place", F.coalesce(F.array_position("ids", F.col("id")), F.lit(0)).cast("int"))
    tf, dl = (F.try_element_at(c, F.nullif("place", F.lit(0))) for c in ("tfs", "dls"))
    has = F.col("term").isNull() | (F.col("place") > 0)
    weight = F.col("own") + F.coalesce(F.col("idf") * frequency_factor(tf, dl, F.col("avgdl")), F.lit(0.0))
    return met.groupBy("query_id", "id", *keep).agg(F.sum(weight).alias("score"), F.count_if(has).alias("found"))


def _sender(asked: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Broadcasts what has a row for each of the queries' words, if these are few."""
    return F.broadcast if asked.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else lambda rows: rows


class Sent(NamedTuple):
    """The queries as tasks get them: their ids, pairs of query and term by number (in order of both), each term's rarity, the texts' mean length."""

    ids: pa.Array
    query: np.ndarray
    term: np.ndarray
    idf: np.ndarray
    avgdl: float


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, which come sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cuts = [*_starts(np.asarray(batch.column("block"))), len(batch)] if len(batch) else []
        for first, last in zip(cuts, cuts[1:]):
            if held and held[-1].column("block")[-1] != batch.column("block")[first]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(first, last - first))
    if held:
        yield pa.Table.from_batches(held)


def _weights(rows: pa.Table, sent: Sent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids, its terms, and what each term (a row) weighs in each id's texts."""
    term, lists = np.asarray(rows.column("t")), rows.column("ids").combine_chunks()
    flat = [np.asarray(rows.column(c).combine_chunks().flatten()) for c in ("ids", "dls", "tfs")]
    ids, text = np.unique(flat[0], return_inverse=True)
    terms, row = np.unique(term, return_inverse=True)
    row = np.repeat(row, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    weight = sent.idf[terms[row]] * (flat[2] * (K1 + 1) / (flat[2] + K1 * (1 - B + B * flat[1] / sent.avgdl)))
    return ids, terms, np.bincount(row * len(ids) + text, weight, len(terms) * len(ids)).reshape(len(terms), len(ids))


def _best_texts(broadcast: Any, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``k`` best texts that a task has for each query.

    A block is scored for the queries whose terms' greatest weights in it together reach
    the k-th best score so far; what a query then keeps of a block are its k best and
    what ties with these.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: Sent = broadcast.value
        rows, names, held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        floor, place = np.full(len(sent.ids), -1.0), np.full(len(sent.idf), -1)
        new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settle() -> None:
            nonlocal rows, names, held
            rows, names, held = (np.concatenate([own, *more]) for own, more in zip((rows, names, held), zip(*new)))
            new.clear()
            order = np.lexsort((names, -held, rows))
            order = order[np.arange(len(order)) - np.searchsorted(rows[order], np.arange(len(floor)))[rows[order]] < k]
            rows, names, held = rows[order], names[order], held[order]
            full = np.bincount(rows, minlength=len(floor)) == k
            floor[full] = held[np.searchsorted(rows, np.flatnonzero(full), "right") - 1]

        for block in _blocks_of(batches):
            ids, terms, weights = _weights(block, sent)
            place[terms] = np.arange(len(terms))
            met = place[sent.term] >= 0
            query, term = sent.query[met], place[sent.term[met]]
            place[terms] = -1
            firsts = _starts(query)
            reach = np.add.reduceat(weights.max(axis=1)[term], firsts) >= floor[query[firsts]] - ROOM
            live = np.repeat(reach, np.diff(np.append(firsts, len(query))))
            query, term = query[live], term[live]
            firsts = _starts(query) if len(query) else np.empty(0, np.int64)
            ends = np.append(firsts, len(query))
            at = 0
            while at < len(firsts):
                # As many queries at once as keep the rows of their terms small.
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + PRODUCTS // len(ids), "right")) - 1)
                raw = np.add.reduceat(weights[term[ends[at] : ends[to]]], firsts[at:to] - ends[at], axis=0)
                scores = np.where(raw > 0, np.floor(raw * 1e6 + 0.5) / 1e6, -2.0)
                own = query[firsts[at:to]]
                least = np.maximum(floor[own], np.partition(scores, -k, axis=1)[:, -k] if k < len(ids) else 0.0)
                which, text = np.nonzero(scores >= np.maximum(least, 0.0)[:, None])
                new.append((own[which], ids[text], scores[which, text]))
                at = to
                if sum(len(n[0]) for n in new) > PRODUCTS // 8:
                    settle()
        if new:
            settle()
        yield pa.RecordBatch.from_arrays([sent.ids.take(pa.array(rows)), pa.array(names), pa.array(held)], ["query_id", "id", "score"])
        pa.default_memory_pool().release_unused()

    return best


def _sent(asked: DataFrame, index: Index) -> tuple[DataFrame, Sent] | None:
    """The queries' terms that texts have, as ``term, t``, and the queries; none if no text has any."""
    spark = asked.sparkSession
    words = F.broadcast(asked.select("term").distinct())
    figures = index.terms.join(words, "term", "left_semi").crossJoin(F.broadcast(index.corpus))
    terms = figures.select("term", rarity(F.col("df"), F.col("n")).alias("idf"), "avgdl").toArrow().sort_by("term")
    if not len(terms):
        return None
    numbered = spark.createDataFrame(pa.table({"term": terms["term"], "t": pa.array(np.arange(len(terms), dtype=np.int32))}))
    pairs = asked.join(F.broadcast(numbered), "term").select("query_id", "t").toArrow().combine_chunks()
    codes = pairs["query_id"].combine_chunks().dictionary_encode("encode")
    query, term = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), pairs["t"].to_numpy()
    order = np.lexsort((term, query))
    return numbered, Sent(codes.dictionary, query[order], term[order], terms["idf"].to_numpy(), terms["avgdl"][0].as_py())


def recall_batch(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, id, score, rank``: top ``k`` texts of every query of ``queries(query_id, terms)``, any term counts.

    The queries go to the blocks: the postings of their words, and nothing else, are dealt
    by block once, and a task scores its blocks and returns the ``k`` best texts that
    it has for each query, so no candidate is a row.  Queries of more words than
    ``BROADCAST_WORDS`` meet the index by joins: candidates come from ``bounded``, and
    what the terms that aren't essential add is looked up by term and block for the
    candidates alone.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    asked = _asked(queries).where("term is not null").distinct()
    if asked.limit(BROADCAST_WORDS + 1).count() > BROADCAST_WORDS:
        known, _, partial = bounded(index, queries, k)
        scored = _added(index, partial, known.where(~F.col("essential")), _sender(asked)).select("query_id", "id", F.round("score", 6).alias("score"))
    else:
        scored = _scored_by_block(index, asked, k)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def _scored_by_block(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score``: each task's ``k`` best texts of every query of ``asked(query_id, term)``."""
    spark = asked.sparkSession
    kind = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id long, score double"
    found = _sent(asked, index)
    if found is None:
        return spark.createDataFrame([], kind)
    numbered, sent = found
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = index.blocks.where("block is not null").join(F.broadcast(numbered), "term").select("t", "block", F.col("ids").cast("array<bigint>").alias("ids"), "dls", "tfs")
    best = own.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_best_texts(spark.sparkContext.broadcast(sent), k), kind)
    return best.withColumn("id", F.col("id").cast(index.blocks.schema["ids"].dataType.elementType))


def with_texts(hits: DataFrame, queries: DataFrame, memories: DataFrame) -> DataFrame:
    """The hits of ``recall_batch`` with the ``content`` of their texts: a few hits go to the texts, which stay where they are."""
    return memories.select("id", "content").join(_sender(_asked(queries))(hits), "id")


def recall_all(index: Index, queries: DataFrame, facts: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, id, score, rank`` and the facts: top ``k`` texts that have every term of ``queries(query_id, terms)``.

    ``facts(id, importance, created_at)`` break ties, as for a single query.
    """
    index = _narrowed(index, _asked(queries))
    needed = F.size(F.array_distinct("terms"))
    asked = queries.where(needed > 1)
    send = _sender(_asked(asked))
    one = bounded(index, queries.where(needed == 1), k).partial.select("query_id", "id", F.col("own").alias("score"))
    # Of several terms the rarest brings the texts; a term that no text has leaves none.
    terms = _asked(asked).join(send(index.terms.join(send(_asked(asked).select("term").distinct()), "term")), "term").crossJoin(F.broadcast(index.corpus))
    each = Window.partitionBy("query_id")
    terms = terms.join(asked.select("query_id", needed.alias("needed")), "query_id").withColumns({"known": F.count("*").over(each), "at": F.row_number().over(each.orderBy("df", "term"))})
    terms = terms.where("known = needed").select("query_id", "term", "needed", "at", "avgdl", rarity(F.col("df"), F.col("n")).alias("idf"))
    blocks = index.blocks.where("term is not null").select("term", "block", "ids", "dls", "tfs")
    rarest = blocks.join(send(terms.where("at = 1")), "term").select("query_id", "needed", "block", "idf", "avgdl", F.explode(_zipped()).alias("e"))
    rarest = rarest.select("query_id", "needed", "block", "e.id", (F.col("idf") * frequency_factor(F.col("e.tf"), F.col("e.dl"), F.col("avgdl"))).alias("own"))
    several = _added(index, rarest, terms.where("at > 1").select("query_id", "term", "idf", "avgdl"), send, "needed").where("found = needed").select("query_id", "id", "score")
    scored = one.unionByName(several).withColumn("score", F.round("score", 6))
    hits = scored.join(facts, "id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("importance"), F.desc("created_at"), F.asc("id"))
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
