"""Benchmark decontamination by rare n-gram seeds and local alignment.

Test items are cut into n-grams of words.  A filter of fixed size over the items'
n-grams keeps, in one pass over the training texts, only the stretches of words
around possible hits; a join on the n-gram gives the items.  Every n-gram that a
text shares with an item is a seed, but rare and common ones differ in what they
cost: a common one would bring all its texts to all its items, so its pairs must
first show, by small sets of the words around the hit and of the item's words, that
the text may have the share of words that the least score needs.  What is left is
aligned with its item by Smith-Waterman over words, which also scores edited copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.bitfilter import filled, passes
from memlake.llm.session import checkpointed, fresh, row_key
from memlake.llm.textscan import ALNUM, chunks, grams, long_lists, words

#: Bits of the filter: 16 MB, whatever the number of items.  False hits end in the join.
FILTER_BITS = 27
#: Longs of a set of words: one bit for each word, by its hash.
SET_LONGS = 16
#: Words around a hit whose set is kept; around longer items all words may be there.
MOST_SET_WORDS = 1024
#: Pairs of hits and items that a rare seed makes at most; those of a common one are tested by their sets.
RARE_PAIRS = 1000
#: Rows that an item, or a seed, is dealt out to, so that one that many texts have isn't one task's.
SALTS = 16
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells of a row of all pairs that are aligned at once.
BLOCK_CELLS = 100_000


def word_sets(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """For each range of words the bits of their hashes, ``SET_LONGS`` unsigned longs in a row."""
    out = np.zeros((len(starts), SET_LONGS), np.uint64)
    place = (hashes % np.uint64(64 * SET_LONGS)).astype(np.int64)
    bit = np.uint64(1) << (place & 63).astype(np.uint64)
    out[stops - starts > MOST_SET_WORDS] = np.uint64(2**64 - 1)
    some = np.flatnonzero(stops - starts <= MOST_SET_WORDS)
    for at in range(0, len(some), 1000):
        rows = some[at : at + 1000]
        size = stops[rows] - starts[rows]
        row = np.repeat(rows, size)
        word = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - starts[rows], size)
        np.bitwise_or.at(out, (row, place[word] >> 6), bit[word])
    return out


def _item_words(n: int):
    def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``item, words, grams, own``: hashes of words, of grams in place of their first word, and the set of words."""
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                found = words(chunk, ALNUM)
                docs = len(chunk.bounds) - 1
                at, g = grams(found.doc, found.hash, n)
                cuts = np.searchsorted(found.doc, np.arange(docs + 1))
                own = np.concatenate([np.zeros((0, SET_LONGS), np.uint64), *[np.bitwise_or.reduce(word_sets(found.hash[lo:hi], np.arange(hi - lo), np.arange(1, hi - lo + 1)), axis=0, keepdims=True) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, docs),
                        long_lists(found.hash, np.bincount(found.doc, minlength=docs)),
                        long_lists(g, np.bincount(found.doc[at], minlength=docs)),
                        long_lists(own.ravel(), np.full(docs, SET_LONGS)),
                    ],
                    ["item", "words", "grams", "own"],
                )

    return item_words


def _stretches(bits, n: int, reach: int):
    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``id, doc_id, first, words, places, grams, sets``: a stretch's hits are its places, their grams and the sets of words around them."""
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for chunk in chunks(batch.column(1)):
                found = words(chunk, ALNUM)
                at, g = grams(found.doc, found.hash, n)
                hit = np.flatnonzero(passes(bits.value, g))
                if not len(hit):
                    continue
                at, g = at[hit], g[hit]
                doc = found.doc[at]
                # Hits whose surroundings touch are in one stretch.
                fresh = np.ones(len(at), bool)
                fresh[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * reach)
                first = np.flatnonzero(fresh)
                last = np.r_[first[1:], len(at)] - 1
                starts = np.searchsorted(found.doc, np.arange(len(chunk.bounds)))
                lo = np.maximum(at[first] - reach, starts[doc[first]])
                hi = np.minimum(at[last] + n + reach, starts[doc[first] + 1])
                size, hits = hi - lo, last - first + 1
                inside = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                place = at - np.repeat(lo, hits)
                around = word_sets(found.hash, np.maximum(at - reach, starts[doc]), np.minimum(at + n + reach, starts[doc + 1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[chunk.first + doc[first]]),
                        batch.column(2).take(pa.array(chunk.first + doc[first])),
                        pa.array(lo - starts[doc[first]]),
                        long_lists(found.hash[inside], size),
                        long_lists(place.astype(np.int64), hits),
                        long_lists(g, hits),
                        long_lists(around.ravel(), SET_LONGS * hits),
                    ],
                    ["id", "doc_id", "first", "words", "places", "grams", "sets"],
                )

    return stretches


def align(items: np.ndarray, item_sizes: np.ndarray, texts: np.ndarray, text_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each item (row of word hashes, zero-padded) with its text: score, first and end column.

    Rows are computed for all pairs at once.  A gap in the text is a running
    maximum along the row; the start of a path travels with its score.
    """
    pairs, width = texts.shape
    columns = np.arange(width)
    usable = columns[None, :] < text_sizes[:, None]
    # Scores carry their path's start column in the low digits: ties prefer the later start.
    unit = np.int64(width + 1)
    previous = np.zeros((pairs, width + 1), np.int64) + np.arange(width + 1)
    best, best_end = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    for i in range(items.shape[1]):
        live = (i < item_sizes)[:, None] & usable
        step = np.where(texts == items[:, i : i + 1], MATCH, MISMATCH).astype(np.int64) * unit
        fresh = np.broadcast_to(columns + 1, (pairs, width))
        row = np.maximum(previous[:, :-1] + step, np.maximum(previous[:, 1:] + GAP * unit, fresh))
        ramp = -GAP * unit * columns
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp
        row = np.where(live, row, fresh)
        at = row.argmax(axis=1)
        top = row[np.arange(pairs), at]
        better = top // unit > best // unit
        best, best_end = np.where(better, top, best), np.where(better, at + 1, best_end)
        previous[:, 1:] = np.where((i < item_sizes)[:, None], row, previous[:, 1:])
    return best // unit, best % unit, best_end


def _blocks(order: list[int], texts: list[np.ndarray]) -> Iterator[list[int]]:
    """The pairs in turn, as many at once as their widest text allows."""
    block, width = [], 0
    for k in order:
        width = max(width, len(texts[k]))
        if block and width * (len(block) + 1) > BLOCK_CELLS:
            yield block
            block, width = [], len(texts[k])
        block.append(k)
    if block:
        yield block


def _aligned(least_score: float):
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [(np.asarray(c.flatten()), np.r_[0, np.cumsum(np.asarray(pc.list_value_length(c)))]) for c in (batch.column(4), batch.column(5))]
            items, texts = ([values[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)] for values, at in lists)
            # An alignment has at most as many matches as the item has words that the text has too.
            able = [k for k in range(len(items)) if np.isin(items[k], texts[k]).sum() >= least_score * len(items[k])]
            order = sorted(able, key=lambda k: (len(items[k]), len(texts[k])))
            score, start, end = (np.zeros(len(items), np.int64) for _ in range(3))
            for part in _blocks(order, texts):
                m, w = np.array([len(items[k]) for k in part]), np.array([len(texts[k]) for k in part])
                # Padding differs on both sides and equals no hash of a real text but by odds of 2^-63.
                a, b = np.zeros((len(part), max(1, m.max())), np.int64), np.ones((len(part), max(1, w.max())), np.int64)
                for r, k in enumerate(part):
                    a[r, : m[r]], b[r, : w[r]] = items[k], texts[k]
                score[part], start[part], end[part] = align(a, m, b, w)
            first = np.asarray(batch.column(2))
            columns = [batch.column(0), batch.column(1), pa.array(score / (MATCH * np.maximum(1, np.asarray(batch.column(3))))), pa.array(first + start), pa.array(first + end)]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(able, pa.int64())) for c in columns], ["id", "item", "score", "first_word", "end_word"])

    return aligned


def contaminated_spans(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 4,
    least_score: float = 0.5,
) -> DataFrame:
    """``doc_id, item_id, score, first_word, end_word`` for each document and item whose alignment scores ``least_score``.

    The score is that of the best local alignment (2 for equal words, -1 for other
    words and gaps) by what the whole item would have; the words are those of the
    document's best copy, end exclusive; of equal scores the first.  Words are runs
    of letters and digits, A-Z folded.  Every n-gram of an item is a seed, and every
    alignment with the least score that holds one is found; a copy that keeps no n
    words of the item in a row, as with every n-th word replaced, has none and isn't.
    Null and empty texts match nothing, nor do items of fewer than n words, which
    have no seed; an empty table of documents or items gives no rows.  Of rows that repeat a document's or an item's id, with the same text or
    another one, the best copy counts; rows without an id are left out.  Texts of
    any length are scanned whole.  Other columns are ignored.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), row_key(item_col, item_text_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    spans = _spans(docs.select("id", "text", "doc_id"), items, n, least_score).join(items.select("item", "item_id").distinct(), "item")
    best = spans.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("first_word")).alias("f"), "end_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", (-F.col("b.f")).alias("first_word"), "b.end_word")


def _spans(docs: DataFrame, items: DataFrame, n: int, least_score: float) -> DataFrame:
    """``id, doc_id, item, score, first_word, end_word`` of ``docs(id, text, doc_id)`` and ``items(item, text)``, the best of each id and item."""
    spark = docs.sparkSession
    items = checkpointed(items.select("item", "text").mapInArrow(_item_words(n), "item long, words array<long>, grams array<long>, own array<long>").dropDuplicates(["item"]))
    seeds = items.select("item", F.size("words").alias("m"), "own", F.posexplode("grams").alias("place", "gram"))
    table = filled(seeds.select(F.col("gram").alias("hash")), FILTER_BITS)
    longest = int(items.agg(F.coalesce(F.max(F.size("words")), F.lit(0))).first()[0])
    # An alignment of least_score has no more gaps and other words than its item has words: it reaches so far beyond its place.
    found = docs.mapInArrow(_stretches(spark.sparkContext.broadcast(table), n, 2 * longest), "id long, doc_id long, first long, words array<long>, places array<long>, grams array<long>, sets array<long>")
    found = checkpointed(found)

    hits = found.select("id", "first", "sets", F.posexplode(F.arrays_zip("places", "grams")).alias("k", "h"))
    hits = hits.select("id", "first", F.col("h.places").alias("at"), F.col("h.grams").alias("gram"), F.slice("sets", F.col("k") * SET_LONGS + 1, F.lit(SET_LONGS)).alias("around"))
    # How many pairs a seed would make: its hits times its items.
    pairs = hits.groupBy("gram").agg(F.count("*").alias("n_hits")).join(seeds.groupBy("gram").agg(F.count("*").alias("n_items")), "gram")
    pairs = pairs.select("gram", (F.col("n_hits") * F.col("n_items") <= RARE_PAIRS).alias("rare"))
    salts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))
    salted = seeds.join(pairs, "gram").withColumn("salt", salts)
    met = hits.withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"])
    # Words of the item that aren't around the hit are no matches; the sets show some of these.
    lost = F.aggregate(F.zip_with("own", "around", lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))), F.lit(0), lambda total, x: total + x)
    met = met.where(F.col("rare") | (lost <= F.floor(F.col("m") * (1 - least_score) + 1e-9)))
    # Seeds of one copy lie on near diagonals: one window for each band of them.
    band = F.floor((F.col("at") - F.col("place")) / (F.col("m") + 1))
    windows = met.groupBy("id", "first", "item", "m", band.alias("band"))
    windows = windows.agg(F.min(F.col("at") - F.col("place")).alias("lo"), F.max(F.col("at") - F.col("place") + F.col("m")).alias("hi"))
    lo, hi = F.greatest(F.lit(1), F.col("lo") - F.col("m") + 1), F.col("hi") + F.col("m") + 1
    # A copy in a stretch is found from each of its bands; equal ids have equal stretches.
    once = found.select("id", "first", "words").dropDuplicates(["id", "first"])
    texts = windows.join(once, ["id", "first"]).select("id", "item", "m", (F.col("first") + lo - 1).alias("first"), F.slice("words", lo, hi - lo).alias("text_words"))
    texts = texts.withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int"))
    ready = texts.join(items.select("item", F.col("words").alias("item_words"), salts.alias("salt")), ["item", "salt"]).select("id", "item", "first", "m", "item_words", "text_words")
    scored = ready.mapInArrow(_aligned(least_score), "id long, item long, score double, first_word long, end_word long").where(F.col("score") >= least_score)
    best = scored.groupBy("id", "item").agg(F.max(F.struct("score", (-F.col("first_word")).alias("f"), "end_word")).alias("b"))
    best = best.join(found.select("id", "doc_id").distinct(), "id")
    return best.select("id", "doc_id", "item", "b.score", (-F.col("b.f")).alias("first_word"), "b.end_word")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text", n: int = 4, least_score: float = 0.5) -> DataFrame:
    """The documents without those that have a contaminated span, with or without an id."""
    docs = documents.select(row_key(id_col, text_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("long").alias("doc_id"))
    items = benchmark.select(F.xxhash64(F.col(item_text_col).cast("string")).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    leaked = fresh(documents, "leaked")
    spans = _spans(docs, items, n, least_score).select(F.col("id").alias(leaked)).distinct()
    return documents.join(spans, row_key(id_col, text_col) == F.col(leaked), "left_anti")
