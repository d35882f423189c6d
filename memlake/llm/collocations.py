"""Phrase collocations by vertical positional inverted lists.

A block of texts of one language keeps, for every phrase, the list of the positions
where it begins.  Frequent phrases are extended a word at a time: a phrase's list is
merged with the postings of the words behind it, the positions one further on, and
what matches within a piece of the text is the list of the longer phrase.  A phrase
occurs no more often than its first and its last words, so only lists whose both
parts are frequent are merged.  The length of a list is the exact number of
occurrences in the block, and lengths are summed over blocks by the phrase's text.
Which phrases are frequent goes to the blocks as a filter of a fixed number of bits:
what it lets through by mistake is counted as well and dropped by its exact count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.bitfilter import filled, passes
from memlake.llm.session import checkpointed
from memlake.llm.textscan import LOWER, Chunk, chunks, mix, multipliers, span_hashes, word_spans

#: Bytes of text in a block; a longer text is cut between pieces, which no phrase crosses.
BLOCK_BYTES = 2_500_000
#: Rows of a batch that are told apart by language at once.
SLICE_ROWS = 3000
#: Bits of the filter of frequent phrases: 16 MB, whatever their number.
FILTER_BITS = 27
#: Numbers of words of the phrases that are counted by hash first.
HASHED = (2,)
#: Frequent phrases that are broadcast to look counts up (some 100 MB with Spark's tables); beyond, a shuffle joins them.
BROADCAST_PHRASES = 300_000
#: Parts of a language whose first phrases are found apart before they meet.
RANK_PARTS = 64
#: Bytes that end a piece, and those that only end a word.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
IN_WORD = ~SEPARATOR
IN_WORD[[0x20, 0x09]] = False


def _cut(chunk: Chunk) -> Iterator[Chunk]:
    """A chunk of one long text as several, cut behind separators."""
    at, n = 0, len(chunk.bytes)
    if len(chunk.bounds) > 2:
        yield chunk
        return
    while at < n:
        stop = min(n, at + BLOCK_BYTES)
        if stop < n:
            ends = np.flatnonzero(SEPARATOR[chunk.bytes[at:stop]])
            while not len(ends) and stop < n:
                ahead = min(n, stop + BLOCK_BYTES)
                ends = np.flatnonzero(SEPARATOR[chunk.bytes[stop:ahead]])[:1] + stop - at
                stop = ahead
            stop = at + int(ends[-1]) + 1 if len(ends) else n
        yield Chunk(chunk.first, chunk.bytes[at:stop], np.array([0, stop - at]))
        at = stop


def _vocabulary(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Number of each word, whether the next word is in the same piece, the different words and their hashes."""
    low = LOWER[chunk.bytes]
    doc, start, length = word_spans(chunk, IN_WORD)
    piece = np.cumsum(SEPARATOR[low])[start] if len(start) else start
    joined = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
    # The words' bytes one after the other.
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    letters = low[IN_WORD[low]]
    coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    words = coded.dictionary
    bounds = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.asarray(pc.binary_length(words)), out=bounds[1:])
    spans = Chunk(0, np.frombuffer(b"".join(words.to_pylist()), np.uint8), bounds)
    return np.asarray(coded.indices).astype(np.int64), joined, words, span_hashes(spans, bounds[:-1], np.diff(bounds))


def _language(name: str) -> np.uint64:
    """A number for each language, so that filters tell their phrases apart."""
    return reduce(lambda h, b: mix(np.array([h ^ np.uint64(b)]))[0], name.encode(), np.uint64(len(name) + 1))


def block_lists(chunk: Chunk, language: str, words: int, table: np.ndarray | None, named: bool = True, passing: bool = False) -> tuple[pa.Array | None, np.ndarray, np.ndarray]:
    """Phrases of so many words, whose parts pass the filter, their hashes and the lengths of their lists.

    With ``passing``, only those that pass the filter themselves; phrases that aren't ``named`` have no text.
    """
    ids, joined, vocabulary, hashes = _vocabulary(chunk)
    seed = _language(language)
    of = mix(hashes ^ seed)
    if words == 1:
        return vocabulary, of, np.bincount(ids, minlength=len(vocabulary))
    factor = multipliers(1, 11)[0]
    # Positions in order, and the number of the phrase that begins at each.
    at = np.flatnonzero(passes(table, of)[ids])
    phrase, first = ids[at], None
    for size in range(2, words + 1):
        # Merge: where a list has a position and one has the next, too, the longer phrase begins.
        met = np.flatnonzero(np.diff(at) == 1)
        if size == 2:
            met = met[joined[at[met]]]
        begin = at[met]
        last = ids[begin + size - 1]
        codes, first, number, lengths = np.unique(phrase[met] * len(vocabulary) + last, return_index=True, return_inverse=True, return_counts=True)
        of = mix(of[codes // max(1, len(vocabulary))] * factor + mix(hashes[codes % max(1, len(vocabulary))] ^ seed))
        first = begin[first]
        if size < words:
            kept = passes(table, of)[number]
            at, phrase = begin[kept], number[kept]
    if not named:
        return None, of, lengths
    if passing:
        kept = passes(table, of)
        first, of, lengths = first[kept], of[kept], lengths[kept]
    parts = [vocabulary.take(pa.array(ids[first + k])) for k in range(words)]
    return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())), of, lengths


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, Chunk]]:
    for at in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(at, SLICE_ROWS)
        langs = part.column(0).dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            for chunk in chunks(part.column(1).filter(pc.equal(langs.indices, code)), BLOCK_BYTES):
                for block in _cut(chunk):
                    yield lang, block
        # Freed memory goes back, as a worker lives through many tasks.
        pa.default_memory_pool().release_unused()


def _named(words: int, bits):
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``lang, phrase, hash, n``; for single words, a row without phrase has a block's number of words."""
        for batch in batches:
            for lang, block in _blocks(batch):
                phrases, of, lengths = block_lists(block, lang, words, bits and bits.value, passing=words in HASHED)
                phrases, of = phrases.cast(pa.string()), of.view(np.int64)
                if words == 1:
                    phrases, of, lengths = pa.concat_arrays([phrases, pa.nulls(1, pa.string())]), np.r_[of, 0], np.r_[lengths, lengths.sum()]
                if len(of):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(of), pa.string()), phrases, pa.array(of), pa.array(lengths.astype(np.int64))], ["lang", "phrase", "hash", "n"])

    return named


def _hashed(words: int, bits):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``hash, n`` of phrases whose parts pass the filter."""
        for batch in batches:
            for lang, block in _blocks(batch):
                _, of, lengths = block_lists(block, lang, words, bits.value, named=False)
                if len(of):
                    yield pa.RecordBatch.from_arrays([pa.array(of.view(np.int64)), pa.array(lengths.astype(np.int64))], ["hash", "n"])

    return hashed


def frequent_phrases(texts: DataFrame, most_words: int, least: int) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of all phrases that occur ``least`` times in their language, and ``lang, n``.

    Pairs of frequent words, the most numerous phrases by far, are counted twice: by
    hash, which is cheap and may only count too many, for the filter, then those that
    pass it by their text.  Longer phrases are pruned by their parts enough.
    """
    table, levels, totals = None, [], None
    send = texts.sparkSession.sparkContext.broadcast
    for words in range(1, most_words + 1):
        if words in HASHED:
            sums = texts.mapInArrow(_hashed(words, send(table)), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
            table = filled(sums.where(F.col("n") >= least).select("hash"), FILTER_BITS, table)
        found = texts.mapInArrow(_named(words, send(table) if words > 1 else None), "lang string, phrase string, hash long, n long")
        sums = found.groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.first("hash").alias("hash"))
        level = checkpointed(sums.where(F.col("phrase").isNull() | (F.col("f") >= least)))
        if words == 1:
            totals = level.where("phrase is null").select("lang", F.col("f").alias("n"))
            level = level.where("phrase is not null")
        if words not in HASHED and words < most_words:
            table = filled(level.select("hash"), FILTER_BITS, table)
        levels.append(level.select("lang", "phrase", F.lit(words).alias("words"), "f"))
    return reduce(DataFrame.unionByName, levels), totals


def _part(words: str, begin, size):
    return F.array_join(F.slice(words, begin, size), " ")


def collocations(
    documents: DataFrame,
    least: int = 30,
    most_words: int = 4,
    first: int = 2000,
    covered: int = 80,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``first`` collocations of each language.

    Texts, A-Z folded, end a piece at ``.,;:!?`` and line ends and a word at spaces
    and tabs.  A candidate is a phrase of 2 to ``most_words`` words within a piece
    that occurs ``a >= least`` times in its language, overlaps included.  Cut in two,
    its parts occur ``l`` and ``r`` times and score ``floor(2000000 * a / (l + r))``;
    the cut of the least score counts, of equal ones the first.  A candidate within a
    longer one that occurs ``covered`` of 100 times as often, or more, is dropped.
    Ranks go by score, then ``a``, both falling, then by the phrase's bytes, so there
    are no ties.  ``n`` is the language's number of words.  A null language counts as
    ``und``; null, empty and blank texts have no words; each of several equal rows
    counts.  Texts of any length are read whole.  Without candidates, as from an
    empty table, there are no rows.  Other columns are ignored.
    """
    texts = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts, totals = frequent_phrases(texts, most_words, least)
    few = counts.count() <= BROADCAST_PHRASES

    def known(name: str, value: str) -> DataFrame:
        named = counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
        return F.broadcast(named) if few else named

    candidates = counts.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", F.split("phrase", " ").alias("own"))
    cuts = candidates.select("lang", "phrase", "a", "own", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part("own", F.lit(1), F.col("cut")).alias("left"), _part("own", F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right"))
    cuts = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"])
    score = F.expr("(cast(a as decimal(20, 0)) * cast(2000000 as decimal(7, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    # What each longer candidate holds, from two words to one less than its own.
    inner = candidates.where("words > 2").select("lang", "a", "own", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "own", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("begin"))
    longer = inner.select("lang", "a", _part("own", F.col("begin"), F.col("size")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    some = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", parts).orderBy(*order))).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    # A row for each language.
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
