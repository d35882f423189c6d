"""Toxicity by multiple-instance learning over sentences.

Only documents carry labels.  A sentence's score is logistic in its terms: the
words it has and their first ``STEMS`` letters, as one stem has many endings.  A
document's score is the noisy-or of its sentences, ``1 - prod(1 - p)``: one
offending sentence is enough, and it can be pointed out.  The terms that the model
looks at and their weights are fitted on a sample of about ``most_documents``
labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from memlake.llm.session import checkpointed, fresh
from memlake.llm.textscan import LETTERS, Chunk, chunks, span_hashes, words

#: Bytes that end a sentence.
_ENDS = np.zeros(256, bool)
_ENDS[[0x21, 0x2E, 0x3F, 0x0A]] = True
#: Longer words are terms by their first so many letters, too.
STEMS = (4, 5, 6)


_SENTENCES = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())]))


class Model(NamedTuple):
    """Term hashes in ascending order, their weights, and the weight of any sentence."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


class _Sentences(NamedTuple):
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word_sentence: np.ndarray
    word_hash: np.ndarray


def _sentences(chunk: Chunk) -> _Sentences:
    """Sentences that have a word, and the terms of each."""
    found = words(chunk, LETTERS)
    if not len(found.start):
        none = np.zeros(0, np.int64)
        return _Sentences(none, none, none, none, none.astype(np.uint64))
    ends = np.flatnonzero(_ENDS[chunk.bytes])
    # A new sentence begins with a word before which a document or a sentence has ended.
    passed = np.searchsorted(ends, found.start)
    fresh = np.ones(len(found.start), bool)
    fresh[1:] = (passed[1:] != passed[:-1]) | (found.doc[1:] != found.doc[:-1])
    number = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(fresh)] - 1
    numbers, hashes = [number], [found.hash]
    # Where each code point begins: bytes that don't continue one.
    heads = np.r_[np.flatnonzero(chunk.bytes & 0xC0 != 0x80), len(chunk.bytes)]
    letter = np.searchsorted(heads, found.start)
    for k in STEMS:
        end = heads[np.minimum(letter + k, len(heads) - 1)]
        longer = np.flatnonzero(end < found.start + found.length)
        numbers.append(number[longer])
        hashes.append(span_hashes(chunk, found.start[longer], (end - found.start)[longer]) ^ np.uint64(k))
    return _Sentences(found.doc[first], found.start[first], found.start[last] + found.length[last], np.concatenate(numbers), np.concatenate(hashes))


def _known(sentences: _Sentences, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, vocabulary index) of the sentences' distinct known words."""
    at = np.minimum(np.searchsorted(vocabulary, sentences.word_hash), max(0, len(vocabulary) - 1))
    hit = np.flatnonzero(vocabulary[at] == sentences.word_hash) if len(vocabulary) else np.zeros(0, np.int64)
    pairs = np.unique(sentences.word_sentence[hit] * np.int64(len(vocabulary) + 1) + at[hit])
    return pairs // (len(vocabulary) + 1), pairs % (len(vocabulary) + 1)


def _chances(model: Model, sentences: _Sentences) -> np.ndarray:
    """Probability of each sentence to offend."""
    z = np.full(len(sentences.doc), model.bias)
    at, word = _known(sentences, model.words)
    np.add.at(z, at, model.weights[word])
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = np.asarray(batch.column(1))
        for chunk in chunks(batch.column(0)):
            s = _sentences(chunk)
            if not len(s.doc):
                continue
            docs = s.doc[s.word_sentence]
            order = np.lexsort((docs, s.word_hash))
            h, d = s.word_hash[order], docs[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, toxic = h[once], label[chunk.first + d[once]]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            n, t = np.diff(np.r_[first, len(h)]), np.add.reduceat(toxic.astype(np.int64), first)
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(n), pa.array(t)], ["word", "n", "toxic"])


def _instances(vocabulary: np.ndarray):
    def instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document: label, sentences, and its known words as sentence, index pairs."""
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                s = _sentences(chunk)
                n = np.bincount(s.doc, minlength=len(chunk.bounds) - 1)
                at, word = _known(s, vocabulary)
                base = np.r_[0, np.cumsum(n)]
                cuts = np.searchsorted(at, base)
                offsets = pa.array(cuts.astype(np.int32))
                own = (at - np.repeat(base[:-1], np.diff(cuts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(chunk.first, len(n)), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(own)), pa.ListArray.from_arrays(offsets, pa.array(word.astype(np.int32)))],
                    ["toxic", "n", "at", "word"],
                )

    return instances


def fit_weights(labels: np.ndarray, counts: np.ndarray, sentence: np.ndarray, word: np.ndarray, size: int, steps: int = 400, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights that maximise the noisy-or likelihood (Adam, full batches).

    ``counts`` has the sentences of each document in order; ``sentence`` and
    ``word`` list the known words of all sentences.
    """
    owner = np.repeat(np.arange(len(labels)), counts)
    w, b = np.zeros(size + 1), -6.0
    w[size] = b
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    y = labels.astype(float)
    for step in range(1, steps + 1):
        z = np.full(len(owner), w[size])
        np.add.at(z, sentence, w[word])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.clip(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)), -30, -1e-9)
        # d/dz of the log likelihood: p for a clean document's sentences with minus, else p * none / (1 - none).
        pull = np.where(y > 0, np.exp(none) / (1 - np.exp(none)), -1.0)[owner] * p
        g = np.bincount(word, pull[sentence], size + 1) / len(y)
        g[size] = pull.sum() / len(y)
        g[:size] -= ridge * w[:size]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:size], float(w[size])


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_documents: int = 6000, deviations: float = 3.0) -> Model:
    """A model from documents and the 0/1 labels of some of them.

    It is fitted on a sample of about ``most_documents`` labels, drawn by a hash of
    the id; only these ids, so a bounded number, are broadcast to the documents.
    The vocabulary is every term whose log-odds for the label are more than
    ``deviations`` of their standard deviations.  Rows without id, text or label are
    left out; an id with several labels has the highest, one with several texts that
    of the least hash.  Without rows of both labels every text gets the score 0.
    """
    known_labels = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    share = min(1.0, most_documents / max(1, known_labels.count()))
    drawn = known_labels.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < round(share * 1_000_000)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # One row for each id: rows that repeat one neither weigh more nor reach the driver.
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic"))
    rows = checkpointed(texts.join(F.broadcast(drawn), "id").groupBy("id").agg(one.alias("row")).select("row.text", "row.toxic"))
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not 0 < totals.t < totals.n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    counted = rows.mapInArrow(_word_counts, "word long, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t"))
    odds = F.log((F.col("t") + 0.5) / (totals.t - F.col("t") + 0.5)) - F.log((F.col("n") - F.col("t") + 0.5) / (totals.n - totals.t - F.col("n") + F.col("t") + 0.5))
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") - F.col("t") + 0.5))
    # As many as the sample has, whose size is bounded.
    chosen = counted.where(odds > deviations * spread).select("word").collect()
    known = np.sort(np.array([r.word for r in chosen], np.int64).view(np.uint64))
    got = rows.mapInArrow(_instances(known), "toxic int, n int, at array<int>, word array<int>").collect()
    counts = np.array([r.n for r in got], np.int64)
    base = np.r_[0, np.cumsum(counts)]
    sentence = np.concatenate([np.array(r["at"], np.int64) + base[i] for i, r in enumerate(got)] or [np.zeros(0, np.int64)])
    word = np.concatenate([np.array(r.word, np.int64) for r in got] or [np.zeros(0, np.int64)])
    weights, bias = fit_weights(np.array([r.toxic for r in got]), counts, sentence, word, len(known))
    return Model(known, weights, bias)


def _score(model: Model, threshold: float, names: tuple[str, str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(len(batch.column(0)))
            worst: list[list[dict]] = [[] for _ in scores]
            for chunk in chunks(batch.column(batch.num_columns - 1)):
                s = _sentences(chunk)
                p = _chances(model, s)
                n = len(chunk.bounds) - 1
                scores[chunk.first : chunk.first + n] = 1 - np.exp(np.bincount(s.doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n))
                for k in np.flatnonzero(p >= threshold):
                    lo = chunk.bounds[s.doc[k]]
                    before, inside = chunk.bytes[lo : s.start[k]], chunk.bytes[s.start[k] : s.end[k]]
                    # Code points: bytes that don't continue a character.
                    start = int((before & 0xC0 != 0x80).sum())
                    worst[chunk.first + s.doc[k]].append({"start": start, "end": start + int((inside & 0xC0 != 0x80).sum()), "score": float(p[k])})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores), pa.array(worst, kind)], [*batch.schema.names[:-1], *names])

    return score


def score_documents(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id, score, sentences`` for each row; ``sentences`` locates those with at least ``threshold``.

    Spans are code points, first word to last.  Null and empty texts and those
    without a letter have no sentence: their score is 0.  Repeated rows get the
    same score each.  Other columns are ignored.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return score_rows(rows, model, threshold=threshold).select("doc_id", "score", "sentences")


def score_rows(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5, score: str = "score", sentences: str = "sentences") -> DataFrame:
    """The documents' own columns with ``score`` and ``sentences``, which need names that these don't have."""
    text = F.col(text_col).cast("string").alias(fresh(documents, "scored"))
    schema = StructType([*documents.schema.fields, StructField(score, DoubleType()), StructField(sentences, _SENTENCES)])
    return documents.select("*", text).mapInArrow(_score(model, threshold, (score, sentences)), schema)


def held_out(id_col: Column) -> Column:
    """Rows that the labels of which are never learnt from: remainder 1 of crc32 of the id as text by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))
