"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  An n-gram of letters is the
product of its letters' vectors, each rolled by its place; a text is the sum of
its n-grams, a language the sum of its texts.  A text's language is the prototype
with the highest cosine.  Sums are whole numbers, so they are the same in any
order and on every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.textscan import chunks, mix

#: Texts are taken in groups of about so many characters.
GROUP_CHARACTERS = 400_000
#: N-grams whose vectors are made at once, and those that a worker keeps.
BLOCK, KEPT = 4096, 16_384
SPACE_LETTER = 0x20


class Prototypes(NamedTuple):
    languages: list[str]
    vectors: np.ndarray
    mean: np.ndarray


_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """By code point: the lower-case letter, or a space for what is no letter.  Made once in each worker."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x110000, SPACE_LETTER, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD = table
    return _FOLD


def letter_vectors(letters: np.ndarray, dimensions: int) -> np.ndarray:
    """Rows of +1 and -1, fixed for each letter."""
    words = -(-dimensions // 64)
    seeds = letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, words + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
    bits = np.unpackbits(mix(mix(seeds)).view(np.uint8).reshape(len(letters), -1), axis=1)[:, :dimensions]
    return bits.astype(np.float32) * 2 - 1


class _Vectors:
    """Vectors of n-grams; those met first stay, at most ``KEPT``, as most texts have the same ones."""

    def __init__(self, n: int, dimensions: int) -> None:
        self.n, self.dimensions = n, dimensions
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.kept = np.zeros((0, dimensions), np.float32)

    def of(self, keys: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The vectors of n-grams: ascending keys, and their letters in a row each."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.ones((len(keys), self.dimensions), np.float32)
        out[known] = self.kept[self.rows[at[known]]]
        new = np.flatnonzero(~known)
        if len(new):
            alphabet, code = np.unique(letters[new], return_inverse=True)
            code = code.reshape(len(new), self.n)
            base = letter_vectors(alphabet, self.dimensions)
            for j in range(self.n):
                # The last letter is rolled by 0, each one before it by one more.
                out[new] *= np.roll(base, self.n - 1 - j, axis=1)[code[:, j]]
            room = new[: max(0, KEPT - len(self.keys))]
            if len(room):
                self.rows = np.r_[self.rows, len(self.kept) + np.arange(len(room))]
                self.kept = np.concatenate([self.kept, out[room]])
                order = np.argsort(np.r_[self.keys, keys[room]], kind="stable")
                self.keys, self.rows = np.r_[self.keys, keys[room]][order], self.rows[order]
        return out


class _Grams(NamedTuple):
    """A group's n-grams: for each its document and kind in order of kinds, each kind's key and letters; letters by document."""

    owner: np.ndarray
    which: np.ndarray
    keys: np.ndarray
    spelled: np.ndarray
    letters: np.ndarray

    def sums(self, vectors: _Vectors) -> np.ndarray:
        """The sum of its n-grams' vectors for each document."""
        docs = len(self.letters)
        out = np.zeros((docs, vectors.dimensions))
        for lo in range(0, len(self.keys), BLOCK):
            hi = min(lo + BLOCK, len(self.keys))
            a, b = np.searchsorted(self.which, (lo, hi))
            counts = np.bincount(self.owner[a:b] * (hi - lo) + self.which[a:b] - lo, minlength=docs * (hi - lo)).reshape(docs, hi - lo)
            # Whole numbers under 2^24, so single precision is exact: a block has at most a group's characters.
            out += counts.astype(np.float32) @ vectors.of(self.keys[lo:hi], self.spelled[lo:hi])
        return out


def _groups(column: pa.Array, n: int) -> Iterator[tuple[int, _Grams]]:
    fold = _fold()
    for chunk in chunks(column):
        # Every document stands between spaces, so that no n-gram runs over its ends.
        heads = chunk.bytes & 0xC0 != 0x80
        ends = np.r_[0, np.cumsum(heads)][chunk.bounds]
        points = np.frombuffer(chunk.bytes.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        first, total = 0, len(ends) - 1
        while first < total:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + GROUP_CHARACTERS, "right")) - 1)
            last = min(last, first + 512, total)
            part = fold[points[ends[first] : ends[last]]]
            bounds = ends[first : last + 1] - ends[first]
            docs = last - first
            doc = np.repeat(np.arange(docs), np.diff(bounds))
            letters = np.bincount(doc, part != SPACE_LETTER, docs)
            # One space before and one after each: whatever its neighbours are, a document has the same n-grams.
            around = np.repeat(bounds, 2)[1:-1]
            text = np.insert(part, around, SPACE_LETTER)
            owner = np.insert(doc, around, np.repeat(np.arange(docs), 2))
            # Runs of spaces are one.
            keep = np.ones(len(text), bool)
            keep[1:] = (text[1:] != SPACE_LETTER) | (text[:-1] != SPACE_LETTER) | (owner[1:] != owner[:-1])
            text, owner = text[keep], owner[keep]
            at = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1]) if len(text) >= n else np.zeros(0, np.int64)
            gram = np.zeros(len(at), np.uint64)
            for j in range(n):
                # 21 bits a letter; more than three letters are hashed.
                gram = (gram << np.uint64(21) if n <= 3 else mix(gram + np.uint64(1))) ^ text[at + j].astype(np.uint64)
            order = np.argsort(gram, kind="stable")
            gram, at = gram[order], at[order]
            new = np.ones(len(gram), bool)
            new[1:] = gram[1:] != gram[:-1]
            heads_of = at[new]
            spelled = np.stack([text[heads_of + j] for j in range(n)], axis=1) if len(at) else np.zeros((0, n), np.uint32)
            yield chunk.first + first, _Grams(owner[at], np.cumsum(new) - 1, gram[new], spelled, letters)
            first = last


def _bundle(n: int, dimensions: int):
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A sum of text vectors for each language and batch."""
        sums: dict[str, np.ndarray] = {}
        vectors = _Vectors(n, dimensions)
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, grams in _groups(batch.column(1), n):
                # A language's texts of a group are summed as one.
                names, code = np.unique(langs[first : first + len(grams.letters)], return_inverse=True)
                joined = grams._replace(owner=code[grams.owner], letters=np.zeros(len(names)))
                for lang, total in zip(names, joined.sums(vectors), strict=True):
                    sums[lang] = sums.get(lang, 0) + np.rint(total).astype(np.int64)
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "vector": [vector.tolist()]}, schema=pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.int64()))]))

    return bundle


def train(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", n: int = 3, dimensions: int = 1024) -> Prototypes:
    """Prototypes from all rows that have a text and a language.

    Partial sums are added on the executors; the driver gets one vector for each
    language, whose number is that of the languages, not of the documents.
    """
    rows = documents.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(_bundle(n, dimensions), "lang string, vector array<long>")
    sums = sums.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("vector")).orderBy("lang").collect()
    vectors = np.array([r.vector for r in found], np.float64).reshape(len(found), dimensions)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors / np.where(length > 0, length, 1)
    return Prototypes([r.lang for r in found], vectors, vectors.mean(axis=0) if len(found) else np.zeros(dimensions))


def _predict(prototypes: Prototypes, n: int, dimensions: int):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What all languages share says nothing: it is taken from both sides before the cosine.
        spread = len(prototypes.languages) > 1
        own = prototypes.vectors - (prototypes.mean if spread else 0)
        length = np.linalg.norm(own, axis=1, keepdims=True)
        own = (own / np.where(length > 0, length, 1)).astype(np.float32)
        vectors = _Vectors(n, dimensions)
        for batch in batches:
            rows = len(batch.column(1))
            best, score = np.full(rows, -1), np.zeros(rows)
            for first, grams in _groups(batch.column(1), n):
                if not len(own):
                    break
                v = grams.sums(vectors).astype(np.float32)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(size > 0, size, 1) - (prototypes.mean.astype(np.float32) if spread else 0)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                cosine = (v / np.where(size > 0, size, 1)) @ own.T
                some = grams.letters > 0
                at = slice(first, first + len(v))
                best[at] = np.where(some, cosine.argmax(axis=1), -1)
                score[at] = np.where(some, np.clip((cosine.max(axis=1) + 1) / 2, 0, 1), 0)
            names = [prototypes.languages[b] if b >= 0 else "und" for b in best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return predict


def identify(documents: DataFrame, prototypes: Prototypes, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row; score is the cosine moved to 0 .. 1.

    Null, empty and letterless texts, and all texts without prototypes, are ``und``
    with score 0.  Of equal cosines the language that sorts first wins.  Repeated
    rows get the same result each.  Other columns are ignored.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(prototypes, n, prototypes.vectors.shape[1]), "doc_id long, lang_pred string, score double")


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from: remainder 2 of crc32 of the id as text by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))
