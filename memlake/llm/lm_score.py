"""Cross-entropy difference between a target and a background language model.

Both are word bigram models, interpolated with unigrams, over one vocabulary: all
words and word pairs are counted exactly, by hashes of 63 bits.  The counts are a
table that is dealt over the cluster by ranges of the hash.  A pack of documents
asks each range for the words and pairs that it has, once each, and gets their
counts back, so no key gathers more rows than there are packs.  The
background's counts are scaled to the target's number of words, so the two are
smoothed alike.  A document's score is the mean difference of its words' losses;
each word is judged by counts without its own occurrence, so that a document that
a model has seen gains nothing by that.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.session import checkpointed, give_back
from memlake.llm.textscan import ALNUM, Chunk, chunks, mix, multipliers, words

#: Bytes of text whose keys one range of the hash holds, about, and the ranges that small inputs have at most.
RANGE_BYTES, SMALL_RANGES = 16_000_000, 1000
#: Most target ids that are broadcast; beyond, a shuffle joins them.
BROADCAST_IDS = 1_000_000


class Model(NamedTuple):
    """Counts by key, a row for each range; number of words of target and background, of different words, of ranges."""

    counts: DataFrame
    target_words: int
    words: int
    kinds: int
    ranges: int


def _keys(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, word key (odd) and pair key (even) of each word; a text's first word pairs with a start mark."""
    found = words(chunk, ALNUM)
    before = np.zeros(len(found.hash), np.uint64)
    if len(before):
        same = found.doc[1:] == found.doc[:-1]
        before[1:] = np.where(same, found.hash[:-1], np.uint64(0))
    pair = mix(found.hash + before * multipliers(1, 31)[0])
    return found.doc, found.hash | np.uint64(1), pair & ~np.uint64(1)


def _cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of the hash begins in sorted keys, and their end."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))


def _squeezed(raw: bytes, level: int) -> bytes:
    """Compressed harder than Arrow does by itself: packs are written and moved once each, and time is there."""
    return pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def _packed(values: np.ndarray) -> bytes:
    """64-bit numbers as compressed planes of bytes."""
    return _squeezed(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes(), 6)


def _unpacked(blob: bytes, n: int, kind: type) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, n * 8, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(kind).ravel()


def _sorted_keys(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(blob, n, np.uint64), dtype=np.uint64)


def _packed_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _counts(chunk: Chunk, wanted: np.ndarray, ranges: int) -> pa.RecordBatch:
    """``part, n, keys, target, everything``: counts of a chunk's keys, a row for each range."""
    doc, word, pair = _keys(chunk)
    both, own = np.concatenate([word, pair]), wanted[np.concatenate([doc, doc])]
    keys, everything = np.unique(both, return_counts=True)
    target = np.zeros(len(keys), np.int64)
    some, times = np.unique(both[own], return_counts=True)
    target[np.searchsorted(keys, some)] = times
    cuts = _cuts(keys, ranges)
    parts = np.flatnonzero(np.diff(cuts))
    rows = [slice(cuts[k], cuts[k + 1]) for k in parts]
    columns = [[f(values[r]) for r in rows] for f, values in ((_packed_keys, keys), (_packed, target), (_packed, everything.astype(np.int64)))]
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(np.diff(cuts)[parts].astype(np.int64)), *[pa.array(c, pa.binary()) for c in columns]], ["part", "n", "keys", "target", "everything"])


def _counted(ranges: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.asarray(batch.column(0).cast(pa.int8())) == 1
            for chunk in chunks(batch.column(1)):
                yield _counts(chunk, wanted[chunk.first : chunk.first + len(chunk.bounds) - 1], ranges)
            give_back()

    return counted


def _counted_packs(ranges: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, wanted, bounds, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = _counts(_chunk(bounds, text), np.array(wanted, bool), ranges)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(out.num_rows, pack, np.int64))], [*out.schema.names, "pack"])
                give_back()

    return counted


_TABLE = "part int, n long, keys binary, target binary, everything binary, kinds long, target_words long, words long"


def _summed(rows: pa.Table) -> pa.Table:
    """A range's counts.  What occurs once in all isn't listed: without its own occurrence it counts 0, as what is not there."""
    sizes = rows["n"].to_pylist()
    keys = np.concatenate([_sorted_keys(b, n) for b, n in zip(rows["keys"].to_pylist(), sizes, strict=True)])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    target, everything = (np.add.reduceat(np.concatenate([_unpacked(b, n, np.int64) for b, n in zip(rows[c].to_pylist(), sizes, strict=True)])[order], first) for c in ("target", "everything"))
    keys = keys[first]
    word = keys & np.uint64(1) == 1
    kept = everything > 1
    row = {"part": rows["part"][0].as_py(), "n": int(kept.sum()), "keys": _packed_keys(keys[kept]), "target": _packed(target[kept]), "everything": _packed(everything[kept])}
    row |= {"kinds": int(word.sum()), "target_words": int(target[word].sum()), "words": int(everything[word].sum())}
    kinds = {"part": pa.int32(), "keys": pa.binary(), "target": pa.binary(), "everything": pa.binary()}
    return pa.table({c: pa.array([v], kinds.get(c, pa.int64())) for c, v in row.items()})


def _flagged(documents: DataFrame, target_ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, wanted`` for each row: whether it is of the target.  The ids' number is checked before they are broadcast."""
    ids = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("id")).dropna().distinct().withColumn("wanted", F.lit(True))
    few = ids.count() <= BROADCAST_IDS
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.join(F.broadcast(ids) if few else ids, "id", "left").select("id", "text", F.coalesce("wanted", F.lit(False)).alias("wanted"))


def _ranges(documents: DataFrame, text_col: str) -> int:
    size = documents.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(size // RANGE_BYTES, min(4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), SMALL_RANGES))


def train(documents: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Both models: the target's from the documents of ``target_ids(id)``, the background's from all documents.

    Null and empty texts count nothing.  Without target documents both models are
    the background's, and every score is 0.
    """
    ranges = _ranges(documents, text_col)
    flagged = _flagged(documents, target_ids, id_col, text_col).select("wanted", "text")
    sent = flagged.mapInArrow(_counted(ranges), "part int, n long, keys binary, target binary, everything binary")
    counts = checkpointed(sent.groupBy("part").applyInArrow(_summed, _TABLE))
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("target_words", "words", "kinds")]).first()
    return Model(counts, *sums, ranges)


_PACK = "ids array<long>, wanted array<boolean>, bounds array<long>, text binary"


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents, their texts compressed."""
    for batch in batches:
        for chunk in chunks(batch.column(1)):
            size = len(chunk.bounds) - 1
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (batch.column(0).slice(chunk.first, size), batch.column(2).slice(chunk.first, size), pa.array(chunk.bounds))]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([_squeezed(chunk.bytes.tobytes(), 9)], pa.binary())], ["ids", "wanted", "bounds", "text"])
            give_back()


def _chunk(bounds: list[int], text: bytes) -> Chunk:
    raw = pa.decompress(text, bounds[-1], "zstd", asbytes=True) if bounds[-1] else b""
    return Chunk(0, np.frombuffer(raw, np.uint8), np.array(bounds, np.int64))


def _asked(ranges: int):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``part, pack, n, keys``: the keys of a pack, a row for each range."""
        for batch in batches:
            for pack, bounds, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, word, pair = _keys(_chunk(bounds, text))
                keys = np.unique(np.concatenate([word, pair]))
                cuts = _cuts(keys, ranges)
                parts = np.flatnonzero(np.diff(cuts))
                blobs = [_packed_keys(keys[cuts[k] : cuts[k + 1]]) for k in parts]
                yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(np.full(len(parts), pack, np.int64)), pa.array(np.diff(cuts)[parts].astype(np.int64)), pa.array(blobs, pa.binary())], ["part", "pack", "n", "keys"])

    return asked


def _answered(table: pa.Table, rows: pa.Table) -> pa.Table:
    """The counts of the asked keys, in their order; 0 for those that the table hasn't."""
    out: dict[str, list[bytes]] = {"target": [], "everything": []}
    n = table["n"][0].as_py() if table.num_rows else 0
    own = _sorted_keys(table["keys"][0].as_py(), n) if n else np.zeros(0, np.uint64)
    counts = {c: np.r_[_unpacked(table[c][0].as_py(), n, np.int64) if n else np.zeros(0, np.int64), 0] for c in out}
    own = np.r_[own, np.uint64(0)]
    for blob, size in zip(rows["keys"].to_pylist(), rows["n"].to_pylist(), strict=True):
        keys = _sorted_keys(blob, size)
        at = np.searchsorted(own[:-1], keys)
        at = np.where(own[at] == keys, at, n)
        for c, blobs in out.items():
            blobs.append(_packed(counts[c][at]))
    return pa.table({"part": rows["part"], "pack": rows["pack"], "n": rows["n"], **{c: pa.array(b, pa.binary()) for c, b in out.items()}})


_SETTLED = "part int, pack long, n long, target binary, everything binary, kinds long, target_words long, words long"


def _settled(rows: pa.Table) -> pa.Table:
    """A range's answers to the packs that sent it counts; its sums are in the first row."""
    table = _summed(rows)
    out = _answered(table, rows)
    for c in ("kinds", "target_words", "words"):
        out = out.append_column(c, pa.array([table[c][0].as_py(), *[0] * (out.num_rows - 1)], pa.int64()))
    give_back()
    return out


def _losses(model: tuple[int, int, int], weight: float, prior: float):
    target_words, all_words, kinds = model

    def losses(packs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _chunk(packs["bounds"][0].as_py(), packs["text"][0].as_py())
        ids, wanted = packs["ids"].combine_chunks().flatten(), np.array(packs["wanted"][0].as_py(), np.int64)
        doc, word, pair = _keys(chunk)
        rows = len(chunk.bounds) - 1
        keys = np.unique(np.concatenate([word, pair]))
        answers = answers.sort_by("part")
        sizes = answers["n"].to_pylist()
        word, pair = np.searchsorted(keys, word), np.searchsorted(keys, pair)
        n, mean = np.bincount(doc, minlength=rows), np.zeros((2, rows))
        # A pair's chance by the words before it; the first word of a text has only its own.
        opens = np.ones(len(doc), bool)
        opens[1:] = doc[1:] != doc[:-1]
        context = np.r_[word[:1], word[:-1]]
        mass = float(target_words or all_words)
        for k, c in enumerate(("target", "everything")):
            if k == 0 and not target_words:
                c = "everything"
            counts = np.concatenate([np.zeros(0, np.int64), *[_unpacked(b, m, np.int64) for b, m in zip(answers[c].to_pylist(), sizes, strict=True)]])
            less = wanted[doc] if c == "target" else 1
            scale = 1.0 if c == "target" else mass / max(1.0, all_words)
            base = (np.maximum(0, counts[word] - less) * scale + prior) / (mass + prior * max(1, kinds))
            own = np.maximum(0, counts[context] - less)
            chance = np.minimum(1, np.maximum(0, counts[pair] - less) / np.maximum(own, 1))
            p = np.where(opens | (own <= 0), base, weight * chance + (1 - weight) * base)
            mean[k] = np.bincount(doc, -np.log(p), rows) / np.maximum(1, n)
        give_back()
        return pa.table([ids, pa.array(n.astype(np.int64)), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[0] - mean[1])], ["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    return losses


def score_documents(documents: DataFrame, model: Model, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: float = 0.6, prior: float = 0.1) -> DataFrame:
    """``doc_id, n_tokens, loss_target, loss_background, score`` for each row, losses in nats per word.

    ``score = loss_target - loss_background``: the lower, the more a text is like
    the target.  The documents are those that the model is of.  Words are runs of
    letters and digits, A-Z folded.  Null texts and those without words have 0
    throughout.  Repeated rows get the same score each.  Other columns are ignored.
    """
    rows = _flagged(documents, target_ids, id_col, text_col)
    # Packs are numbered once, in the checkpoint folder: asking and answering see the same ones.
    packs = checkpointed(rows.mapInArrow(_packs, _PACK).withColumn("pack", F.monotonically_increasing_id()))
    asked = packs.select("pack", "bounds", "text").mapInArrow(_asked(model.ranges), "part int, pack long, n long, keys binary")
    answers = model.counts.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_answered, "part int, pack long, n long, target binary, everything binary")
    scored = _losses((model.target_words, model.words, model.kinds), weight, prior)
    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(scored, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")


def train_and_score(documents: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: float = 0.6, prior: float = 0.1) -> DataFrame:
    """The rows of ``score_documents`` by the model of the same documents: each pack sends its counts once and is answered."""
    ranges = _ranges(documents, text_col)
    packs = checkpointed(_flagged(documents, target_ids, id_col, text_col).mapInArrow(_packs, _PACK).withColumn("pack", F.monotonically_increasing_id()))
    sent = packs.select("pack", "wanted", "bounds", "text").mapInArrow(_counted_packs(ranges), "part int, n long, keys binary, target binary, everything binary, pack long")
    settled = checkpointed(sent.groupBy("part").applyInArrow(_settled, _SETTLED))
    sums = settled.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("target_words", "words", "kinds")]).first()
    answers = settled.select("part", "pack", "n", "target", "everything")
    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(_losses(tuple(sums), weight, prior), "doc_id long, n_tokens long, loss_target double, loss_background double, score double")
