"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

A fingerprint of 64 bits has a byte at each of eight positions.  Two fingerprints
that differ in three bits or fewer differ in three bytes or fewer, so their tally
of equal positional bytes is five at least.  The lists of single bytes grow with
the table (each holds 1/256 of it), so the index holds them merged by fives: a
fingerprint is posted under every choice of five positions with its bytes there,
and a pair is in one of these lists exactly if its tally reaches five.  Members of
a list can differ only at the three other positions.  A list that is longer than
``LONGEST_LIST`` is merged further with half bytes of these: of six, three at least
are equal, and no list of that kind can have more than 4,096 members.  A pair is
tallied where its list is, verified by its differing bits, and a list answers with
a spanning forest of its links, so that no group is expanded into all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.components import components
from memlake.llm.session import checkpointed

SEED = 42
BYTES, MOST_BITS = 8, 3
#: Equal positional bytes that two fingerprints within ``MOST_BITS`` have at least.
LEAST_BYTES = BYTES - MOST_BITS
#: Members of a list that are compared directly: as many as a list merged with half bytes has at most.
LONGEST_LIST = 4096
#: Comparisons that are made at once.
BLOCK_PAIRS = 1 << 21
#: Fingerprints with a group of their own that are broadcast (16 bytes each, some 100 MB with Spark's tables); beyond, a shuffle joins them.
BROADCAST_GROUPS = 500_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS_AT_ONCE = 1 << 16


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """SimHash of a text's shingles, repeats included; 0 without words."""
    # Bytes are split at just the six characters of ASCII white space.
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    n = max(1, len(found) - words_per_shingle + 1)
    starts = np.r_[0, ends[: n - 1]].tolist()
    stops = (ends[min(words_per_shingle, len(found)) - 1 :] - 1).tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BITS_AT_ONCE):
        part = hashes[at : at + _BITS_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">u8")[0])


def _fingerprints(words_per_shingle: int):
    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words_per_shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return fingerprints


def _masks(width: int, equal: int, within: int = -1) -> list[int]:
    """Masks over every choice of ``equal`` of the parts of ``width`` bits that lie in ``within``, as signed longs."""
    whole = (1 << width) - 1
    parts = [whole << at for at in range(0, 64, width) if within >> at & whole == whole]
    return [sum(c) - (1 << 64 if sum(c) >> 63 else 0) for c in itertools.combinations(parts, equal)]


#: Five of eight bytes, and for each of these three of the six half bytes at the other positions, too.
FIVES = _masks(8, LEAST_BYTES)
FINER = [[five | three for three in _masks(4, 6 - MOST_BITS, ~five)] for five in FIVES]


def _posted(fingerprints: DataFrame, masks: Column) -> DataFrame:
    """``mask, masked, fp``: every fingerprint under what each of the masks leaves of it."""
    posted = fingerprints.select("fp", F.explode(masks).alias("mask"))
    return posted.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("masked"), "fp")


def _verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs reach the least tally of equal positional bytes and differ in few enough bits."""
    differing = (a ^ b).view(np.uint64)
    tally = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    near = np.flatnonzero(tally >= LEAST_BYTES)
    out = np.zeros(len(a), bool)
    out[near] = np.bitwise_count(differing[near]) <= MOST_BITS
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each of n members reaches over the links a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            return root


def list_links(members: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is connected within each list; ``members`` are the lists one after the other."""
    ends = np.cumsum(sizes)
    # Each member meets those behind it in its list.
    behind = np.repeat(ends, sizes) - np.arange(len(members)) - 1
    cuts = np.r_[0, np.cumsum(behind)]
    links = [np.zeros((0, 2), np.int64)]
    root = np.arange(len(members))
    at = 0
    while at < len(members):
        stop = max(at + 1, int(np.searchsorted(cuts, cuts[at] + BLOCK_PAIRS, "right")) - 1)
        some = behind[at:stop]
        a = np.repeat(np.arange(at, stop), some)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(some) - some, some)
        good = _verified(members[a], members[b])
        # What the blocks before have joined needs no further link.
        good &= root[a] != root[b]
        if good.any():
            links.append(np.c_[a[good], b[good]])
            found = np.concatenate(links)
            root = _forest(len(members), found[:, 0], found[:, 1])
            joined = np.flatnonzero(root != np.arange(len(members)))
            links = [np.c_[joined, root[joined]]]
        at = stop
    found = np.concatenate(links)
    return members[found[:, 0]], members[found[:, 1]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b`` of ``members`` (lists of fingerprints)."""
    for batch in batches:
        column = batch.column(0)
        members = np.asarray(column.flatten()).astype(np.int64)
        a, b = list_links(members, np.asarray(pc.list_value_length(column)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _linked(posted: DataFrame) -> DataFrame:
    lists = posted.groupBy("mask", "masked").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    return lists.select("members").mapInArrow(_links, "a long, b long")


def fingerprint_links(fingerprints: DataFrame) -> DataFrame:
    """``a, b``: links of distinct ``fingerprints(fp)`` that join all that differ in ``MOST_BITS`` bits or fewer."""
    posted = _posted(fingerprints, F.array(*map(F.lit, FIVES)))
    sizes = posted.groupBy("mask", "masked").agg(F.count("*").alias("n")).where("n > 1")
    sizes = checkpointed(sizes)
    few = sizes.count() <= BROADCAST_GROUPS
    held = posted.join(F.broadcast(sizes) if few else sizes, ["mask", "masked"])
    found = _linked(held.where(F.col("n") <= LONGEST_LIST))
    if not sizes.where(F.col("n") > LONGEST_LIST).isEmpty():
        finer = F.create_map(*[F.lit(x) for five, masks in zip(FIVES, FINER, strict=True) for x in (five, F.array(*map(F.lit, masks)))])
        long = held.where(F.col("n") > LONGEST_LIST).select("fp", finer[F.col("mask")].alias("masks"))
        long = long.select("fp", F.explode("masks").alias("mask")).distinct().withColumn("masked", F.col("mask").bitwiseAND(F.col("fp")))
        found = found.union(_linked(long))
    return found


def simhash_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id, copies`` for each row.

    Words are split at ASCII white space, A-Z folded; a text of fewer words than a
    shingle has is one shingle.  A bit is set if more than half of the shingles'
    hashes (XXH64, seed 42) have it.  Null, empty and blank texts have the
    fingerprint 0 and are linked like others.  Rows are linked if their fingerprints
    differ in three bits or fewer; ``component_id`` is the smallest id that can be
    reached, ``copies`` the number of rows with just this fingerprint.  A row without
    an id goes with its text; its ``component_id`` is null if no row of its group has
    an id.  Rows that repeat an id are rows of their own.  Texts of any length are
    read whole.  An empty table gives an empty one.  Other columns are ignored.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = checkpointed(rows.mapInArrow(_fingerprints(words_per_shingle), "doc_id long, fp long"))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")))
    found = components(fingerprint_links(distinct.select("fp")))
    # The roots are no nodes of their own.
    members = found.union(found.select("root", "root").distinct()).toDF("fp", "root")
    linked = distinct.join(members, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.where("fp <> root").groupBy("root").agg(F.min("least_id").alias("other_id"))
    groups = linked.join(least.withColumnRenamed("root", "of_root"), F.col("root") == F.col("of_root"), "left")
    # A root counts for its members, too.
    roots = distinct.select(F.col("fp").alias("root_fp"), F.col("least_id").alias("root_id"))
    groups = groups.join(roots, F.col("root") == F.col("root_fp"), "left")
    groups = groups.select("fp", F.least("other_id", "root_id", "least_id").alias("component_id"), "copies")
    # A fingerprint of one row in a group of its own needs no row of the join.
    several = checkpointed(groups.join(members.select("fp"), "fp", "left_semi").union(groups.where("copies > 1").join(members.select("fp"), "fp", "left_anti")))
    few = several.count() <= BROADCAST_GROUPS
    out = rows.join(F.broadcast(several) if few else several, "fp", "left")
    component = F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
