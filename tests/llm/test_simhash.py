import random
import re

import numpy as np
import xxhash

from pyspark.sql import functions as F

from memlake.llm import simhash_dedup
from memlake.llm.components import components
from memlake.llm.simhash_dedup import FINER, FIVES, fingerprint, fingerprint_links, list_links, simhash_groups

SCHEMA = "doc_id long, text string, fp string"
MASK = (1 << 64) - 1


def brute_fingerprint(text):
    folded = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", folded) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_of(fps):
    """fp to the smallest signed fingerprint that it reaches."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if ((a ^ b) & MASK).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def flipped(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints():
    for text in (None, "", " \n", "one", "ONE two", "a b c", "a b c a b c a b c", "é É x y z\x0bq", "w " * 70_000, " ".join(map(str, range(5000)))):
        assert fingerprint(text) == brute_fingerprint(text), text and text[:20]


def test_masks():
    assert len(FIVES) == 56 and all(len(m) == 20 for m in FINER)
    rng = random.Random(1)
    for _ in range(200):
        a = rng.getrandbits(64)
        d = a ^ flipped(rng, a, 3)
        assert any(d & m == 0 for m in FIVES)
        assert all(any(d & m == 0 for m in FINER[k]) for k, five in enumerate(FIVES) if d & five == 0)


def links_roots(spark, fps):
    frame = spark.createDataFrame([(signed(f),) for f in sorted(set(fps))], "fp long")
    found = {r.node: r.root for r in components(fingerprint_links(frame)).collect()}
    return {signed(f): found.get(signed(f), signed(f)) for f in fps}


def test_links_match_brute_force(spark, monkeypatch):
    """Clouds around bases, chains of three bits and lone fingerprints; with short lists, the finer ones are used."""
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(150)] + [0, MASK, 7, 15]
    for _ in range(4):
        base = rng.getrandbits(64)
        fps += [flipped(rng, base, rng.choice((0, 1, 2, 3, 4, 6))) for _ in range(120)]
        for _ in range(15):
            base = flipped(rng, base, 3)
            fps.append(base)
    want = roots_of([signed(f) for f in fps])
    assert links_roots(spark, fps) == want
    monkeypatch.setattr(simhash_dedup, "LONGEST_LIST", 5)
    monkeypatch.setattr(simhash_dedup, "BROADCAST_GROUPS", 0)
    assert links_roots(spark, fps) == want


def test_a_long_list_answers_with_a_forest(monkeypatch):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    members = np.array(sorted({signed(base ^ (rng.getrandbits(9) << 20)) for _ in range(400)}), np.int64)
    for block in (1 << 21, 1000):
        monkeypatch.setattr(simhash_dedup, "BLOCK_PAIRS", block)
        a, b = list_links(np.r_[members, members[:2]], np.array([len(members), 2]))
        want = roots_of(members.tolist())
        assert len(a) == len(members) - len(set(want.values())) + ((int(members[0] ^ members[1]) & MASK).bit_count() <= 3)


def test_groups_of_rows(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for size in (1, 2, 40, 300, 300):
        base = [rng.choice(words) for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 9):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(size)] = rng.choice(words)
            rows.append((len(rows) * 7 % 101 + 1000, (" " if edits % 2 else "\n").join(copy), "clash"))
    rows += [(3, "", None), (2, None, None), (9, " ", None), (None, rows[0][1], None), (None, "alone without an id", None), (50, "x", None), (50, "x", None), (50, "y z", None), (60, "very " * 60_000, None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("mask", F.lit(1)).withColumn("root", F.lit("clash"))
    fps = [signed(brute_fingerprint(t)) for _, t, _ in rows]
    roots = roots_of(fps)
    least = {}
    for (i, _, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    want = sorted((str(i), f"{f & MASK:016x}", str(least.get(roots[f])), fps.count(f)) for (i, _, _), f in zip(rows, fps, strict=True))
    got = simhash_groups(frame.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id), r.copies) for r in got) == want
    assert simhash_groups(frame.limit(0)).count() == 0
