import random
import re

from pyspark.sql import functions as F

from memlake.llm.minhash_dedup import match_threshold, near_duplicates

SCHEMA = "doc_id long, text string, n_shingles string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows, num, den):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * shared >= num * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_groups_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for size in (3, 5, 8, 40, 120, 120, 300):
        base = [rng.choice(words) for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 5, 6, 8, 10, 12):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(size)] = rng.choice(words)
            rows.append((i * 3 % 1009, (" " if edits % 2 else "\n").join(copy).title() if edits % 3 else " ".join(copy)))
            i += 1
    rows += [(2000, ""), (2001, "   \t"), (2002, None), (2003, "one"), (2004, "ONE "), (2005, "Élan vital"), (2006, "élan vital")]
    want = brute(rows, 85, 100)
    # A near group around a base that isn't there itself, every copy with other edits.
    frame = spark.createDataFrame([(a, b, "other column") for a, b in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame, num=85, den=100).collect()}
    assert got == want
    assert all(r.kept == (r.doc_id == want[r.doc_id][1]) for r in near_duplicates(frame, num=85, den=100).collect())


def test_large_near_group_without_its_base(spark):
    rng = random.Random(9)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(1 + i % 4):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), num=85, den=100).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 85, 100).items()}


def test_empty_table_repeated_rows_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    frame = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = near_duplicates(frame).collect()
    assert sorted((r.component_id, r.kept) for r in got if r.doc_id is not None) == [(2, False), (2, False), (2, True)]
    # A row without an id goes with its text.
    assert sorted((str(r.component_id), r.kept) for r in got if r.doc_id is None) == [("2", False), ("None", True)]


def test_an_id_with_two_texts_long_texts_and_clashing_columns(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, "a b c d e f g", 0), (1, "p q r s t u v", 0), (5, "p q r s t u v", 0), (7, long, 0), (8, long + " more", 0), (None, "k l m n o p", 0), (None, "k l m n o p", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, token long")
    for name in ("rep", "root", "pivot", "tokens", "id", "delta", "element", "group_key", "row_key"):
        frame = frame.withColumn(name, F.lit("clash"))
    got = near_duplicates(frame.repartition(3), num=85, den=100).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got) == [(0, 2, None, True), (0, 2, None, True), (1, 3, 1, True), (1, 3, 1, True), (5, 3, 1, False), (7, 59_996, 7, True), (8, 59_997, 7, False)]
    assert len({r.group_key for r in got}) == 4


def test_links_that_only_differences_show(spark):
    """Two clouds around bases that are not there, near each other, and members at any distance of them."""
    rng = random.Random(4)
    rows = []
    for cloud in range(2):
        base = [f"b{i}" for i in range(200)]
        for k in range(12 * cloud):
            base[k * 15] = f"other{k}"
        for i in range(90):
            copy = list(base)
            for _ in range(rng.choice((1, 2, 4, 6, 7, 9))):
                copy[rng.randrange(200)] = f"x{rng.randrange(40) if i % 3 else rng.randrange(10**6)}"
            rows.append((cloud * 1000 + i, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), num=85, den=100).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 85, 100).items()}


def test_threshold_is_low_enough():
    assert match_threshold(0.85, 64) == 40
    assert match_threshold(0.0001, 8) == 1
    assert F is not None
