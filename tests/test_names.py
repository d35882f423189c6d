"""Names one edit, or a share of edits, apart: all pairs compared in plain Python, and how few are met."""

import random

import pytest

from memlake.functions import text as T
from memlake.operators import graph, labels


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b):
    if a == b:
        return 1.0
    r = min(len(a), len(b)) / max(len(a), len(b))
    if a.startswith(b) or b.startswith(a):
        return 0.7 + 0.3 * r
    if a in b or b in a:
        return 0.5 + 0.3 * r
    return 1 - distance(a, b) / max(len(a), len(b))


def near(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 2 or max(len(a), len(b)) > 512 or not (a[:2] == b[:2] or (len(a) == len(b) and a[:2] == b[1::-1])):
        return False
    swapped = len(a) == len(b) and any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1))
    return swapped or distance(a, b) <= 1


def words(rng, n, letters="abcde"):
    out = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(n)}
    for w in sorted(out)[: n // 2]:
        at = rng.randrange(len(w) + 1)
        out |= {w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :] or "a", w[::-1], w + w}
    return sorted(out)


def named(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


@pytest.mark.parametrize("threshold", [0.95, 0.8, 0.72, 0.6, 0.5, 0.35])
def test_fuzzy_names_are_exact_at_any_threshold(spark, threshold):
    rng = random.Random(int(threshold * 100))
    left, right = words(rng, 60) + ["", "é\U0001f600x"], words(rng, 60) + ["é\U0001f600xy", "long" * 30]
    got = {(r.a, r.b): r.similarity for r in graph.fuzzy_matches(named(spark, left + [None] + left[:3]), named(spark, right + [None]), threshold).collect()}
    want = {(a, b): s for a in left for b in right if round(s := alike(a, b), 6) >= threshold}
    assert set(got) == set(want) and len(want) > 3
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_thresholds_out_of_range(spark):
    for bad in (0, 1.2, -1):
        with pytest.raises(ValueError):
            graph.fuzzy_matches(named(spark, ["a"]), named(spark, ["a"]), bad)
    assert graph.fuzzy_matches(named(spark, []), named(spark, ["a"])).count() == 0


def test_one_edit_is_exact(spark):
    rng = random.Random(7)
    left, right = words(rng, 120, "abc"), words(rng, 120, "abc") + ["", "x" * 513, "x" * 512]
    left += ["x" * 513, "x" * 511]
    got = {(r.a, r.b) for r in graph.one_edit_pairs(named(spark, left), named(spark, right)).collect()}
    assert got == {(a, b) for a in set(left) for b in set(right) if near(a, b)}


def test_few_pairs_are_met(spark):
    """Two thousand names with the same first letters: candidates stay near the pairs that are found."""
    rng = random.Random(8)
    names = sorted({"ab" + "".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(2000)})
    typed = [n[:4] + n[5:] for n in names]
    met = graph.one_edit_candidates(named(spark, typed), named(spark, names)).count()
    assert len(names) <= met <= 2 * len(names)
    fuzzy = graph.fuzzy_candidates(named(spark, typed), named(spark, names), 0.8).count()
    assert len(names) <= fuzzy <= len(names) ** 2 / 10


def test_collisions_are_exact(spark):
    rng = random.Random(9)
    pool = words(rng, 25, "abcd")
    known = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 5))) for _ in range(60)] + ["", "x " * 17]
    queries = [(q, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for q in range(80)] + [(90, None), (91, known[3][:-1] + "Z")]
    frame = spark.createDataFrame(queries, "query_id long, query string")
    got = {(r.query_id, r.label) for r in labels.collisions(frame, spark.createDataFrame([(k,) for k in known], "label string")).collect()}
    want = set()
    for q, text in queries:
        ws = (text or "").lower().split()
        for label in set(known):
            own = label.split()
            if 1 <= len(own) <= 16:
                for i in range(len(ws) - len(own) + 1):
                    odd = [(a, b) for a, b in zip(ws[i : i + len(own)], own, strict=True) if a != b]
                    if not odd or (len(odd) == 1 and near(*odd[0])):
                        want.add((q, label))
    assert got == want and len(want) > 50


def test_keys_of_near_names_meet(spark):
    rows = [("label", "lable"), ("label", "labels"), ("ab", "ba"), ("abc", "ab"), ("mango", "manog")]
    frame = spark.createDataFrame(rows, "a string, b string")
    from pyspark.sql import functions as F

    assert all(r.m for r in frame.select(F.arrays_overlap(T.one_edit_keys(F.col("a")), T.one_edit_keys(F.col("b"))).alias("m")).collect())


def test_few_windows_are_compared(spark):
    """Labels that share a half, asked about by very many queries: windows meet the labels that they may name, once."""
    known = spark.createDataFrame([(f"red w{k:03d}x{k:03d}",) for k in range(300)], "label string").selectExpr("label", "split(label, ' ') as own")
    queries = spark.createDataFrame([(q, f"a red w{q % 300:03d}x{q % 300:03d} please") for q in range(3000)], "query_id long, query string")
    windows = labels.query_windows(queries, known)
    assert labels.collision_candidates(windows, known).count() < 2000
    assert labels.collisions(queries, known.select("label")).count() >= 3000


def test_names_with_the_same_pairs_elsewhere_do_not_meet(spark):
    """Halves of a name that change places share nearly all pairs of letters, none at places that few edits reach."""
    pairs = [("abcdefghij", "fghijabcde"), ("abcdefghij", "abcdxfghij")]
    left, right = (spark.createDataFrame([(p[i],) for p in pairs], f"{c} string").distinct() for i, c in enumerate("ab"))
    assert {(r.a, r.b) for r in graph.edit_candidates(left, right, 0.8).collect()} == {pairs[1]}


def test_names_come_from_one_pass_over_the_texts(spark):
    from memlake.plans import knowledge

    sf_dir = "/root/testdata/sf0.001"
    for query in (knowledge.fuzzy_entities, knowledge.loose_entities, knowledge.one_edit):
        assert "documents.parquet" not in query(spark, sf_dir)._jdf.queryExecution().toString()
