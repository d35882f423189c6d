"""Summaries of long sessions in parts, their coverage case by case, veracity with ties."""

from pyspark.sql import functions as F

from memlake.operators import consolidate

ROWS = "session_id long, seq long, id string, content string, valid_until long, scope string, metadata string, veracity string"


def rows_of(session, texts, until=None, scope="session", metadata=None, veracity=None):
    pick = lambda v, k: v[k % len(v)] if isinstance(v, list) else v
    return [(session, k, f"{session}-{k}", t, pick(until, k), pick(scope, k), pick(metadata, k), pick(veracity, k)) for k, t in enumerate(texts)]


def test_coverage_case_by_case(spark):
    cases = {
        1: rows_of(1, ["One  fox", "two\nhens"]),
        2: rows_of(2, ["a", "b"], until=[1, 2]),
        3: rows_of(3, ["a", "b"], until=[None, 2]),
        4: rows_of(4, ["a", "b"], until=[5, 5]),
        5: rows_of(5, ["a", "b"], scope=["global", "session"]),
        6: rows_of(6, ["a", "b"], scope=[None, "session"]),
        7: rows_of(7, ["a", "  "]),
        8: rows_of(8, ["the Blue Lake", "b"], metadata='{"canonical_name": "blue  LAKE", "aliases": ["b"]}'),
        9: rows_of(9, ["a", "b"], metadata='{"canonical_name": "zed"}'),
        10: rows_of(10, ["a", "b"], metadata=['{"canonical_name": "a"}', "{}"]),
        11: rows_of(11, ["a", "b"], metadata="{broken"),
        12: rows_of(12, ["a", "b"], metadata='{"aliases": "a"}'),
        13: rows_of(13, ["a", "b"], metadata='{"aliases": []}'),
        14: rows_of(14, ["a", "b"], metadata='{"canonical_name": 5}'),
        15: rows_of(15, ["a", "b"], metadata='{"canonical_name": "' + "a" * 513 + '"}'),
        16: rows_of(16, ["a", "b"], metadata='{"aliases": ["a", "b"], "other": 1}'),
        17: rows_of(17, ["a", "b"], metadata="[1]"),
    }
    frame = spark.createDataFrame([r for rows in cases.values() for r in rows], ROWS)
    got = {r.session_id: r.verified for r in consolidate.covered(consolidate.consolidate(frame), frame).collect()}
    assert {k for k, v in got.items() if v} == {1, 4, 6, 8, 13, 16}
    told = consolidate.consolidate(frame.where("session_id = 1"))
    for change, good in ((F.upper("summary"), True), (F.concat(F.lit("<think>x\ny</think>"), "summary"), True), (F.concat("summary", F.lit(" | more")), False), (F.expr("substring(summary, 2, 99)"), False), (F.lit(""), False)):
        assert consolidate.covered(told.withColumn("summary", change), frame).first().verified is good


def test_a_long_session_is_several_rows(spark):
    long = rows_of(1, [f"turn {k}" for k in range(1005)]) + rows_of(2, ["x"])
    frame = spark.createDataFrame(long, ROWS).repartition(5)
    made = consolidate.consolidate(frame)
    got = {(r.session_id, r.part): r for r in made.collect()}
    assert sorted(got) == [(1, k) for k in range(6)] + [(2, 0)]
    assert [got[1, k].sources for k in range(6)] == [200] * 5 + [5]
    assert got[1, 5].summary == " | ".join(f"turn {k}" for k in range(1000, 1005)) and got[1, 5].summary_of == [f"1-{k}" for k in range(1000, 1005)]
    assert all(r.verified for r in consolidate.covered(made, frame).collect())
    assert consolidate.consolidate(frame.limit(0)).count() == 0


def test_veracity_and_ties(spark):
    cases = rows_of(1, list("abc"), veracity=["stated", "stated", "tool"]) + rows_of(2, list("ab"), veracity=["stated", "inferred"]) + rows_of(3, list("ab"), veracity=[None, "STATED"]) + rows_of(4, list("abcde"), veracity=["tool", "imported", "imported", "tool", "odd"])
    got = {r.session_id: r.veracity for r in consolidate.veracity(spark.createDataFrame(cases, ROWS)).collect()}
    assert got == {1: "stated", 2: "inferred", 3: "unknown", 4: "imported"}
