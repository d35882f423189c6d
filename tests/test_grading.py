"""Generated lives: what is made of a small table of ids is never broadcast by the ids' size."""

import pytest

from memlake.operators import grading as G
from memlake.operators import scoring as S
from memlake.plans import grading, scoring

SF_DIR = "/root/testdata/sf0.1"


def planned(query, spark):
    return query(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["probe_grades", "grade_summary", "prefetch_grades", "provenance_grades", "arm_grades", "aa_grades", "backtest_states", "staged_observations", "life_transfer"])
def test_lives_are_not_broadcast(spark, name):
    """A table of ids of a few MB stands for gigabytes of events: a broadcast of these stops the driver."""
    query = getattr(scoring if name == "backtest_states" else grading, name)
    assert "BroadcastHashJoin" not in planned(query, spark)


def test_secrets_move_without_their_texts(spark):
    """A text of many words isn't copied for each of them; secrets of texts with equal words are told apart."""
    planted = spark.createDataFrame([(1, "item1 passes", "item1"), (2, "item2 passes", "item2"), (3, "item3 passes", "item3")], "secret_id long, secret string, token string")
    kept = spark.createDataFrame([("an ITEM1 Passes here",), ("an item2 fails, and passes",), ("an ITEM1 Passes here",), (None,)], "content string")
    found = G.secrets_stored(planted, kept)
    assert found.collect() == [(3, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    exploded = [line for line in plan.splitlines() if "Generate explode" in line]
    # An exploded row keeps the key alone: the text is left out of it.
    assert exploded and all("[0]" in line or "[1]" in line for line in exploded), exploded


def test_rules_meet_items_by_word(spark):
    """Every word of a label's rules is looked up, no item is compared with every rule; rows without an id keep theirs."""
    items = [(k, "x" if k % 2 else "y", f"The WORD{k % 7} and w{k}", f"Word{k % 5}") for k in range(60)] + [(None, "x", "a word1 without id", "a"), (3, "x", "other text of 3", "zz"), (70, None, "word1", "word1")]
    frame = spark.createDataFrame(items, "id long, canonical_name string, content string, alias string")
    found = S.alias_fixes(frame.where("id % 10 = 1"), frame)
    rules = {(c, a.lower()) for i, c, _, a in items if i is not None and i % 10 == 1 and c and len(a) >= 2}
    want = {(i, f"{c}: {t}") for i, c, t, _ in items for w in t.lower().split() if (c, w) in rules}
    assert {tuple(r) for r in found.collect()} == want and (None, "x: a word1 without id") in want
    assert "array_contains" not in found._jdf.queryExecution().optimizedPlan().toString()
