"""Automatic recall against plain Python: greedy folding, coverage, the budget, whole contexts."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import labels, prefetch, rerank

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def folded(rows, jaccard=0.72, containment=0.86):
    kept = []
    for i, tokens in rows:
        own = set(tokens)
        if own and not any(len(own & k) / len(own | k) >= jaccard or len(own & k) / min(len(own), len(k)) >= containment for _, k in kept):
            kept.append((i, own))
    return [i for i, _ in kept]


def test_folding_matches_plain_python(spark):
    rng = random.Random(1)
    rows = [(q, i, i, [f"t{rng.randrange(12)}" for _ in range(rng.randrange(0, 9))]) for q in range(6) for i in range(25)]
    frame = spark.createDataFrame(rows, "query_id long, id long, rank long, tokens array<string>")
    got = {}
    for r in rerank.collapse_near_duplicates(frame).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    for q in range(6):
        assert [i for _, i in sorted(got.get(q, []))] == folded([(i, t) for p, i, _, t in rows if p == q])


def test_coverage_matches_plain_python(spark):
    """The greedy order with its two gates: short queries and few rows keep their order."""
    rng = random.Random(2)
    sizes = [12, 12, 12, 5, 4, 9, 1]
    words = [4, 8, 3, 8, 8, 5, 4]
    rows = [(q, i, i, words[q], sorted({f"t{rng.randrange(words[q])}" for _ in range(rng.randrange(0, 5))})) for q in range(7) for i in range(sizes[q])]
    frame = spark.createDataFrame(rows, "query_id long, id long, rank long, words int, hits array<string>")
    got = {}
    for r in rerank.coverage_rerank(frame, k=5).collect():
        got.setdefault(r.query_id, {})[r.position] = r.id
    for q in range(7):
        left, seen, want = [(i, set(h)) for p, i, _, _, h in rows if p == q], set(), []
        greedy = words[q] >= 4 and sizes[q] > 5
        for _ in range(min(5, sizes[q])):
            best = max(left, key=lambda e: (len(e[1] - seen) if greedy else 0, -e[0]))
            left.remove(best)
            seen |= best[1]
            want.append(best[0])
        assert [got[q][k + 1] for k in range(len(want))] == want and len(got[q]) == len(want)


def contexts(spark, cases):
    """The rendered text of each (blocks, budget)."""
    out = {}
    for budget in {b for _, b in cases}:
        rows = [(n, at, k, line) for n, (blocks, b) in enumerate(cases) if b == budget for at, block in enumerate(blocks) for k, line in enumerate(block)]
        frame = spark.createDataFrame(rows, "query_id long, block int, position long, line string")
        out |= {r.query_id: (r.context, r.truncated) for r in prefetch.render(frame, budget).collect()}
    return [out[n] for n in range(len(cases))]


def test_budget_never_overflows_and_keeps_what_fits(spark):
    rng = random.Random(3)
    cases = []
    for n in range(240):
        blocks = [[" ".join("word"[: rng.randrange(1, 5)] for _ in range(rng.randrange(1, 120))) for _ in range(rng.randrange(1, 6))] for _ in range(rng.randrange(1, 4))]
        cases.append((blocks, (256, 300, 777, 1500, 2999)[n % 5]))
    for (blocks, budget), (text, cut) in zip(cases, contexts(spark, cases), strict=True):
        whole = "\n\n".join("\n".join(b) for b in blocks)
        assert len(text) <= budget
        if len(whole) <= budget:
            assert (text, cut) == (whole, False)
        else:
            assert cut and ("truncated" in text or "omitted" in text)
            # All lines before the first that is cut stand whole.
            assert whole.startswith(text.split(" …")[0])


def test_budget_cases(spark):
    """A long line is cut to its share and others follow it; a line that nearly fits closes the text; blanks add nothing."""
    long = "abcd " * 200
    mark, more = prefetch.CUT_MARK, prefetch.LEFT_OUT_MARK
    got = contexts(spark, [([[long, "next"]], 600), ([["x" * 500, "y " * 80]], 600), ([["x" * 599, ""]], 600), ([["a", "b"], ["c"]], 600), ([["x" * 2000]], 600), ([["x" * 590, "   " * 20]], 600)])
    share = 150
    assert got[0] == ("abcd " * ((share - len(mark)) // 5 - 1) + "abcd" + mark + "\nnext", True)
    assert got[1][1] and got[1][0].endswith(more) and got[1][0].startswith("x" * 500) and len(got[1][0]) <= 600
    assert got[2] == ("x" * (600 - len(more)) + more, True) or got[2] == ("x" * 599 + "\n", False)
    assert got[3] == ("a\nb\n\nc", False)
    assert got[4] == ("x" * (share - len(mark)) + mark, True)
    assert got[5][1] and got[5][0].endswith(more)


def test_bank_and_context(spark):
    rows = [
        (1, 1, "the deployment runs every friday evening", "fact", 0.9, 0.9, 0.5, None, None, False, "2024-01-02T03:04:05"),
        (1, 2, "deployment runs every friday evening then", "note", 0.9, 0.8, 0.5, None, None, False, None),
        (1, 3, "[ASSISTANT] deployment talk about nothing", "note", 0.9, 0.95, 0.9, None, None, False, None),
        (1, 4, "almost", "note", 0.9, 0.95, 0.9, None, None, False, None),
        (1, 5, "an unrelated sentence here", "note", 0.9, 0.95, 0.01, None, None, False, None),
        (1, 6, "matched by its entity alone", "conversation", 0.7, 0.1, None, None, None, True, None),
        (1, 7, "raw tool output about deployment hosts", "conversation_tool", 0.9, 0.9, 0.9, None, None, False, None),
    ]
    schema = "query_id long, id long, content string, source string, importance double, score double, keyword_score double, fts_score double, dense_score double, matched boolean, timestamp string"
    frame = spark.createDataFrame(rows, schema)
    assert [(r.position, r.id) for r in sorted(prefetch.bank(frame, prefetch.profile()).collect())] == [(1, 1), (2, 6)]
    wider = prefetch.Profile("tools", include_raw_tools=True)
    prefetch.register_profile(wider)
    assert {r.id for r in prefetch.bank(frame, prefetch.profile("tools")).collect()} == {1, 6, 7}
    assert prefetch.profile("unknown").name == "general"
    lines = prefetch.bank(frame, prefetch.profile())
    none = lines.limit(0)
    context = prefetch.render(prefetch.blocks(none, none, lines)).collect()
    assert context[0].context.split("\n")[:2] == ["## Memories", "  [2024-01-02T03:04] (importance 0.90, source fact) the deployment runs every friday evening"]
    assert prefetch.bank(frame.limit(0), prefetch.profile()).count() == 0


def test_registered_source(spark):
    prefetch.register_source("echo", lambda queries: queries.select("query_id", F.lit(1).alias("position"), F.col("query").alias("line")))
    asked = spark.createDataFrame([(1, "hello")], "query_id long, query string")
    assert [tuple(r) for r in prefetch.source_lines("echo", asked).collect()] == [(1, 1, "hello")]
    assert prefetch.source_lines("nothing", asked) is None


@pytest.mark.parametrize(("a", "b", "near"), [("aba", "ba", False), ("a", "a", True), ("mango", "mongo", False), ("mango", "mnago", False), ("mango", "manog", True), ("ab", "ba", True), ("abc", "ab", True), ("s", "ts", False), ("label", "lable", True), ("label", "labels", True), ("abcd", "abdce", False)])
def test_one_edit_cases(spark, a, b, near):
    for x, y in ((a, b), (b, a)):
        frame = spark.createDataFrame([(x, y)], "a string, b string")
        assert frame.select(T.one_edit(F.col("a"), F.col("b")).alias("n")).first().n == near


def test_label_windows(spark):
    cases = [("what does the Blue Lake do", "blue lake", True), ("what does the blu lake do", "blue lake", True), ("blu lak", "blue lake", False), ("lake", "blue lake", False), ("", "x", False), ("x", "", False)]
    frame = spark.createDataFrame(cases, "q string, l string, want boolean")
    for r in frame.select(labels.names_label(labels.label_tokens("q"), labels.label_tokens("l")).alias("got"), "want", "q").collect():
        assert r.got == r.want, r.q


def test_slots_are_not_gathered_by_pairs_with_queries(spark):
    """Equal slots add up, no confidence comes last, and no aggregation has a slot's text beside a query."""
    live = [("m", "ring_a", "gold", 0.5), ("m", "ring_a", "gold", 0.5), ("m", "ring_b", "gold", 0.9), ("m", "ring_c", "gold", None), ("m", "ring_d", "gold", 0.9), ("m", "hat", "felt", 1.0)]
    slots = spark.createDataFrame(live, "category string, name string, body string, confidence double")
    asked = spark.createDataFrame([(1, "golden ring of gold"), (2, "felt"), (3, "nothing")], "query_id long, query string")
    out = prefetch.slots(asked, slots, limit=3)
    got = sorted((r.query_id, r.position, r.name, r.overlap) for r in out.collect())
    assert got == [(1, 1, "ring_a", 4), (1, 2, "ring_b", 2), (1, 3, "ring_d", 2), (2, 1, "hat", 1)]
    assert len(prefetch.slots(asked, slots, limit=9).where("query_id = 1").collect()) == 4
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Aggregate" in line and "query_id" in line and "body" in line for line in plan)


def plan_nodes(node):
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from plan_nodes(children.apply(i))


def test_slots_meet_queries_by_sets_of_words(spark):
    """Slots that share a word with all queries are no rows of pairs, and are tokenised once."""
    live = spark.createDataFrame([("m", f"ring_{i}", "gold", i / 200) for i in range(200)], "category string, name string, body string, confidence double")
    asked = spark.createDataFrame([(q, f"the ring of king {q}") for q in range(40)], "query_id long, query string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = prefetch.slots(asked, live, limit=3)
        got = {}
        for r in out.collect():
            got.setdefault(r.query_id, {})[r.position] = r.name
        plan = list(plan_nodes(out._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {q: {1: "ring_199", 2: "ring_198", 3: "ring_197"} for q in range(40)}
    joined = [n.metrics().get("numOutputRows").get().value() for n in plan if "Join" in n.nodeName()]
    assert joined and max(joined) <= 200
    assert not any("Filter" in line and "regexp_extract_all" in line and "concat_ws" in line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines())


@pytest.mark.parametrize("words", [100_000, 5])
def test_slots_match_plain_python(spark, monkeypatch, words):
    """Copies, missing fields and confidences, several rows of a query, with the queries' words sent to the slots and not."""
    monkeypatch.setattr(prefetch, "BROADCAST_WORDS", words)
    rng = random.Random(4)
    terms = [f"w{i:02d}" for i in range(12)]
    live = [(rng.choice(["w00", "w01", None]), "-".join(rng.sample(terms, rng.randrange(1, 4))), rng.choice([None, "w02", "w03:w04"]), rng.choice([None, 0.1, 0.5, 0.5])) for _ in range(160)]
    live += [r for r in live if rng.random() < 0.4]
    asked = [(q % 20, " ".join(rng.sample(terms, rng.randrange(0, 6)))) for q in range(30)] + [(20, None)]
    frames = spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame(live, "category string, name string, body string, confidence double")
    for limit, least in ((3, 1), (7, 3)):
        got = {}
        for r in prefetch.slots(*frames, limit=limit, least=least).collect():
            got.setdefault(r.query_id, []).append((r.position, r.overlap, r.category, r.name))
        for q in range(21):
            own = {w for p, text in asked if p == q and text for w in text.split()}
            met = [(len(own & {w for part in s[:3] if part for w in part.replace(":", "-").split("-")}) * live.count(s), s) for s in set(live)]
            best = sorted((m for m in met if m[0] >= least), key=lambda m: (-m[0], m[1][3] is None, -(m[1][3] or 0), m[1][0] or "", m[1][1], m[1][2] or ""))
            assert [(o, c, n) for _, o, c, n in sorted(got.get(q, []), key=lambda r: r[0])] == [(o, s[0], s[1]) for o, s in best[:limit]], q


def test_lines_of_a_block_are_made_once(spark):
    rows = [(q, p, f"line {q} {p}") for q in range(3) for p in range(2, 4 + q)]
    frames = [spark.range(1).crossJoin(spark.createDataFrame(rows[n:], "query_id long, position long, line string")).drop("id") for n in range(3)]
    out = prefetch.blocks(*frames)
    heads = ["## Identity", "## Model", "## Memories"]
    want = [(q, n, p, line) for n in range(3) for q, p, line in rows[n:]]
    want += [(q, n, 0, heads[n]) for n in range(3) for q in {r[0] for r in rows[n:]}]
    assert sorted(map(tuple, out.select("query_id", "block", "position", "line").collect())) == sorted(want)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 3


def test_memories_are_recalled_once(spark):
    """What reads the recalled rows reads them as written, and doesn't recall them."""
    from memlake.plans import prefetch as plans

    if not Path(SF_DIR).is_dir():
        pytest.skip("the test tables are not here")
    assert "MapInArrow" not in plans.prefetch_blocks(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
