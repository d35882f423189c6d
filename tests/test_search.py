"""Batched recall by bounds against plain scoring, and how many rows the bounds leave."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import rerank, search, store


def plain(texts, queries, k):
    """Every text scored for every query."""
    split = {i: t.split() for i, t in texts}
    n, avgdl = len(split), sum(map(len, split.values())) / len(split)
    df = {}
    for ws in split.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, terms in queries:
        scores = []
        for i, ws in split.items():
            s, hit = 0.0, False
            for t in set(terms):
                tf = ws.count(t)
                if tf:
                    hit = True
                    s += max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avgdl))
            if hit:
                scores.append((-round(s, 6), i))
        out[q] = sorted(scores)[:k]
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Texts of rare, middling and common words; one word is in all of them."""
    rng = random.Random(11)
    rare = [f"rare{k}" for k in range(300)]
    mid = [f"mid{k}" for k in range(30)]
    rows = []
    for i in range(3000):
        words = ["all"] * rng.randrange(1, 3) + [rng.choice(mid) for _ in range(rng.randrange(1, 12))] + [rng.choice(rare) for _ in range(rng.randrange(0, 4))]
        rng.shuffle(words)
        rows.append((i * 7 if i % 3 else i * 7 - 5, " ".join(words)))
    rows.append((999_999, "all"))
    frame = spark.createDataFrame(rows, "id long, content string")
    return rows, search.build_index(frame, str(tmp_path_factory.mktemp("index")))


def test_top_k_is_exact(spark, corpus):
    rows, index = corpus
    rng = random.Random(12)
    vocabulary = ["all", "nowhere"] + [f"mid{k}" for k in range(30)] + [f"rare{k}" for k in range(300)]
    queries = [(q, [rng.choice(vocabulary) for _ in range(rng.randrange(1, 6))] + ["all"] * (q % 2)) for q in range(60)] + [(100, ["all"]), (101, ["nowhere"]), (102, [])]
    asked = spark.createDataFrame(queries, "query_id long, terms array<string>")
    for k in (1, 5, 80):
        got = {}
        for r in search.recall_batch(index, asked, k).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
        for q, want in plain(rows, queries, k).items():
            mine = [got.get(q, {})[n + 1] for n in range(len(got.get(q, {})))]
            assert [i for i, _ in mine] == [i for _, i in want], (q, k)
            assert [s for _, s in mine] == pytest.approx([-s for s, _ in want], abs=2e-6)


def test_a_common_term_brings_no_rows_of_its_own(spark, corpus):
    """200 queries that all have the word of all texts and a rare one: candidates are those of the rare words."""
    rows, index = corpus
    queries = [(q, ["all", f"rare{q}"]) for q in range(200)]
    asked = spark.createDataFrame(queries, "query_id long, terms array<string>")
    steps = search.bounded(index, asked, 5)
    assert steps.wanted.where("term = 'all' and essential").count() == 0
    having = sum(1 for _, t in rows for w in set(t.split()) if w.startswith("rare") and int(w[4:]) < 200)
    assert steps.partial.count() <= having < 200 * len(rows) / 50


def test_index_parts(spark, corpus):
    rows, index = corpus
    assert index.corpus.first().n == len(rows)
    assert {r.term: r.df for r in index.terms.where("term in ('all', 'mid3', 'rare5')").collect()} == {w: sum(w in t.split() for _, t in rows) for w in ("all", "mid3", "rare5")}
    assert index.blocks.where("term = 'all'").count() > 100 and index.bounds.agg(F.max("n")).first()[0] <= search.BLOCK_IDS
    assert index.postings.where("term = 'all'").count() == len(rows)


def test_postings_are_made_in_runs(spark, tmp_path, monkeypatch):
    """Runs that end with a block, within one, or in none: the same texts of each term, rows of one id and length as one."""
    texts = {0: "a b a", 1: "b", 2: "", 3: None, 4: "a " * 9, 200: "b a", 300: "c", 301: "a c b a"}
    frame = spark.createDataFrame([*texts.items(), (301, "b a c a")], "id long, content string")
    got = {}
    for run in (1, 4, 1_000_000):
        monkeypatch.setattr(search, "RUN_TOKENS", run)
        rows = pa.Table.from_pylist([{"id": i, "block": i // 128, "t": (t or "").split()} for i, t in [*sorted(texts.items()), (301, "b a c a")]], pa.schema([("id", pa.int64()), ("block", pa.int64()), ("t", pa.list_(pa.string()))]))
        found = [r for b in search._posted(iter(rows.to_batches(3))) for r in b.to_pylist()]
        got[run] = sorted((r["term"] or "", i, dl, tf) for r in found for i, dl, tf in zip(r["ids"], r["dls"], r["tfs"]))
        assert all(r["n"] == len(r["ids"]) and sum(r["tfs"]) == len(r["positions"]) for r in found)
    assert got[1] == got[4] == got[1_000_000]
    assert ("a", 301, 4, 4) in got[1] and ("a", 4, 9, 9) in got[1] and sum(r[0] == "" for r in got[1]) == len(texts)
    index = search.build_index(frame, str(tmp_path / "index"))
    assert {(r.id, tuple(r.positions)) for r in index.placed.where("term = 'b'").collect()} == {(0, (2,)), (1, (1,)), (200, (1,)), (301, (1, 3))}


def test_all_terms_start_from_the_rarest(spark, corpus):
    rows, index = corpus
    facts = spark.createDataFrame([(i, i % 3, float(i % 5)) for i, _ in rows], "id long, importance int, created_at double")
    queries = [(1, ["all", "mid3", "rare5"]), (2, ["all", "nowhere"]), (3, ["all"]), (4, ["mid3", "all", "mid3"]), (5, ["nowhere"])]
    got = search.recall_all(index, spark.createDataFrame(queries, "query_id long, terms array<string>"), facts, 7).collect()
    for q, terms in queries:
        have = {i for i, t in rows if set(terms) <= set(t.split())}
        mine = [r for r in got if r.query_id == q]
        assert len(mine) == min(7, len(have)) and {r.id for r in mine} <= have
        assert sorted(mine, key=lambda r: (-r.score, -r.importance, -r.created_at, r.id)) == sorted(mine, key=lambda r: r["rank"])


@pytest.mark.parametrize("query", ["cafe", "CAFÉ", "café", "Cáfé"])
def test_accents_fold_alike(spark, query):
    """One or several code points, Vietnamese, Greek, Hungarian; letters without a decomposition stay."""
    texts = ["Café", "café", "CAFE", "caf", "Việt Nam", "ἄλφα άλφα ΆΛΦΑ", "ő Ű łódź øre", "Ångstrom Ångstrom"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string")
    folded = {r.id: r.t for r in frame.select("id", T.tokens("content").alias("t")).collect()}
    assert folded[0] == folded[1] == folded[2] == ["cafe"] and folded[4] == ["viet", "nam"]
    assert len(set(folded[5])) == 1 and folded[6] == ["o", "u", "łodz", "øre"] and folded[7] == ["angstrom", "angstrom"]
    assert search.phrases(query) == [["cafe"]]
    own = duckdb.sql("SELECT regexp_extract_all(strip_accents(lower(t)), '[\\p{L}\\p{N}]+') FROM (SELECT unnest(?) AS t)", params=[texts]).fetchall()
    assert [r[0] for r in own] == [folded[i] for i in range(len(texts))]


def test_neighbours_of_many_vectors(spark, monkeypatch):
    """Blocks of queries and slices of vectors against one product of all; odd vectors have no score."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 8)).round(3)
    vectors[7] = vectors[9] = vectors[20] * 2
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, [0.0] * 8), (901, None), (902, [1.0, 2.0]), (903, [None] * 8), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = frame.where("vec_id % 4 = 0 or vec_id > 800").withColumnRenamed("vec_id", "query_id")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 5)
    monkeypatch.setattr(rerank, "QUERY_BLOCK", 16)
    monkeypatch.setattr(rerank, "PRODUCTS", 500)
    found = rerank.vector_topk_batch(frame.repartition(3), asked, 5)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {*range(0, 300, 4), 902}
    assert got[902] == {1: (902, 1.0)}
    for q in range(0, 300, 4):
        order = sorted(range(300), key=lambda i: (-scores[q, i], i))[:5]
        assert [got[q][k + 1][0] for k in range(5)] == order
        assert [got[q][k + 1][1] for k in range(5)] == pytest.approx([scores[q, i] for i in order])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
    assert rerank.vector_topk_batch(frame, asked.limit(0)).count() == 0


def test_recall_records_what_it_returns(spark, tmp_path):
    rows = [(i, f"red word{i % 3} common", "n", i % 4, float(i)) for i in range(30)]
    memories = spark.createDataFrame(rows, "id long, content string, namespace string, importance int, created_at double").withColumns({"access_count": F.lit(0), "last_accessed": F.lit(None).cast("double")})
    index = search.build_index(memories, str(tmp_path / "index"))
    log = str(tmp_path / "log")
    seen = {}
    for at, query in enumerate(("word1", "red word2", "nothing here", "common word1"), 1):
        for r in search.recall_recorded(memories, index, query, at, log, 5).collect():
            seen.setdefault(r.id, []).append(float(at))
    with pytest.raises(ValueError):
        search.recall_recorded(memories, index, "  ", 9, log)
    counted = store.apply_accesses(memories, store.fold_accesses(spark.read.parquet(log))).collect()
    assert {r.id: (r.access_count, r.last_accessed) for r in counted if r.access_count} == {i: (len(v), max(v)) for i, v in seen.items()} and len(seen) >= 10


def test_hits_go_to_their_texts(spark, corpus, tmp_path):
    """A few hits are sent to the texts: of these nothing is shuffled, sorted or tokenised."""
    rows, index = corpus
    path = str(tmp_path / "texts")
    spark.createDataFrame(rows, "id long, content string").write.parquet(path)
    asked = spark.createDataFrame([(1, ["mid3", "rare5"]), (2, ["nowhere"])], "query_id long, terms array<string>")
    out = search.with_texts(search.recall_batch(index, asked, 4), asked, spark.read.parquet(path))
    own = dict(rows)
    got = out.collect()
    assert len(got) == 4 and all(r.content == own[r.id] for r in got)
    joined = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Join Inner" in line and "broadcast" in line for line in joined[:3])


def test_the_products_of_a_block_of_queries_stay_small():
    """A thousand queries against a batch of vectors, with ties: equal to sorting all products, in a fraction of their memory."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    vectors = rng.integers(-1, 2, (6000, 8)).astype(float)
    queries = rerank._unit(rng.normal(size=(1024, 8)))
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * 6000 + 1, 8, dtype=np.int32)), pa.array(vectors.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(6000)), flat], ["vec_id", "embedding"])
    tracemalloc.start()
    out = list(rerank._best(SimpleNamespace(value=(np.arange(1024) * 20, queries)), 10, 5)([batch.slice(0, 5), batch.slice(5)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    scores = np.round(queries @ rerank._unit(vectors).T, 5)
    scores = np.where(np.isnan(scores), -2, scores)
    order = np.lexsort((np.broadcast_to(np.arange(6000), scores.shape), -scores), axis=1)[:, :10]
    got = pa.Table.from_batches(out).to_pydict()
    assert got["query_id"] == np.repeat(np.arange(1024) * 20, 10).tolist() and got["vec_id"] == order.ravel().tolist()
    assert peak < 60_000_000


def test_a_query_without_phrases_reads_no_positions(spark, corpus):
    rows, index = corpus
    found = search.score(index, "all mid3 mid3")
    assert "positions" not in found._jdf.queryExecution().executedPlan().toString()
    assert "positions" in search.score(index, "all-mid3")._jdf.queryExecution().executedPlan().toString()
    split = {i: t.split() for i, t in rows}
    want = {i: sum(w for q in ("all", "mid3", "mid3") for w in [weight(split, i, q)]) for i, ws in split.items() if {"all", "mid3"} <= set(ws)}
    got = {r.id: r.score for r in found.collect()}
    assert got.keys() == want.keys() and [got[i] for i in want] == pytest.approx(list(want.values()))
    assert search.score(index, "all nowhere").count() == 0


def weight(split, i, term):
    n, avgdl, df, tf = len(split), sum(map(len, split.values())) / len(split), sum(term in ws for ws in split.values()), split[i].count(term)
    return max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(split[i]) / avgdl))


def test_recall_deals_postings_once(spark, corpus):
    """Queries are sent to the blocks: the postings of their words move once, and then each task's best of every query."""
    rows, index = corpus
    asked = spark.createDataFrame([(q, ["all", f"mid{q % 30}", f"rare{q}"]) for q in range(40)], "query_id long, terms array<string>")
    out = search.recall_batch(index, asked, 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert search._scored_by_block(index, search._asked(asked), 5).count() <= 40 * 5 * parts
    want = plain(rows, [(q, ["all", f"mid{q % 30}", f"rare{q}"]) for q in range(40)], 5)
    assert {(r.query_id, r["rank"], r.id) for r in out.collect()} == {(q, n, i) for q, best in want.items() for n, (_, i) in enumerate(best, 1)}


@pytest.mark.parametrize("products", [1, 4_000_000])
def test_blocks_and_joins_answer_alike(spark, tmp_path, monkeypatch, products):
    """Equal texts in many blocks, ids with two texts, words of no text, null words, queries that come twice; a few products at a time."""
    rng = random.Random(3)
    rows = [(i, "copy of a text") for i in range(-300, 900)] + [(i, " ".join(rng.choices("copy of a text and one more word".split(), k=rng.randrange(0, 9)))) for i in range(850, 1400)] + [(5000, None)]
    index = search.build_index(spark.createDataFrame(rows, "id int, content string"), str(tmp_path / "index"))
    queries = [("q", ["copy", "text", None]), ("q", ["copy"]), ("r", ["word", "one", "nowhere"]), ("s", ["nowhere"]), ("t", []), ("u", None), ("v", ["more", "and", "a"])]
    asked = spark.createDataFrame(queries, "query_id string, terms array<string>")
    once = spark.createDataFrame([("q", ["copy", "text"]), *queries[2:]], "query_id string, terms array<string>")
    monkeypatch.setattr(search, "PRODUCTS", products)
    found = search.recall_batch(index, asked, 7)
    assert found.schema["id"].dataType.simpleString() == "int" and found.schema["rank"].dataType.simpleString() == "bigint"
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in found.collect())
    assert {g[0] for g in got} == {"q", "r", "v"} and len(got) == 21
    assert search.recall_batch(index, asked.where("query_id = 's'"), 7).count() == 0
    monkeypatch.setattr(search, "BROADCAST_WORDS", 2)
    joined = sorted((r.query_id, r["rank"], r.id, r.score) for r in search.recall_batch(index, once, 7).collect())
    assert [g[:3] for g in got] == [j[:3] for j in joined] and [g[3] for g in got] == pytest.approx([j[3] for j in joined], abs=2e-6)
