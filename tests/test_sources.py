"""Files and stores: checks before reading and writing, round trips, retention."""

import pytest
from pyspark.sql import functions as F

from memlake.operators import consolidate, memory, plugins, rerank, search
from memlake.sources import files, strict
from memlake.streaming import capture


def test_paths():
    assert strict.resolve(None, None, "/data/store/") == "/data/store"
    assert strict.resolve("s3a://bucket/x", "/other", "/d") == "s3a://bucket/x"
    for bad in (":memory:", "", "ftp://x/y"):
        with pytest.raises(ValueError):
            strict.resolve(bad or " ", None, "/d")


def test_layouts_and_migrations(spark):
    assert files.classify(spark.createDataFrame([], files.MEMORY_SCHEMA)) == "ours"
    assert files.classify(spark.range(1)) == "refuse"
    old = spark.createDataFrame([("a", "text", "ns", 1.0)], "id string, content string, namespace string, created_at double")
    assert strict.migrate(old, 0).first().importance == 5
    assert [f.name for f in strict.migrate(old, 0).schema] == [f.name for f in files.MEMORY_SCHEMA]
    with pytest.raises(ValueError):
        strict.migrate(old, 4)
    with pytest.raises(ValueError):
        strict.migrate(old.drop("content"), 0)


def test_remember_checks_and_repeats(spark):
    rows = spark.createDataFrame([("text", "ns", None, 1.0)], "content string, namespace string, importance int, created_at double")
    one, two = files.remember(rows).first(), files.remember(rows).first()
    assert one.id == two.id and one.importance == 5 and len(one.id) == 16
    for bad in ((" ", "ns", 5, 1.0), ("x" * 100_001, "ns", 5, 1.0), ("text", "ns", 11, 1.0), (None, "ns", 5, 1.0)):
        with pytest.raises(Exception, match="content must be"):
            files.remember(spark.createDataFrame([bad], rows.schema)).collect()


def test_ledgers_and_exports(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.mkdir()
    bad.mkdir()
    (good / "a.json").write_text('{"event": "review", "n": 1}\n{"event": "outcome", "n": 2}\n')
    (bad / "a.json").write_text('{"event": "review", "n": 1}\n{"event": \n')
    schema = "event string, n int"
    assert files.read_ledger(spark, str(good), schema).count() == 2
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        files.read_ledger(spark, str(bad), schema).collect()
    rows = spark.range(5).withColumn("t", F.lit("é"))
    files.export_json(rows, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in spark.read.json(str(tmp_path / "out")).select("id", "t").collect()) == [(i, "é") for i in range(5)]
    with pytest.raises(Exception, match="exists"):
        files.export_json(rows, str(tmp_path / "out"))


def test_strict_documents(spark, tmp_path):
    for name, text in (("a", '{"k": 1}'), ("b", '{"k": 1, "k": 2}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "d.json").write_text(text)
    assert strict.read_documents(spark, str(tmp_path / "a"), "k int").first().k == 1
    with pytest.raises(Exception, match="double key"):
        strict.read_documents(spark, str(tmp_path / "b"), "k int").collect()
    with pytest.raises(ValueError):
        strict.write_markdown(spark.range(1), "/x/store.db")


def test_recall_and_counts(spark, tmp_path):
    rows = [(1, "red fox and blue fox", "a", 5, 1.0), (2, "a red fox", "a", 9, 2.0), (3, "nothing", "b", 5, 3.0), (4, "snake_case +++", "b", 5, 4.0), (5, "", "a", 5, 5.0)]
    memories = spark.createDataFrame(rows, "id long, content string, namespace string, importance int, created_at double")
    index = search.build_index(memories, str(tmp_path / "index"))
    assert [r.id for r in search.recall(memories, index, "red fox", 5).collect()] in ([1, 2], [2, 1])
    assert [r.id for r in search.recall(memories, index, "blue-fox").collect()] == [1]
    assert [r.id for r in search.recall(memories, index, "fox", namespace="a", min_importance=6).collect()] == [2]
    assert [r.id for r in search.recall(memories, index, "+++").collect()] == [4]
    assert [r.id for r in search.recall(memories, index, "red ***", namespace="").collect()]
    assert search.count_matching(memories, index, "fox").first().n == 2
    assert search.count_matching(memories, index, "+++").first().n == 1
    assert index.corpus.first().n == 5


def test_small_operators(spark):
    changes = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, id string")
    accepted, known = capture.push(changes, spark.createDataFrame([("b",)], "id string"))
    assert [r.id for r in accepted.collect()] == ["a"] and [r.id for r in known.collect()] == ["b"]
    assert consolidate.demote(spark.createDataFrame([(0.9,), (0.1,)], "importance double")).agg(F.max("importance")).first()[0] == 0.25
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in rerank.vector_topk(vectors, [1.0, 0.1], 2).collect()] == [1, 2]
    plugins.register("embed", lambda texts: texts.map(lambda t: [float(len(t))]))
    assert spark.createDataFrame([("abc",)], "t string").select(plugins.apply("embed", "t").alias("e")).first().e == [3.0]
    with pytest.raises(ValueError):
        plugins.register("nothing", lambda t: t)
    backups = spark.createDataFrame([(f"b{i}", i) for i in range(6)], "path string, made_at long")
    assert {r.path for r in files.expired_backups(backups, 4).collect()} == {"b0", "b1"}
    gone = memory.mirror(spark.createDataFrame([], "target string, native_id long, content string"), spark.createDataFrame([("t", 1, "d")], "target string, native_id long, digest string"))
    assert gone[0].count() == 0 and gone[1].count() == 1


def test_snapshots_are_what_was_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 0.5), (2, "b", 0.5)], "id long, text string, x double")
    root = str(tmp_path)
    files.write_snapshot(rows, root, 1)
    files.write_snapshot(rows.where("id = 1"), root, 2)
    assert files.read_snapshot(spark, root).count() == 1 and files.read_snapshot(spark, root, 1).count() == 3
    with pytest.raises(ValueError, match="no such"):
        files.read_snapshot(spark, root, 7)
    # Rows that are gone, doubled or changed are noticed.
    for k, other in enumerate((rows.where("id = 2"), rows.union(rows.where("id = 2")), rows.withColumn("x", F.lit(0.5)))):
        other.write.mode("overwrite").parquet(f"{root}/v=1")
        with pytest.raises(ValueError, match="isn't what was written"):
            files.read_snapshot(spark, root, 1)
        assert files.read_snapshot(spark, root, 1, check=False).count() == (2, 5, 3)[k]


def test_exports_come_back(spark, tmp_path):
    made = files.remember(spark.createDataFrame([("one", "n", 5, 1.0), ("two", "n", None, 2.0)], "content string, namespace string, importance int, created_at double"))
    files.export_json(made, f"{tmp_path}/out")
    changed = made.withColumn("importance", F.lit(9)).limit(1)
    plain = files.import_json(spark, f"{tmp_path}/out", changed)
    assert plain.count() == 2 and plain.where("importance = 9").count() == 1
    assert files.import_json(spark, f"{tmp_path}/out", changed, force=True).where("importance = 9").count() == 0
