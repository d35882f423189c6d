"""Streams in several runs: late and repeated entries, timers, pushes applied once."""

import datetime
import hashlib


from memlake.streaming import capture, ledger, sync, working

ENTRIES = "attempt string, at timestamp, seq long, kind string, case_id string, passed boolean"
START = datetime.datetime(2024, 1, 1)


def entry(attempt, hour, seq, kind, case=None, passed=None):
    return (attempt, START + datetime.timedelta(hours=hour), seq, kind, case, passed)


FIRST = [
    entry("a", 0, 4, "after", "x", True),
    entry("a", 0, 1, "predict", "x"),
    entry("a", 0, 1, "predict", "x"),
    entry("a", 0, 2, "before", "x", False),
    entry("a", 0, 3, "before", "y", True),
    entry("a", 1, 5, "after", "y", False),
    entry("b", 1, 1, "predict", "x"),
    entry("b", 1, 2, "before", "x", True),
]
SECOND = [entry("a", 2, 6, "predict", "y"), entry("a", 2, 7, "validate"), entry("b", 2, 1, "predict", "x"), entry("c", 3, 1, "predict", "z"), entry("c", 3, 2, "before", "z", False)]
THIRD = [entry("a", 4, 8, "after", "x", False), entry("a", 4, 9, "validate"), entry("b", 4, 3, "after", "x", True), entry("b", 4, 4, "validate"), entry("d", 90, 1, "validate")]
FOURTH = [entry("e", 200, 1, "validate")]


def test_a_ledger_in_several_runs(spark, tmp_path):
    """State goes on between runs; repeats, entries after the validation and late predictions don't count; time gives up what stays open."""
    every = []
    for part in (FIRST, SECOND, THIRD, FOURTH):
        every += part
        spark.createDataFrame(part, ENTRIES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = capture.stream_parquet(spark, f"{tmp_path}/in", spark.createDataFrame(part, ENTRIES).schema)
        ledger.run_ledger(stream, f"{tmp_path}/out", f"{tmp_path}/state", hours=24)
    got = {r.attempt: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got)
    assert set(got) == {"a", "b", "c", "d", "e"}
    a = got["a"]
    assert (a.status, a.fixed, a.missed, a.already, a.collateral, a.too_late, a.passed, a.total) == ("validated", 1, 0, 0, 1, 1, 1, 2)
    b = got["b"]
    assert (b.status, b.fixed, b.missed, b.already, b.collateral, b.total) == ("validated", 0, 0, 1, 0, 1)
    assert (got["c"].status, got["c"].total) == ("expired", 0) and (got["d"].status, got["d"].total) == ("validated", 0)
    # Without the entries after a's validation the table's outcomes are the same.
    rows = spark.createDataFrame([e for e in every if not (e[0] == "a" and e[2] > 7)], ENTRIES)
    table = {r.attempt: r for r in ledger.outcomes_of(rows).collect()}
    assert set(table) == {"a", "b", "d", "e"} and all(table[k].asDict() == got[k].asDict() for k in table)


CHANGES = "seq long, id long, base_digest string, content string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pushes_are_judged_and_applied_once(spark, tmp_path):
    at = str(tmp_path / "sync")
    sync.open_store(spark.createDataFrame([(1, "one", 0), (2, "two", 0)], "id long, content string, seq long"), at)
    first = [(1, 1, sha("one"), "uno"), (2, 1, sha("one"), "eins"), (3, 1, sha("uno"), "un"), (4, 2, None, "two"), (5, 3, None, "three"), (5, 3, None, "three")]
    second = [(6, 1, sha("un"), "uno"), (7, 3, sha("other"), "drei"), (8, 2, sha("two"), None), (9, 4, sha("nothing"), "four"), (10, 3, None, "three")]
    for part in (first, second, None):
        if part:
            spark.createDataFrame(part, CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        sync.run_push(capture.stream_parquet(spark, f"{tmp_path}/in", spark.createDataFrame(first, CHANGES).schema), at)
    judged = spark.read.parquet(f"{at}/outcomes")
    want = {1: "accepted", 2: "conflict", 3: "accepted", 4: "duplicate", 5: "accepted", 6: "accepted", 7: "conflict", 8: "accepted", 9: "conflict", 10: "duplicate"}
    assert judged.count() == len(want) and {r.seq: r.outcome for r in judged.collect()} == want
    row = sync.counts(judged).first()
    assert (row.accepted, row.duplicate, row.conflict, row.cursor) == (5, 2, 3, 10)
    store = sync.store_at(spark, at, 2)
    assert {(r.id, r.content, r.seq) for r in store.collect()} == {(1, "uno", 6), (2, "", 8), (3, "three", 5)}
    assert [r.id for r in sync.page(store, 5).collect()] == [1, 2] and [r.id for r in sync.page(store, 0, 1).collect()] == [3]
    # A batch that is judged again against the same version of the store gives the same.
    again = sync.judge(spark.createDataFrame(second, CHANGES), sync.store_at(spark, at, 1))
    assert {(r.seq, r.outcome) for r in again.collect()} == {(s, o) for s, o in want.items() if s > 5}
    assert sync.judge(spark.createDataFrame([], CHANGES), store).count() == 0


def test_memories_expire_by_the_streams_time(spark, tmp_path):
    """A touch puts the end off, time moves with any memory's touches, and what comes back is a new memory."""
    at = lambda h: START + datetime.timedelta(hours=h)
    schema = "id string, at timestamp"
    want = []
    for part, gone in (
        ([("a", at(0)), ("b", at(1)), ("a", at(2))], []),
        ([("a", at(20)), ("c", at(27))], [("b", at(1), 1)]),
        ([("c", at(50)), ("b", at(50))], [("a", at(20), 3)]),
        ([("d", at(80))], [("b", at(50), 1), ("c", at(50), 2)]),
    ):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = capture.stream_parquet(spark, f"{tmp_path}/in", spark.createDataFrame(part, schema).schema)
        working.run_expirations(stream, f"{tmp_path}/out", f"{tmp_path}/state", hours=24)
        want += gone
        assert sorted(tuple(r) for r in spark.read.schema("id string, touched timestamp, touches long").parquet(f"{tmp_path}/out").collect()) == sorted(want)


def test_state_is_written_once_for_each_entry():
    """A batch's new entries are written at once, repeats never; an attempt that is validated in the batch writes no entry."""

    class Held(list):
        writes = 0

        def appendList(self, rows):
            self.writes += 1
            self.extend(rows)

        def get(self):
            return iter(list(self))

    class Handle:
        def listTimers(self):
            return []

        def registerTimer(self, at):
            pass

    class Value:
        at = None

        def exists(self):
            return self.at is not None

        def update(self, value):
            self.at = value

    def entry(seq, kind, passed=None):
        return {"milliseconds": 5, "seq": seq, "kind": kind, "case_id": "c", "passed": passed}

    attempts = ledger._Attempts(1)
    attempts.handle, attempts.entries, attempts.closed = Handle(), Held(), Value()
    assert not list(attempts.handleInputRows(("a",), iter([entry(1, "predict"), entry(2, "before", False)] * 2), None))
    assert not list(attempts.handleInputRows(("a",), iter([entry(2, "before", False)]), None))
    assert attempts.entries.writes == 1 and len(attempts.entries) == 2
    (row,) = attempts.handleInputRows(("a",), iter([entry(3, "after", True), entry(3, "after", True), entry(4, "validate")]), None)
    assert row["fixed"] == 1 and row["total"] == 1 and attempts.entries.writes == 1 and not attempts.entries and attempts.closed.exists()
