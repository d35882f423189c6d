import hashlib

from pyspark.sql import functions as F

from memlake.llm.fill_in_middle import Markers, draws, fill_in_middle, restore, unit_ends

SCHEMA = "doc_id long, text string, form string"


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    lo, hi = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    return (len(text), "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(text), "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


def test_matches_plain_python(spark):
    texts = ["a", "ab", "é\U0001f600\n\r x", "with <P> in it", "<S>", "x<M", "<P<S<M>", "line\n" * 300, "z<S" * 50, "long text \U0001f600" * 200_000]
    rows = [(i, texts[i % len(texts)], "clash") for i in range(200)] + [(None, "no id", None), (7, None, None), (8, "", None), (None, None, None), (3, texts[3], None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("made", F.lit(1)).withColumn("made_", F.lit(2)).withColumn("n", F.lit("clash"))
    got = fill_in_middle(frame.repartition(3)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *map(str, brute(i, t))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix), str(r.middle), r.output) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(restore(r.output, r.form).encode()).hexdigest()
        assert r.form == "plain" or restore(r.output, r.form) == r.prefix + r.middle + r.suffix
    assert fill_in_middle(frame.limit(0)).count() == 0


def test_other_units_and_markers(spark):
    assert list(unit_ends(r"\S+\s*")("one two  three")) == [4, 9, 14]
    assert list(unit_ends(r"(a|b)c?")("acbxbc")) == [2, 3, 6]
    assert list(unit_ends(r"(?s:.)")("x" * 1000)) == list(range(1, 1001))
    frame = spark.createDataFrame([(i, "some words to be moved around ", None) for i in range(60)], SCHEMA)
    marks = Markers("[p]", "[s]", "[m]")
    for r in fill_in_middle(frame, unit=r"\S+\s*", seed=9, plain=0, spm=50, markers=marks).collect():
        h1, h2, _, h4 = draws(r.doc_id, 9)
        assert r.n == 6 and r.form == ("spm" if h4 % 100 < 50 else "psm")
        assert len(r.prefix.split()) == min(h1 % 7, h2 % 7) and len(r.suffix.split()) == 6 - max(h1 % 7, h2 % 7)
        assert restore(r.output, r.form, marks) == "some words to be moved around "
