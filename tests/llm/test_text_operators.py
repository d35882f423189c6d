"""Decontamination and personal data against brute force; the pipeline on a small corpus."""

import random
import time
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from memlake.llm import decontaminate, pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long, item_id string, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in rows], DOCS)


def words_of(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def best_score(item, text):
    """Smith-Waterman, one cell at a time."""
    best, before = 0, [0] * (len(text) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(text):
            row.append(max(0, before[j] + (2 if a == b else -1), before[j + 1] - 1, row[j] - 1))
        best, before = max(best, *row), row
    return best


def test_alignment_matches_cell_by_cell():
    rng = np.random.default_rng(3)
    items, texts = rng.integers(10, 16, (40, 12)), rng.integers(10, 16, (40, 25))
    m, w = rng.integers(1, 13, 40), rng.integers(1, 26, 40)
    for k in range(40):
        items[k, m[k] :], texts[k, w[k] :] = 0, 1
    score, start, end = decontaminate.align(items, m, texts, w)
    for k in range(40):
        item, text = items[k, : m[k]].tolist(), texts[k, : w[k]].tolist()
        assert score[k] == best_score(item, text)
        if score[k]:
            assert best_score(item, text[start[k] : end[k]]) == score[k]


def test_leaks_match_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12, 40)))) for k in range(12)]
    rows = []
    for i in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 200))]
        if i % 2:
            copy = items[rng.randrange(12)][1].split()
            for _ in range(i % 5):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = ["edited"] * rng.randrange(2)
            at = rng.randrange(len(body) + 1)
            body[at:at] = copy
        rows.append((i, (", " if i % 3 else "\n").join(body).title()))
    bench = spark.createDataFrame([(k, t, "other") for k, t in items], "item_id long, text string, score string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated_spans(frame(spark, rows), bench).collect()}
    texts, seeds = dict(rows), {k: {tuple(words_of(t)[i : i + 4]) for i in range(len(words_of(t)) - 3)} for k, t in items}
    want = {}
    for i, t in rows:
        ws = words_of(t)
        grams = {tuple(ws[j : j + 4]) for j in range(len(ws) - 3)}
        for k, item in items:
            score = best_score(words_of(item), ws) / (2 * len(words_of(item)))
            if score >= 0.5 and grams & seeds[k]:
                want[i, k] = score
    assert set(got) == set(want) and len(want) > 20
    for key, r in got.items():
        assert abs(r.score - want[key]) < 1e-9
        part = words_of(texts[key[0]])[r.first_word : r.end_word]
        item = words_of(dict(items)[key[1]])
        assert abs(best_score(item, part) / (2 * len(item)) - r.score) < 1e-9
    left = decontaminate.drop_contaminated(frame(spark, rows), bench)
    assert left.columns == frame(spark, rows).columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_an_edited_copy_in_many_documents_is_found_next_to_an_exact_one(spark):
    item = [f"item{k}" for k in range(40)]
    edited = [f"other{k}" if k % 5 == 4 else w for k, w in enumerate(item)]
    # 101 also has words of the item far from the copy, 102 has too few of them.
    rows = [(i, f"before {i} " + " ".join(edited) + " after") for i in range(100)] + [(100, " ".join(item)), (101, " ".join([*item[:4], *["filler"] * 300, *edited])), (102, " ".join([*item[:4], "filler", *item[20:24]]))]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: round(r.score, 9) for r in decontaminate.contaminated_spans(frame(spark, rows), bench).collect()}
    assert got == {**dict.fromkeys(range(100), 0.7125), 100: 1.0, 101: 0.7125}


def share_of_best(item, text):
    """Best local alignment by what the whole item would have, cell by cell."""
    row, best = [0] * (len(text) + 1), 0
    for a in item:
        diagonal, row[0] = row[0], 0
        for j, b in enumerate(text, 1):
            value = max(0, diagonal + (2 if a == b else -1), row[j] - 1, row[j - 1] - 1)
            diagonal, row[j] = row[j], value
            best = max(best, value)
    return best / (2 * len(item))


def test_a_split_copy_has_one_score_wherever_it_stands(spark):
    """Two halves of an item with other words between them, at seven places and with two distances."""
    item = [f"i{k}" for k in range(40)]
    rows, want = [], {}
    for half, apart in ((19, 33), (20, 36)):
        for before in (0, 5, 10, 15, 20, 30, 40):
            text = [f"x{k}" for k in range(before)] + item[:half] + [f"y{k}" for k in range(apart)] + item[40 - half :] + ["end"] * before
            want[len(rows)] = share_of_best(item, text)
            rows.append((len(rows), " ".join(text)))
    got = {r.doc_id: r.score for r in decontaminate.contaminated_spans(frame(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == want and set(want.values()) == {0.5375, 0.55}


def test_recall_on_edited_copies(spark):
    """Copies with words replaced, put in, left out, moved and split: nine of ten that plain alignment finds, no others, equal scores."""
    rng = random.Random(21)
    vocabulary = [f"v{k}" for k in range(60)]
    items = {k: [rng.choice(vocabulary) + rng.choice(["", "", str(k)]) for _ in range(rng.randrange(12, 60))] for k in range(40)}
    rows = []
    for n in range(240):
        copy = list(items[n % 40])
        for _ in range(rng.randrange(1 + len(copy) // 4)):
            at, kind = rng.randrange(len(copy)), rng.randrange(4)
            if kind == 0:
                copy[at] = "new" + str(rng.randrange(999))
            elif kind == 1:
                copy.insert(at, rng.choice(vocabulary))
            elif kind == 2 and len(copy) > 4:
                del copy[at]
            else:
                copy[at:] = [rng.choice(vocabulary) for _ in range(rng.randrange(6))] + copy[at:]
        pad = lambda: [rng.choice(vocabulary) for _ in range(rng.randrange(70))]
        rows.append((n, " ".join(pad() + copy + pad())))
    want = {(n, k): score for n, t in rows for k, item in items.items() if (score := share_of_best(item, t.split())) >= 0.5}
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    for pairs in (1000, 0):
        decontaminate.RARE_PAIRS, before = pairs, decontaminate.RARE_PAIRS
        try:
            got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated_spans(frame(spark, rows), bench).collect()}
        finally:
            decontaminate.RARE_PAIRS = before
        assert set(got) <= set(want) and len(got) >= 0.9 * len(want) > 150
        assert all(got[k] == want[k] for k in got)


def test_a_seed_that_all_items_and_texts_share(spark):
    """Four words that 1,000 items and 6,000 texts have make no result, and one real copy is found."""
    rng = random.Random(3)
    phrase = ["on", "the", "other", "hand"]
    word = lambda: f"w{rng.randrange(30_000)}"
    items = [(k, " ".join([word() for _ in range(20)] + phrase + [word() for _ in range(20)])) for k in range(1000)]
    rows = [(k, " ".join([word() for _ in range(30)] + phrase + [word() for _ in range(30)])) for k in range(6000)] + [(9999, items[7][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    began = time.monotonic()
    got = decontaminate.contaminated_spans(frame(spark, rows), bench).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in got] == [(9999, 7, 1.0)]
    assert time.monotonic() - began < 60


def test_leak_edge_cases(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "too short here"), (None, item)], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "filler " * 50_000 + item), (4, item), (4, item), (None, item), (5, "one two three four"), (6, "too short here")]
    got = sorted((r.doc_id, r.item_id, r.score, r.first_word) for r in decontaminate.contaminated_spans(frame(spark, rows), bench).collect())
    assert got == [(3, 1, 1.0, 50_000), (4, 1, 1.0, 0)]
    assert sorted(str(r.doc_id) for r in decontaminate.drop_contaminated(frame(spark, rows), bench).collect()) == ["1", "2", "5", "6"]
    assert decontaminate.contaminated_spans(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated_spans(frame(spark, rows), bench.limit(0)).count() == 0


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


PII = [
    "", "a@b.c", "x@y", "mail bob.smith+tag@mail.example.co.uk, now", "a@b@c.d e@f.g", "@a.b %@a.b..c", "é@a.b \U0001f600 q@w.e", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 999.1.2.3.4", "10.0.0.1.", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "5555555555554444 5555555555554444", "+1 (415) 555-2671", "+49 30 901820", "+123", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1 415 555 2671\n+44 20 7946 0018", "١٢٣.1.2.3", "a" * 3000 + "@" + "b." * 500 + "c", "1" * 5000,
]


def test_base_spans_match_the_patterns():
    rng = random.Random(9)
    texts = PII + ["".join(rng.choice("ab1234567890@@..--++() ") for _ in range(120)) for _ in range(400)]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_viterbi_matches_every_path():
    rng = np.random.default_rng(5)
    field = pii.Field(np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    lengths = np.array([4, 1, 5, 2])
    emissions = rng.normal(size=(12, 3))
    labels = pii.viterbi(field, emissions, lengths)
    at = 0
    for n in lengths:
        paths = np.array(np.meshgrid(*[range(3)] * n, indexing="ij")).reshape(n, -1).T
        score = [field.start[p[0]] + sum(emissions[at + i, p[i]] for i in range(n)) + sum(field.step[p[i], p[i + 1]] for i in range(n - 1)) for p in paths]
        assert labels[at : at + n].tolist() == paths[int(np.argmax(score))].tolist()
        at += n


def test_field_adds_what_patterns_miss(spark):
    rows = [(1, "please call me at 555-321-7654 after noon"), (2, "write to anna [at] example [dot] org please"), (3, "in 2019 there were 12 of them and 30 more on page 7"), (4, "my number is 020 7946 1234 thanks"), (5, None), (6, ""), (8, "(see section at) the [at] gate"), (7, "word " * 40_000 + "q@w.example")]
    got = {r.doc_id: r.spans for r in pii.find_pii(frame(spark, rows + [(7, rows[-1][1])])).collect()}
    texts = dict(rows)
    found = {i: [(s.kind, texts[i][s.start : s.end], s.base) for s in spans] for i, spans in got.items()}
    assert ("phone", "555-321-7654", False) in found[1]
    assert any(k == "email" and t.startswith("anna [at]") for k, t, _ in found[2])
    assert found[3] == found[8] == [] and found[5] == [] and found[6] == []
    assert any(k == "phone" for k, _, _ in found[4])
    assert found[7] == [("email", "q@w.example", True)]
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_whole_lines_are_decoded(spark):
    line = "at 5 pm or mail info [at] example [dot] com now"
    found = {r.doc_id: r.spans for r in pii.find_pii(frame(spark, [(1, line), (2, line + "\nnext line of plain words")])).collect()}
    for spans in found.values():
        assert any(s.kind == "email" and line[s.start : s.end].startswith("info [at] example [dot] com") for s in spans)
    rng = random.Random(4)
    parts = ["word", "a", "7", "x@y", "[at]", "12 3", "call me", "phone 555 123 4567", "bob (at) example [dot] org", "card 3782 822463 10005", "+49 30 901820", "é", "a.b@c.example", "10.0.0.1"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice([" ", " ", " ", " ", "\n"]) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    field = pii.train()
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if not s.base] for r in pii.find_pii(frame(spark, rows), field).collect()}
    assert sum(map(len, got.values())) > 20
    for i, text in rows:
        assert got[i] == plain_field_spans(field, text), text


def plain_field_spans(field, text):
    """Every line by itself, its labels from the best of all paths, cell by cell."""
    base, out, first = plain_spans(text), [], 0
    for line in text.split("\n"):
        spans, shapes, context, glued = pii._tokens(line)
        if spans:
            emit = field.emit[pii._features(shapes, context, glued, np.zeros(len(spans), np.int64))].sum(axis=1)
            score, back = [field.start + emit[0]], []
            for t in range(1, len(spans)):
                ways = score[-1][:, None] + field.step
                back.append(ways.argmax(axis=0))
                score.append(ways.max(axis=0) + emit[t])
            labels = [int(score[-1].argmax())]
            for row in reversed(back):
                labels.insert(0, int(row[labels[0]]))
            lo = 0
            while lo < len(spans):
                hi = lo + 1
                while hi < len(spans) and labels[hi] == labels[lo]:
                    hi += 1
                start, end = spans[lo][0], spans[hi - 1][1]
                name, digits = pii.KINDS[labels[lo] - 1] if labels[lo] else "", sum(c in "0123456789" for c in line[start:end])
                fits = {"email": bool(pii._ADDRESS.search(line[start:end])), "phone": 7 <= digits <= 15, "card": 13 <= digits <= 19, "ip": digits >= 4 and line[start:end].count(".") == 3}
                if fits.get(name) and not any(first + start < e and s < first + end for _, s, e in base):
                    out.append((pii.KINDS.index(name), first + start, first + end))
                lo = hi
        first += len(line) + 1
    return [(pii.KINDS[k], s, e) for k, s, e in sorted(out)]


def test_long_runs_take_time_in_proportion():
    for text in ("1" * 400_000, "1." * 200_000, "9" * 3000 + ".1.1.1", "9" * 5000 + ".1.1.1" + "a" * 2000, "00000000001.2.3.4", "a" * 300_000 + "@" + "b" * 1000, "+" * 200_000, "1 " * 200_000):
        assert pii.base_spans(text) == plain_spans(text) if len(text) < 6000 else pii.base_spans(text) is not None


def test_redaction_takes_every_span_and_keeps_the_columns(spark):
    rows = [(1, "mail a@b.example or 10.0.0.1 now"), (2, None), (3, "nothing here")]
    docs = frame(spark, rows)
    out = pii.redact_pii(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "mail [EMAIL] or [IP] now", 2: None, 3: "nothing here"}


def test_pipeline_takes_effect_and_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(11)
    plain = [f"{a}{b}" for a in ("ba", "ke", "mo", "ri", "tu", "zo") for b in ("lan", "ser", "vin", "dor", "mek", "pol", "gat")]
    body = lambda n=60: " ".join(rng.choice(plain) for _ in range(n)).capitalize() + "."
    item = " ".join(f"item{k}" for k in range(40))
    rows = [(i, body(), "ab"[i % 2]) for i in range(300)]
    toxic = [(i, f"{body()} You grumblefluff {rng.choice(plain)}!", "a") for i in range(300, 380)]
    copies = [(400 + k, rows[5][1] if k else rows[5][1].upper(), "a") for k in range(5)]
    leaks = [(500 + k, f"{body(20)} {item} {body(20)}", "b") for k in range(3)]
    private = [(600, f"{body()} mail me at someone@mail.example today", "a")]
    odd = [(700, None, None), (701, "", None), (None, body(), "a")]
    everything = rows + toxic + copies + leaks + private + odd
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in everything], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(300 <= i < 360)) for i, _, _ in rows + toxic[:60]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, columns, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), None, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    everyone = {i for i, _, _ in everything}
    assert everyone - set(kept["toxicity"]) == {i for i, _, _ in toxic}
    assert set(kept["toxicity"]) - set(kept["near_duplicates"]) == {i for i, _, _ in copies}
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {i for i, _, _ in leaks}
    assert set(kept["pii"]) == set(kept["decontamination"])
    assert kept["pii"][600].text.endswith("mail me at [EMAIL] today") and kept["pii"][600].n_chars == len(kept["pii"][600].text)
    assert kept["pii"][3].text == rows[3][1]
    assert all(r.copies >= 1 for r in kept["mixing"].values())
    again = {(r.doc_id, r.text, r.copies) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {(r.doc_id, r.text, r.copies) for r in docs.collect()}


def test_pipeline_stages_take_odd_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(3)
    body = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) + str(rng.randrange(400)) for _ in range(40))
    item = " ".join(f"item{k}" for k in range(30))
    same = body()
    rows = [(i, body(), "a") for i in range(40)] + [(None, same, "a"), (None, same, "b"), (1, body(), "b"), (50, "", None), (51, None, "a"), (None, None, "a"), (None, f"{body()} {item}", "a"), (60, "word " * 30_000, "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(1))
    names = ("score", "sentences", "copies", "taken", "gone", "leaked", "scored", "row_key", "rows", "turn", "size", "id", "spans", "_gone")
    for name in names:
        frame = frame.withColumn(name, F.lit(name))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        sizes[name] = docs.count()
        if name != "mixing":
            assert all(r[n] == n for r in docs.collect() for n in names)
    # Of the two rows with one text and no id one goes, then the copy of the item.
    assert sizes["toxicity"] == len(rows) and sizes["near_duplicates"] == len(rows) - 1 and sizes["decontamination"] == sizes["pii"] == len(rows) - 2
    assert {r.doc_id for r in docs.where("doc_id is null or doc_id in (1, 50)").collect()} <= {None, 1, 50}
    total = sum(len((r.text or "").split()) * r.copies for r in docs.collect())
    assert total == sum(r.taken for r in docs.collect()) and docs.where("doc_id is null and text is not null").count() >= 1
