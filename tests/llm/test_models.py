"""Toxicity, language identification, language-model scoring: held-out accuracy, exact counts, edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from memlake.llm import language_id, lm_score, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, sentences string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "clash", "clash") for i, t, lang in rows], DOCS)


def sentence(rng, words, n=7):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


PLAIN = [f"{a}{b}" for a in ("ba", "ke", "mo", "ri", "tu") for b in ("lan", "ser", "vin", "dor", "mek", "pol")]
RUDE = ["grumblefluff", "snarkwort", "blisterox"]


def toxic_corpus(rng, n):
    """Documents of plain sentences; a toxic one has a single sentence with a rude word in it."""
    rows, toxic = [], []
    for i in range(n):
        parts = [sentence(rng, PLAIN) for _ in range(rng.randrange(2, 9))]
        bad = i % 4 == 0
        if bad:
            parts[rng.randrange(len(parts))] = sentence(rng, PLAIN, 4)[:-1] + f" {rng.choice(RUDE)} {rng.choice(PLAIN)}!"
        rows.append((i, " ".join(parts), "en"))
        toxic.append((i, int(bad)))
    return rows, toxic


def test_toxicity_learns_from_document_labels_and_finds_the_sentence(spark):
    rows, toxic = toxic_corpus(random.Random(1), 600)
    docs, labels = frame(spark, rows), spark.createDataFrame(toxic, "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(labels["doc_id"])))
    out = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    kept_back = {r.doc_id for r in docs.where(toxicity.held_out(docs["doc_id"])).collect()}
    assert 150 < len(kept_back) < 250
    right = [(out[i].score >= 0.7) == bool(t) for i, t in toxic if i in kept_back]
    assert sum(right) / len(right) > 0.97
    texts = {i: t for i, t, _ in rows}
    for i, t in toxic:
        found = [texts[i][s.start : s.end] for s in out[i].sentences]
        if t and out[i].score >= 0.7:
            assert any(w in f.lower() for f in found for w in RUDE)


def test_noisy_or_of_sentences(spark):
    rows, toxic = toxic_corpus(random.Random(2), 200)
    model = toxicity.train(frame(spark, rows), spark.createDataFrame(toxic, "doc_id long, toxic int"))
    one, two = f"Balan {RUDE[0]} keser.", f"Movin {RUDE[1]} ridor."
    scored = {r.doc_id: r.score for r in toxicity.score_documents(frame(spark, [(1, one, None), (2, two, None), (3, f"{one} {two}", None)]), model).collect()}
    assert math.isclose(1 - scored[3], (1 - scored[1]) * (1 - scored[2]), rel_tol=1e-6)


def test_toxicity_edge_cases(spark):
    rows, toxic = toxic_corpus(random.Random(3), 200)
    docs, labels = frame(spark, rows), spark.createDataFrame([*toxic, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs.union(frame(spark, [(None, "x", None), (9999, None, None)])), labels)
    odd = [(1, None, None), (2, "", None), (3, " \n12 ?!", None), (4, "é" * 5 + f". {RUDE[0]} tumek!", None), (None, "Balan.", None), (6, "Balan " * 60_000, None), (6, "Balan " * 60_000, None)]
    got = toxicity.score_documents(frame(spark, odd), model).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score == by[3].score == 0
    assert [(s.start, s.end) for s in by[4].sentences] == [(7, 7 + len(RUDE[0]) + 6)]
    assert len({r.score for r in got if r.doc_id == 6}) == 1
    assert all(0 <= r.score <= 1 for r in got)
    empty = frame(spark, [])
    none = toxicity.train(empty, labels.limit(0))
    assert toxicity.score_documents(empty, model).count() == 0
    assert {r.score for r in toxicity.score_documents(docs, none).collect()} == {0.0}
    one_sided = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score_documents(docs, one_sided).selectExpr("int(score >= 0.7) AS predicted").collect()} == {0}


def test_fit_raises_the_likelihood():
    labels, counts = np.array([1, 0] * 30), np.full(60, 3)
    word, sentence_no = np.repeat(labels, 3).clip(0, 1), np.arange(180)
    weights, bias = toxicity.fit_weights(labels, counts, sentence_no, word, 2)
    assert weights[1] + bias > 0 > weights[0] + bias


LANGUAGES = {
    "aa": "the quick brown fox jumps over lazy dogs while winter evenings grow longer than expected".split(),
    "bb": "der schnelle braune fuchs springt über faule hunde während winterabende länger werden als erwartet".split(),
    "cc": "быстрая лиса прыгает через ленивых собак пока зимние вечера становятся длиннее обычного".split(),
}


def language_corpus(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(list(LANGUAGES))
        rows.append((i, " ".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randrange(4, 60))), lang))
    return rows


def test_languages_held_out(spark):
    rows = language_corpus(random.Random(4), 400)
    docs = frame(spark, rows)
    prototypes = language_id.train(docs.where(~language_id.held_out(docs["doc_id"])))
    assert prototypes.languages == sorted(LANGUAGES)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, prototypes).collect()}
    kept_back = [r.doc_id for r in docs.where(language_id.held_out(docs["doc_id"])).collect()]
    truth = {i: lang for i, _, lang in rows}
    assert len(kept_back) > 60
    assert sum(got[i] == truth[i] for i in kept_back) / len(kept_back) > 0.97


def test_prototypes_match_brute_force_and_any_partitioning(spark):
    rows = language_corpus(random.Random(5), 30)
    docs = frame(spark, rows)
    a, b = (language_id.train(docs.repartition(k), dimensions=256) for k in (1, 7))
    assert a.languages == b.languages and np.array_equal(a.vectors, b.vectors)
    letters = np.array(sorted({ord(c) for _, t, _ in rows for c in t.lower()} | {0x20}), np.uint32)
    base = dict(zip(letters.tolist(), language_id.letter_vectors(letters, 256), strict=True))
    for k, lang in enumerate(a.languages):
        total = np.zeros(256)
        for _, t, own in rows:
            padded = f" {t.lower()} "
            for i in range(len(padded) - 2):
                if own == lang:
                    total += np.prod([np.roll(base[ord(c)], j) for j, c in enumerate(reversed(padded[i : i + 3]))], axis=0)
        cosine = total @ a.vectors[k] / np.linalg.norm(total)
        assert cosine > 0.999


def test_predictions_match_brute_force(spark, monkeypatch):
    """Every n-gram by itself; few n-grams are kept and blocks are small, as with large alphabets."""
    monkeypatch.setattr(language_id, "KEPT", 40)
    monkeypatch.setattr(language_id, "BLOCK", 16)
    rows = language_corpus(random.Random(8), 40)
    docs = frame(spark, rows)
    prototypes = language_id.train(docs, dimensions=128)
    texts = [(i, t) for i, t, _ in rows[:12]] + [(90, "".join(chr(0x4E00 + 7 * k) for k in range(300))), (91, "\U00030000\U00030001 \U00030000"), (92, "1 2 3")]
    # The batches are read here, so that the small limits hold.
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in texts], "text": [t for _, t in texts]})
    out = next(language_id._predict(prototypes, 3, 128)(iter([batch]))).to_pydict()
    own = prototypes.vectors - prototypes.mean
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    for (_, t), lang, score in zip(texts, out["lang_pred"], out["score"], strict=True):
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        if not words:
            assert (lang, score) == ("und", 0.0)
            continue
        padded, total = f" {' '.join(words)} ", np.zeros(128)
        for i in range(len(padded) - 2):
            total += np.prod([np.roll(language_id.letter_vectors(np.array([ord(c)], np.uint32), 128)[0], 2 - j) for j, c in enumerate(padded[i : i + 3])], axis=0)
        v = total / np.linalg.norm(total) - prototypes.mean
        cosine = own @ v / np.linalg.norm(v)
        assert lang == prototypes.languages[int(cosine.argmax())] and abs(score - (cosine.max() + 1) / 2) < 1e-4


def test_toxicity_scores_match_brute_force(spark):
    rng = random.Random(12)
    vocabulary = ["plain", "words", "grumblen", "grumbles", "grumblefluff", "über", "überall", "mild", "tea", "gru"]
    terms = ["grumblen", "tea", "grum", "grumb", "über", "überal"]
    weights = dict(zip(terms, (3.0, -1.0, 2.0, 1.5, 0.7, 2.5), strict=True))
    stems = {t: len(t) for t in terms if t in ("grum", "grumb", "überal")}
    hashed = {}
    for t in terms:
        raw = t.encode()
        chunk = toxicity.Chunk(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        h = toxicity.words(chunk, toxicity.LETTERS).hash[0]
        hashed[t] = h ^ np.uint64(stems[t]) if t in stems else h
    order = sorted(terms, key=lambda t: hashed[t])
    model = toxicity.Model(np.array([hashed[t] for t in order]), np.array([weights[t] for t in order]), -4.0)
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", ", ", ". ", "! ", "\n"]) for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    got = {r.doc_id: (r.score, r.sentences) for r in toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), model, threshold=0.3).collect()}
    for i, text in rows:
        clean, bad = 1.0, 0
        for sentence in re.split("[!.?\n]", text):
            words = set(re.findall(r"[^\W\d_]+", sentence))
            if words:
                found = {t for t in terms if t not in stems and t in words} | {t for t, k in stems.items() if any(w[:k] == t and len(w) > k for w in words)}
                p = 1 / (1 + math.exp(4 - sum(weights[t] for t in found)))
                clean *= 1 - p
                bad += p >= 0.3
        assert abs(got[i][0] - (1 - clean)) < 1e-9 and len(got[i][1]) == bad


def test_language_edge_cases(spark):
    docs = frame(spark, [*language_corpus(random.Random(6), 40), (100, None, "aa"), (101, "text without language", None)])
    prototypes = language_id.train(docs)
    odd = [(1, None, None), (2, "", None), (3, "12 345 !? \n", None), (None, "the quick fox", None), (5, "the lazy dogs " * 30_000, None), (6, "x", None), (6, "x", None), (7, "\U0001f600 漢字", None)]
    got = language_id.identify(frame(spark, odd), prototypes).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (1, 2, 3))
    assert by[5].lang_pred == by[None].lang_pred == "aa"
    assert by[6].lang_pred in LANGUAGES and by[7].lang_pred in LANGUAGES
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(docs.limit(0), prototypes).count() == 0
    none = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def brute_scores(rows, target, weight=0.6, prior=0.1):
    """Losses by exact counts; no two words or pairs of these share a bucket."""
    texts = {i: [w.lower() for w in (t or "").split()] for i, t, _ in rows}
    uni, pair = [Counter(), Counter()], [Counter(), Counter()]
    for i, ws in texts.items():
        for k in range(2):
            if k == 1 or i in target:
                uni[k].update(ws)
                pair[k].update(zip([None, *ws], ws, strict=False))
    mass, kinds = sum(uni[0].values()), len(uni[1])
    scale = [1.0, mass / sum(uni[1].values())]
    out = {}
    for i, ws in texts.items():
        loss = [0.0, 0.0]
        for j, w in enumerate(ws):
            before = ws[j - 1] if j else None
            for k in range(2):
                less = 1 if k == 1 or i in target else 0
                base = (max(0, uni[k][w] - less) * scale[k] + prior) / (mass + prior * kinds)
                own = max(0, uni[k][before] - less)
                chance = min(1, max(0, pair[k][before, w] - less) / max(own, 1))
                loss[k] -= math.log(base if before is None or own <= 0 else weight * chance + (1 - weight) * base)
        out[i] = (len(ws), loss[0] / max(1, len(ws)), loss[1] / max(1, len(ws)))
    return out


def test_losses_match_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(PLAIN if i % 3 else PLAIN[:8] + RUDE) for _ in range(rng.randrange(1, 40))), None) for i in range(80)] + [(80, "", None), (81, None, None)]
    target = {i for i in range(80) if i % 3 == 0 and i < 60}
    docs, ids = frame(spark, rows).repartition(5), spark.createDataFrame([(i,) for i in [*target, *target, None]], "doc_id long")
    got = lm_score.score_documents(docs, lm_score.train(docs, ids), ids).collect()
    want = brute_scores(rows, target)
    assert len(got) == len(rows)
    for r in got:
        n, a, b = want[r.doc_id]
        assert r.n_tokens == n
        assert abs(r.loss_target - a) < 1e-4 and abs(r.loss_background - b) < 1e-4 and abs(r.score - (a - b)) < 2e-4
    unseen = [r.score for r in got if 60 <= r.doc_id < 80 and r.doc_id % 3 == 0]
    others = [r.score for r in got if r.doc_id < 80 and r.doc_id % 3]
    assert sum(unseen) / len(unseen) < sum(others) / len(others)


def test_lm_counts_stay_exact_with_many_words(spark):
    """More different words and pairs than any fixed number of buckets of 2^18 and 2^20 keeps apart."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"x{rng.randrange(400_000)}" for _ in range(12_000)), None) for i in range(60)]
    target = set(range(0, 60, 3))
    docs, ids = frame(spark, rows).repartition(5), spark.createDataFrame([(i,) for i in target], "doc_id long")
    want = brute_scores(rows, target)
    both = [lm_score.score_documents(docs, lm_score.train(docs, ids), ids).collect(), lm_score.train_and_score(docs, ids).collect()]
    assert [len(rows) for rows in both] == [60, 60]
    for r in [r for rows in both for r in rows]:
        n, a, b = want[r.doc_id]
        assert r.n_tokens == n and abs(r.loss_target - a) < 1e-6 and abs(r.loss_background - b) < 1e-6


def test_lm_edge_cases(spark):
    docs = frame(spark, [(1, "a b c", None), (None, "a b", None), (2, "Zz! " * 50_000, None), (1, "a b c", None)])
    nobody = spark.createDataFrame([], "doc_id long")
    got = lm_score.score_documents(docs, lm_score.train(docs, nobody), nobody).collect()
    assert len(got) == 4 and {r.n_tokens for r in got} == {2, 3, 50_000}
    assert all(math.isfinite(r.loss_target) and math.isfinite(r.score) for r in got)
    empty = docs.limit(0)
    assert lm_score.score_documents(empty, lm_score.train(empty, nobody), nobody).count() == 0
