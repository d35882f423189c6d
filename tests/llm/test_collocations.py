import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from memlake.llm import collocations as module
from memlake.llm.collocations import collocations

SCHEMA = "text string, lang string, phrase string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most_words=4, first=2000, covered=80):
    counts, total = defaultdict(Counter), Counter()
    for text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, most_words + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def rows(seed=1, n=200):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "sat", "on", "é", "É", "mat", "a", "b", "c", "\U0001f600", "x-y", "(q)"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(words[: 4 + i % 11]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?"]) for _ in range(rng.randrange(60)))
        out.append((text + "new york city hall " * (i % 3), rng.choice(["en", "de", None, "und", "fr"]), "clash"))
    return out + [(None, "en", None), ("", "de", None), (" \t.\n", "xx", None), ("one", "yy", None)] + out[:5]


def test_matches_plain_python(spark, monkeypatch):
    data = rows()
    frame = spark.createDataFrame(data, SCHEMA).withColumn("hash", F.lit("clash")).withColumn("n", F.lit(1))
    got = lambda **k: sorted(tuple(r) for r in collocations(frame.repartition(3), **k).collect())
    assert got() == brute(data, 30)
    assert got(least=5, first=7) == brute(data, 5, first=7)
    # Small blocks, a filter that lets nearly all through, no broadcast.
    monkeypatch.setattr(module, "BLOCK_BYTES", 40)
    monkeypatch.setattr(module, "FILTER_BITS", 16)
    monkeypatch.setattr(module, "BROADCAST_PHRASES", 0)
    assert got(least=4, most_words=5, covered=60) == brute(data, 4, 5, covered=60)


def test_long_text_and_empty_tables(spark):
    text = ("alpha beta gamma; " * 40_000 + "tail " * 3) * 2
    data = [(text, "en", None), ("word " * 1000, "en", None)]
    assert sorted(tuple(r) for r in collocations(spark.createDataFrame(data, SCHEMA)).collect()) == brute(data, 30)
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([("a b", "en", None)], SCHEMA)).count() == 0


def test_cuts_keep_every_piece(monkeypatch):
    monkeypatch.setattr(module, "BLOCK_BYTES", 16)
    raw = np.frombuffer(b"a b. c d e f g h i j k l m n o p q r. s t; u" * 3, np.uint8)
    parts = list(module._cut(module.Chunk(0, raw, np.array([0, len(raw)]))))
    assert b"".join(p.bytes.tobytes() for p in parts) == raw.tobytes() and len(parts) > 3
    assert all(p.bytes[-1] in b".;" for p in parts[:-1])
