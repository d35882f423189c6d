"""Personal data by patterns and a linear-chain conditional random field.

The patterns give exact base spans.  The field labels the tokens of a line by
their word shapes and neighbours and adds what the patterns miss (other ways to
write a number or an address).  It is trained on the small labelled table below
and decoded by Viterbi, many lines at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Tried only where a run of digits begins, as a later start in it fails alike: a long run costs its length.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: Tokens: runs of letters, runs of digits, other characters but spaces one by one.
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
#: What a span that the field calls an email must have: name, at, host and a dot, the signs perhaps written out.
_ADDRESS = re.compile(r"\w\s*(@|[\[(]\s*at\s*[\])])\s*[\w-]+\s*(\.|[\[(]\s*dot\s*[\])])\s*\w", re.IGNORECASE)
_HINT = re.compile(r"[0-9@]|[\[(]\s*[aA][tT]\s*[\])]")
#: Characters of lines that are decoded at once; a longer line is decoded alone.
DECODED_CHARACTERS = 400_000

#: Tag (the label), then text, alternating: a small labelled table.  O is no personal data.
LABELLED = (
    (("O", "please call me at"), ("phone", "555-123-4567"), ("O", "after lunch")),
    (("O", "phone :"), ("phone", "( 212 ) 555-0199"), ("O", ".")),
    (("O", "tel"), ("phone", "+49 30 901820"), ("O", "or fax")),
    (("O", "my number is"), ("phone", "020 7946 0018"), ("O", "thanks")),
    (("O", "mobile"), ("phone", "+1 (415) 555-2671"), ("O", ", evenings")),
    (("O", "call"), ("phone", "0049-170-5551234"), ("O", "now")),
    (("O", "reach us by phone on"), ("phone", "800.555.0123"), ("O", "today")),
    (("O", "write to"), ("email", "jane.doe@example.com"), ("O", "for details")),
    (("O", "mail"), ("email", "bob@mail.example.org"), ("O", ".")),
    (("O", "contact :"), ("email", "sales-team@example.net"), ("O", "or visit")),
    (("O", "email"), ("email", "info [at] example [dot] com"), ("O", "for help")),
    (("O", "e-mail :"), ("email", "john (at) example.org"), ("O", ",")),
    (("O", "send it to"), ("email", "x_y99@example.co.uk"), ("O", "soon")),
    (("O", "the server at"), ("ip", "192.168.0.1"), ("O", "is down")),
    (("O", "ip address"), ("ip", "10.20.30.40"), ("O", ".")),
    (("O", "ping"), ("ip", "8.8.4.4"), ("O", "from here")),
    (("O", "host"), ("ip", "172.16.254.3"), ("O", "answered")),
    (("O", "card number"), ("card", "4111 1111 1111 1111"), ("O", "expires")),
    (("O", "visa"), ("card", "4012-8888-8888-1881"), ("O", ".")),
    (("O", "pay with card"), ("card", "5555555555554444"), ("O", "please")),
    (("O", "credit card :"), ("card", "3782 822463 10005"), ("O", "amex")),
    (("O", "in 1999 there were 25 of them and 300 more"),),
    (("O", "version 2.0 of the license , january 2004"),),
    (("O", "on 12 may 2021 we sold 1,200 units for 35.50 each"),),
    (("O", "chapter 3 , page 118 , line 7"),),
    (("O", "the score was 3-2 at 15:30 on 2020-11-05"),),
    (("O", "order 12345 has 10 items"),),
    (("O", "see section 4.2.1 and table 10"),),
    (("O", "between 100 and 200 people @ the gate"),),
    (("O", "section 2 of 10 , 45 % of 1000"),),
    (("O", "token = 3f9a2b7c8d1e and id 998877"),),
    (("O", "a hash like 9b74c9897bac770ffc029102a200c5de is no number"),),
    (("O", "none of this is personal at all ."),),
    (("O", "call it a day ; phone home ; write a letter ; the card is red"),),
)
_CONTEXT = {w: i for i, w in enumerate(("call", "phone", "tel", "fax", "mobile", "number", "mail", "email", "contact", "ip", "host", "server", "address", "ping", "card", "visa", "credit", "pay", "at", "dot"), 1)}


class Field(NamedTuple):
    """Weights of (feature, label), of label pairs and of first labels; labels are O and KINDS."""

    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray


def _shape(token: str) -> int:
    """A small number for a token's shape: digits by count, letters by case and count, single signs each their own."""
    c = token[0]
    if c.isdigit():
        return 1 + min(len(token), 20)
    if c.isalpha():
        kind = 0 if token.islower() else 1 if token[0].isupper() and token[1:].islower() else 2
        return 30 + kind * 4 + min(len(token), 4) - 1
    return 50 + ("@.-+()/:,_[]#%=;".find(c) if c in "@.-+()/:,_[]#%=;" else 20)


_SHAPES, _NEIGHBOURS, _SPAN = 80, (-3, -2, -1, 0, 1, 2, 3), 25
_FEATURES = len(_NEIGHBOURS) * _SHAPES + 2 * _SPAN + 4


def _features(shapes: np.ndarray, context: np.ndarray, glued: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Feature numbers of every token: shapes of its neighbours, context words near it, and whether it touches the one before."""
    n = len(shapes)
    columns = []
    for k, d in enumerate(_NEIGHBOURS):
        at = np.arange(n) + d
        ok = (at >= 0) & (at < n)
        at = np.clip(at, 0, max(0, n - 1))
        ok &= line[at] == line
        columns.append(k * _SHAPES + np.where(ok, shapes[at], 0))
    base = len(_NEIGHBOURS) * _SHAPES
    for k, ways in enumerate(((1, 2, 3), (4, 5, 6))):
        word = np.zeros(n, np.int64)
        for d in ways:
            at = np.arange(n) - d
            ok = at >= 0
            at = np.clip(at, 0, max(0, n - 1))
            ok &= line[at] == line
            word = np.where((word == 0) & ok, context[at], word)
        columns.append(base + k * _SPAN + word)
    columns.append(base + 2 * _SPAN + glued.astype(np.int64))
    after = np.r_[glued[1:], False]
    columns.append(base + 2 * _SPAN + 2 + after.astype(np.int64))
    return np.stack(columns, axis=1)


def _tokens(text: str) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    spans, shapes, context, glued, end = [], [], [], [], -1
    for m in _TOKEN.finditer(text):
        t = m.group()
        spans.append(m.span())
        shapes.append(_shape(t))
        context.append(_CONTEXT.get(t.lower(), 0))
        glued.append(m.start() == end)
        end = m.end()
    return spans, np.array(shapes, np.int64), np.array(context, np.int64), np.array(glued, bool)


def _table() -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of each line of the labelled table."""
    out = []
    for row in LABELLED:
        text, marks = "", []
        for tag, part in row:
            text += " " * bool(text)
            marks.append((len(text), len(text) + len(part), 0 if tag == "O" else 1 + KINDS.index(tag)))
            text += part
        spans, shapes, context, glued = _tokens(text)
        labels = np.array([next(k for lo, hi, k in marks if lo <= s < hi) for s, _ in spans])
        out.append((_features(shapes, context, glued, np.zeros(len(shapes), np.int64)), labels))
    return out


def train(steps: int = 300, rate: float = 0.1, ridge: float = 2e-3) -> Field:
    """The field that maximises the penalised likelihood of the labelled table (Adam; forward and backward sums)."""
    data, k = _table(), 1 + len(KINDS)
    shapes = [(_FEATURES, k), (k, k), (k,)]
    w = [np.zeros(s) for s in shapes]
    m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for step in range(1, steps + 1):
        g = [-ridge * x for x in w]
        for feats, labels in data:
            e = w[0][feats].sum(axis=1)
            n = len(e)
            a, b = np.zeros((n, k)), np.zeros((n, k))
            a[0] = w[2] + e[0]
            for i in range(1, n):
                a[i] = e[i] + np.logaddexp.reduce(a[i - 1][:, None] + w[1], axis=0)
            for i in range(n - 2, -1, -1):
                b[i] = np.logaddexp.reduce(w[1] + (e[i + 1] + b[i + 1])[None, :], axis=1)
            z = np.logaddexp.reduce(a[-1])
            p = np.exp(a + b - z)
            d = -p
            d[np.arange(n), labels] += 1
            np.add.at(g[0], feats.ravel(), np.repeat(d, feats.shape[1], axis=0) / len(data))
            g[2] += d[0] / len(data)
            for i in range(1, n):
                g[1] -= np.exp(a[i - 1][:, None] + w[1] + (e[i] + b[i])[None, :] - z) / len(data)
                g[1][labels[i - 1], labels[i]] += 1 / len(data)
        for j in range(3):
            m[j], v[j] = 0.9 * m[j] + 0.1 * g[j], 0.999 * v[j] + 0.001 * g[j] ** 2
            w[j] = w[j] + rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return Field(*w)


def viterbi(field: Field, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of many lines at once; ``emissions`` has the tokens of all lines in order."""
    labels = np.zeros(len(emissions), np.int64)
    if not len(lengths):
        return labels
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    # Lines by falling length: at each place the lines that reach it are a head of the list.
    alive = [int(np.searchsorted(-lengths, -t, "left")) for t in range(int(lengths[0]))]
    score = field.start + emissions[first]
    back = []
    final = np.zeros(len(lengths), np.int64)
    done = len(lengths)
    for t in range(1, int(lengths[0])):
        n = alive[t]
        final[n:done] = score[n:done].argmax(axis=1)
        done = n
        ways = score[:n, :, None] + field.step
        back.append(ways.argmax(axis=1).astype(np.int8))
        score = ways.max(axis=1) + emissions[first[:n] + t]
    final[:done] = score[:done].argmax(axis=1)
    current = final.copy()
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = alive[t]
        labels[first[:n] + t] = current[:n]
        if t:
            current[:n] = back[t - 1][np.arange(n), current[:n]]
    return labels


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's matches; it is tried only from the run of characters before each at sign, where alone it can begin."""
    end = 0
    at = text.find("@")
    while at >= 0:
        head = at
        while head > end and text[head - 1] in _LOCAL:
            head -= 1
        m = _EMAIL.match(text, head) if head < at else None
        if m:
            yield m.span()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans by kind, then start; leftmost, not overlapping within a kind, failing ones dropped."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if not _HINT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 3 or (len(p) == 3 and p <= "255") for part in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def _lines(text: str) -> Iterator[tuple[int, int]]:
    """The lines that have a digit or an at sign, written out or not; all tokens of the others are O."""
    at = 0
    while m := _HINT.search(text, at):
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        yield text.rfind("\n", 0, m.start()) + 1, end
        at = end


def _batches(pieces: Iterator[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    batch, size = [], 0
    for piece in pieces:
        if batch and size + piece[2] - piece[1] > DECODED_CHARACTERS:
            yield batch
            batch, size = [], 0
        batch.append(piece)
        size += piece[2] - piece[1]
    if batch:
        yield batch


def _detect(field: Field):
    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [base_spans(t) if t else [] for t in texts]
            more: dict[int, list[tuple[str, int, int]]] = {}
            for pieces in _batches((i, lo, hi) for i, t in enumerate(texts) if t for lo, hi in _lines(t)):
                own: dict[int, np.ndarray] = {}
                for i, name, lo, hi in _decoded(field, texts, pieces):
                    if i not in own:
                        own[i] = np.array(sorted((s, e) for _, s, e in found[i]), np.int64).reshape(-1, 2)
                    # Spans of different kinds may overlap, so the farthest end up to each start counts.
                    before = np.searchsorted(own[i][:, 0], hi)
                    if not before or own[i][:before, 1].max() <= lo:
                        more.setdefault(i, []).append((name, lo, hi))
            rows = []
            for i, base in enumerate(found):
                spans = [(KINDS.index(n), s, e, True) for n, s, e in base] + [(KINDS.index(n), s, e, False) for n, s, e in more.get(i, [])]
                rows.append([{"kind": KINDS[n], "start": s, "end": e, "base": b} for n, s, e, b in sorted(spans)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], [*batch.schema.names[:-1], "spans"])

    return detect


def _decoded(field: Field, texts: list[str], pieces: list[tuple[int, int, int]]) -> Iterator[tuple[int, str, int, int]]:
    """Spans that the field finds in lines of texts and that can be one: digits enough, or an address."""
    parts = [_tokens(texts[i][lo:hi]) for i, lo, hi in pieces]
    lengths = np.array([len(p[0]) for p in parts], np.int64)
    line = np.repeat(np.arange(len(parts)), lengths)
    if not len(line):
        return
    feats = _features(np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]), line)
    labels = viterbi(field, sum(field.emit[feats[:, k]] for k in range(feats.shape[1])), lengths[lengths > 0])
    first = np.cumsum(lengths) - lengths
    edges = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (line[1:] != line[:-1])])
    for lo, hi in zip(edges, np.r_[edges[1:], len(labels)], strict=True):
        if labels[lo] == 0:
            continue
        piece = line[lo]
        i, base, _ = pieces[piece]
        spans = parts[piece][0]
        start, end = base + spans[lo - first[piece]][0], base + spans[hi - 1 - first[piece]][1]
        name, text = KINDS[labels[lo] - 1], texts[i][start:end]
        digits = len(_NOT_DIGIT.sub("", text))
        if (name == "email" and _ADDRESS.search(text)) or (name == "phone" and 7 <= digits <= 15) or (name == "card" and 13 <= digits <= 19) or (name == "ip" and digits >= 4 and text.count(".") == 3):
            yield i, name, start, end


def find_pii(documents: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for each row; spans ``(kind, start, end, base)`` in code points by kind as listed, then start.

    ``base`` tells a pattern's span from one that the field adds; the field decodes
    whole lines, and its spans that overlap a base span are left out.  Of paths of
    equal weight Viterbi takes the label that comes first (none, then the kinds as
    listed).  Null texts count as empty and have none.  Texts and lines of any length
    are read whole.  Repeated rows have the same spans each.  Other columns are
    ignored.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_detect(field or train()), "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def _redact(field: Field):
    detect = _detect(field)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in detect(iter([batch])):
                texts = batch.column(batch.num_columns - 1).to_pylist()
                out = []
                for t, spans in zip(texts, found.column(found.num_columns - 1).to_pylist(), strict=True):
                    end, parts = 0, []
                    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= end:
                            parts += [t[end : s["start"]], f"[{s['kind'].upper()}]"]
                        end = max(end, s["end"])
                    out.append("".join([*parts, t[end:]]) if parts else t)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], batch.schema.names)

    return redact


def redact_pii(documents: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one.  Null texts stay null."""
    names = documents.columns
    moved = documents.select(*[c for c in names if c != text_col], F.col(text_col).cast("string").alias(text_col))
    return moved.mapInArrow(_redact(field or train()), moved.schema).select(*names)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
