"""Secret scans behind a trigram inverted index.

From each rule's regex comes a Boolean trigram query: alternatives, each a set of
trigrams that any match of that alternative contains.  Documents are posted under
those trigrams of the rules that their text has; the postings of an alternative
are intersected by counting, and only the candidates are verified by the regex.
A rule without mandatory trigrams scans all texts.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from re import _constants as _op
from re import _parser as _regex
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.session import checkpointed


class Rule(NamedTuple):
    """``regex`` is read alike by Java and Python; a match counts if ``group`` has at least ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Runs are maximal, so the length may stand in the regex: shorter ones are no matches to drop.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE_RULES = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 0, 24),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    # Only where a run of its characters begins, so that a long run is read once.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: Alternatives that a query may have before its rule counts as one without mandatory trigrams.
MOST_ALTERNATIVES = 64
#: Most candidate keys that are broadcast (some 100 MB with their rules); beyond, a shuffle joins them.
BROADCAST_KEYS = 500_000


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Alternatives of mandatory trigrams, in lower case; empty if some match may have none."""

    def runs(nodes, heads: list[list[str]]) -> list[list[str]]:
        # A head is a list of literal runs; the last run is still open.
        for kind, what in nodes:
            broken = [[*h, ""] for h in heads]
            if kind is _op.LITERAL:
                heads = [[*h[:-1], h[-1] + chr(what).lower()] for h in heads]
            elif kind is _op.SUBPATTERN:
                heads = runs(what[-1], heads)
            elif kind is _op.BRANCH:
                heads = [h for branch in what[1] for h in runs(branch, heads)]
            elif kind is _op.IN and len(what) <= 8 and all(k is _op.LITERAL and chr(c).isalnum() for k, c in what):
                heads = [[*h[:-1], h[-1] + chr(c).lower()] for h in heads for _, c in what]
            elif kind is _op.MAX_REPEAT and what[0] == 0 and what[1] == 1 and all(k is _op.LITERAL for k, _ in what[2]):
                heads = [[*h] for h in heads] + runs(what[2], heads)
            elif kind is _op.MAX_REPEAT and what[0] > 0:
                heads = [[*h, ""] for h in runs(what[2], heads)]
            else:
                heads = broken
            heads = [list(h) for h in dict.fromkeys(map(tuple, heads))]
            if len(heads) > MOST_ALTERNATIVES:
                heads = broken
        return heads

    found = [frozenset(r[i : i + 3] for r in head for i in range(len(r) - 2)) for head in runs(_regex.parse(regex), [[""]])]
    if not all(found):
        return []
    return [q for q in dict.fromkeys(found) if not any(other < q for other in found)]


def _running(lengths: Column) -> Column:
    """``array<struct<start, end, good>>`` of ``array<struct<before, own, good>>``: lengths laid end to end.

    A fold that appends copies its array each time, so the matches are folded in
    blocks of about the root of their number, then the blocks' sums.
    """
    def blocks(whole: Column) -> Column:
        n = F.size(whole)
        step = F.ceil(F.sqrt(n)).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.ceil(n / step).cast("int") - 1), lambda k: F.slice(whole, k * step + 1, step)))

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + part["before"]
        hit = F.struct(start.alias("start"), (start + part["own"]).alias("end"), part["good"].alias("good"))
        return F.struct((start + part["own"]).alias("at"), F.array_append(state["out"], hit).alias("out"))

    def pile(state: Column, block: Column) -> Column:
        return F.struct((state["at"] + block["at"]).alias("at"), F.array_append(state["out"], state["at"]).alias("out"))

    none = F.expr("cast(array() as array<struct<start:int,end:int,good:boolean>>)")

    def placed(folded: Column) -> Column:
        begins = F.aggregate(folded, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")), pile)["out"]
        return F.zip_with(folded, begins, lambda block, at: F.transform(block["out"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["good"].alias("good"))))

    folded = _once(lengths, lambda whole: F.transform(blocks(whole), lambda block: F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("out")), add)))
    return F.coalesce(F.flatten(_once(folded, placed)), none)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: as an argument, not as an expression that each step repeats."""
    return F.transform(F.array(value), use)[0]


def match_spans(text: Column, rule: Rule) -> Column:
    """The rule's matches as ``array<struct<start, end, kind>>``, in code points, failing ones dropped.

    Starts come from the lengths of what ``split`` leaves between the matches.
    """
    java = rule.regex
    found, between = F.regexp_extract_all(text, F.lit(java), F.lit(0)), F.split(text, java, -1)
    checked = F.regexp_extract_all(text, F.lit(java), F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("m"), checked.alias("g"))
    lengths = F.transform(parts, lambda p: F.struct(F.length(p["b"]).alias("before"), F.length(p["m"]).alias("own"), (F.length(p["g"]) >= rule.least).alias("good")))
    kept = F.transform(F.filter(_running(lengths), lambda s: s["good"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))
    return F.when(F.regexp_like(text, F.lit(java)), kept).otherwise(_no_spans())


def _no_spans() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,kind:string>>)")


def scan_secrets(documents: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for each row; ``spans`` is an array of ``(start, end, kind)`` by start, then order of rules.

    A rule's matches are the leftmost ones that don't overlap; those that fail its
    length check are dropped and not retried.  Spans of different rules that start
    alike come in the order of the rules.  Null texts count as empty and have no
    spans.  Texts of any length and any number of matches are scanned whole.
    Repeated rows have the same spans each.  An empty table gives an empty one.
    Other columns are ignored.
    """
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    full = [r for r in rules if not queries[r.kind]]
    indexed = [r for r in rules if queries[r.kind]]
    grams = sorted(set(itertools.chain.from_iterable(q for r in indexed for q in queries[r.kind])))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Rows with equal keys are equal: a document that comes twice has one entry in the index.
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams])) if grams else F.expr("cast(array() as array<string>)")
    scanned = F.concat(*[match_spans(F.col("text"), r) for r in full]) if full else _no_spans()
    base = docs.withColumn("low", low).select("doc_id", "key", has.alias("grams"), scanned.alias("spans"))
    base = checkpointed(base)

    clauses = [(r.kind, i, g, len(q)) for r in indexed for i, q in enumerate(queries[r.kind]) for g in sorted(q)]
    clause_table = documents.sparkSession.createDataFrame(clauses, "rule string, alternative int, gram string, needed int")
    postings = base.where(F.size("grams") > 0).select("key", F.explode("grams").alias("gram"))
    # The clauses are the rules' own: as many as their alternatives have trigrams.
    met = postings.join(F.broadcast(clause_table), "gram").groupBy("key", "rule", "alternative").agg(F.size(F.collect_set("gram")).alias("found"), F.max("needed").alias("needed"))
    candidates = checkpointed(met.where("found = needed").groupBy("key").agg(F.collect_set("rule").alias("rules")))
    few = candidates.count() <= BROADCAST_KEYS
    named = docs.join(F.broadcast(candidates) if few else candidates, "key")
    verified = F.concat(*[F.when(F.array_contains("rules", r.kind), match_spans(F.col("text"), r)).otherwise(_no_spans()) for r in indexed]) if indexed else _no_spans()
    verified = named.select("key", verified.alias("more")).where(F.size("more") > 0).dropDuplicates(["key"])

    rank = lambda s: F.array_position(F.array(*[F.lit(r.kind) for r in rules]), s["kind"])
    ranked = F.array_sort(F.transform(F.concat("spans", F.coalesce("more", _no_spans())), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = base.join(verified, "key", "left").select("doc_id", ranked.alias("spans"))
    return out.select("doc_id", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
