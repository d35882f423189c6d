"""Labels of memories as evidence: windows of a query that name them, abstention, expansion of misspelt queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import column, one_edit, one_edit_keys

MOST_INDEXED, LEAST_LETTERS, MOST_TOKENS = 2048, 4, 16


def label_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(column(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def names_label(query: Column, label: Column, fuzzy: bool = True) -> Column:
    """Whether a window of the query's tokens is the label's, or differs in one token by one edit."""
    width = F.size(label)

    def window(i: Column) -> Column:
        pairs = F.zip_with(F.slice(query, i, width), label, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        differ = F.filter(pairs, lambda p: p["a"] != p["b"])
        one = F.element_at(differ, F.lit(1))
        near = (F.size(differ) == 1) & one_edit(one["a"], one["b"]) if fuzzy else F.lit(False)
        return (F.size(differ) == 0) | near

    usable = width.between(1, MOST_TOKENS) & (width <= F.size(query))
    return usable & F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(query) - width + 1)), window)


def label_evidence(rows: DataFrame) -> DataFrame:
    """``rows(query_id, query, id, labels, ...)`` with ``kept``: where all of a query's rows have labels, those with one that the query names.

    If one of them has none, all stay; if no label is named, none does.
    """
    tokens = label_tokens("query")
    named = F.exists("labels", lambda label: names_label(tokens, label_tokens(label)))
    marked = rows.withColumn("named", named)
    everyone = F.bool_and(F.size("labels") > 0).over(Window.partitionBy("query_id"))
    return marked.withColumn("kept", ~everyone | F.col("named")).drop("named")


def label_index(labels: DataFrame, most: int = MOST_INDEXED) -> DataFrame:
    """``token, label, place`` of the first ``most`` labels of one token of four or more letters, from ``labels(place, label)``.

    The bound is the index's own: it is held in memory where queries are expanded.
    """
    own = labels.select("place", "label", label_tokens("label").alias("t")).where((F.size("t") == 1) & (F.length(F.element_at("t", 1)) >= LEAST_LETTERS))
    first = own.groupBy(F.element_at("t", 1).alias("token")).agg(F.min(F.struct("place", "label")).alias("f"))
    return first.select("token", "f.label", "f.place").orderBy("place", "token").limit(most)


def expand_queries(queries: DataFrame, index: DataFrame) -> DataFrame:
    """``query_id, expanded``: unknown tokens of ``queries(query_id, query)`` give way to the first indexed label one edit off.

    Tokens and labels meet by what is left of them without one letter; a query of
    which nothing is replaced stays as it is.
    """
    words = queries.select("query_id", F.posexplode(F.regexp_extract_all("query", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("at", "word")).withColumn("key", F.lower("word"))
    asked = words.select("key").distinct().join(index.select(F.col("token").alias("key")), "key", "left_anti")
    asked = asked.select("key", F.explode(one_edit_keys(F.col("key"))).alias("less"))
    known = index.select("token", "label", "place", F.explode(one_edit_keys(F.col("token"))).alias("less"))
    near = asked.join(known, "less").where(one_edit(F.col("key"), F.col("token")))
    found = near.groupBy("key").agg(F.min_by("label", F.struct("place", "token")).alias("label"))
    joined = words.join(found, "key", "left")
    built = joined.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("label", "word").alias("w")))).alias("w"), F.count("label").alias("replaced"))
    built = built.where("replaced > 0").select("query_id", F.array_join(F.transform("w", lambda e: e["w"]), " ").alias("expanded"))
    return queries.join(built, "query_id", "left").select("query_id", F.coalesce("expanded", "query").alias("expanded"))


def _window_keys(tokens: Column) -> Column:
    """Hashes that a label shares with every window that names it.

    One token at most differs, by one edit: less that token, and with what is left of
    it without one letter, both agree.
    """
    n = F.size(tokens)
    rest = lambda i: F.array_join(F.concat(F.slice(tokens, F.lit(1), i - 1), F.slice(tokens, i + 1, n)), " ")
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(one_edit_keys(F.element_at(tokens, i)), lambda key: F.xxhash64(n, i, rest(i), key)))))


def query_windows(queries: DataFrame, known: DataFrame) -> DataFrame:
    """``query_id, window``: runs of a query's tokens as wide as a label of ``known(own)``."""
    # As many rows as labels have widths: MOST_TOKENS at most.
    widths = known.select(F.size("own").alias("width")).distinct()
    tokens = queries.select("query_id", label_tokens("query").alias("tokens")).join(F.broadcast(widths), F.col("width") <= F.size("tokens"))
    return tokens.select("query_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("tokens") - F.col("width") + 1), lambda i: F.slice("tokens", i, F.col("width")))).alias("window")).distinct()


def collision_candidates(windows: DataFrame, known: DataFrame) -> DataFrame:
    """``window, label, own``: distinct windows and labels of ``known(label, own)`` that share a key."""
    left = windows.select("window").distinct().select("window", F.explode(_window_keys(F.col("window"))).alias("key"))
    right = known.select("label", "own", F.explode(_window_keys(F.col("own"))).alias("key"))
    return left.join(right, "key").select("window", "label", "own").distinct()


def collisions(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """``query_id, label`` where a query of ``queries(query_id, query)`` names a label of ``labels(label)``, but for one edit.

    A window of many queries is compared once.
    """
    known = labels.select("label", label_tokens("label").alias("own")).where(F.size("own").between(1, MOST_TOKENS)).distinct()
    windows = query_windows(queries, known)
    named = collision_candidates(windows, known).where(names_label(F.col("window"), F.col("own"))).select("window", "label")
    return windows.join(named, "window").select("query_id", "label").distinct()
