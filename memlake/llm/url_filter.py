"""URL allow and block rules by a sort-merge range join with a sorted sweep.

A rule is (host, path prefix).  Its canonical key is the reversed host, then the
path; the URLs of exactly that host whose path begins so are one interval of
keys.  Subdomains come in by the URL's side: each URL enters the sweep once for
every suffix of its host.  Rule intervals are nested or apart, so a sweep over
rules and URLs in key order has a stack of active rules; each rule's opening and
closing carries the stack as it is afterwards, and a URL takes the top of the
stack that was last set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm.session import checkpointed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The default rules: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rule_events(rules: DataFrame) -> DataFrame:
    """``rules(verdict, host, path)`` to ``(key, side, stack)``: the active rules, innermost last, from that key on.

    A rule closes just before the first key that doesn't begin with its own.  Its
    ancestors are found by joining the rules of one host on the prefixes of its path.
    """
    path = F.when(F.coalesce("path", F.lit("")) == "", F.lit("/")).otherwise(F.col("path"))
    rules = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), path.alias("path"))
    named = rules.select("verdict", "host", "path", F.concat(_reversed(F.col("host")), "path").alias("key")).dropDuplicates(["key"])
    prefixes = named.select("key", F.explode(F.transform(F.sequence(F.length("key") - F.length("path") + 1, F.length("key")), lambda i: F.substring(F.col("key"), F.lit(1), i))).alias("above"))
    holders = named.select(F.col("key").alias("above"), F.struct(F.length("key").alias("n"), F.length("host").alias("host_n"), F.concat("host", "path").alias("rule"), "verdict").alias("item"))
    stacks = prefixes.join(holders, "above").groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("stack"))
    # Keys are compared as bytes: no UTF-8 text has a byte 0xFF, so all that begins with a key lies before the key and that byte.
    key = F.col("key").cast("binary")
    opened = stacks.select(key.alias("key"), F.lit(0).alias("side"), F.lit(0).alias("depth"), "stack")
    closed = stacks.select(F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("side"), (-F.size("stack")).alias("depth"), F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack"))
    return opened.unionByName(closed)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row; ``rule`` is null where none fits.

    A rule fits its host and all subdomains if the URL's path begins with the
    rule's, whatever characters follow; the longest rule (host and path) wins, of
    equal ones the longer host.
    Null URLs and those without ``://`` have an empty host and path, fit no rule
    and get the default.  Repeated rows are judged each.  An empty path fits no
    rule, as all rules' paths begin with ``/``.  URLs of any length are judged whole.
    Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.monotonically_increasing_id().alias("row"))
    rows = checkpointed(rows)
    labels = F.reverse(F.split("host", r"\."))
    # A suffix of more labels than any rule's host has is no rule's: a host of many labels has few keys.
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    keys = rows.where("host <> '' and path <> ''").select(
        "row", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.col("path")).cast("binary"))).alias("key")
    )
    stack_type = "array<struct<n:int,host_n:int,rule:string,verdict:string>>"
    events = rule_events(rules).select("key", "side", "depth", F.lit(None).cast("long").alias("row"), F.col("stack").cast(stack_type).alias("stack"))
    urls = keys.select("key", F.lit(1).alias("side"), F.lit(0).alias("depth"), "row", F.lit(None).cast(stack_type).alias("stack"))
    # The row is part of the order, so that equal keys spread over partitions.
    order = ["key", "side", "depth", "row"]
    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = checkpointed(urls.unionByName(events).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    # What the parts before leave open: one row for each part, so these are broadcast.
    ends = dealt.where("side <> 1").groupBy("part").agg(F.max_by("stack", F.struct("key", "side", "depth")).alias("stack"))
    every = dealt.select("part").distinct().join(ends, "part", "left")
    carried = every.select("part", F.last("stack", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    # Only parts in which the stack changes are swept; in the others all rows have what is carried in.
    swept = dealt.join(F.broadcast(ends.select(F.col("part"), F.lit(True).alias("changes"))), "part", "left")
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    changing = swept.where("changes").withColumn("active", F.last("stack", ignorenulls=True).over(within)).where("side = 1").select("part", "row", "active")
    steady = swept.where("changes is null").select("part", "row", F.lit(None).cast(stack_type).alias("active"))
    placed = changing.unionByName(steady).join(F.broadcast(carried), "part", "left").select("row", F.try_element_at(F.coalesce("active", "carried"), F.lit(-1)).alias("top"))
    judged = placed.where("top is not null").groupBy("row").agg(F.max("top").alias("top"))
    out = rows.join(judged, "row", "left")
    return out.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")
