"""Scores of writers, of precise recall, of rehearsals and of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.scalars import hash_split
from memlake.functions.text import key_tokens


def scope_overlaps(own: Column | str, wanted: Column) -> Column:
    """Whether a row has one of the wanted scopes; a row without any has none."""
    own = F.col(own) if isinstance(own, str) else own
    return F.coalesce(F.arrays_overlap(own, wanted), F.lit(False))


def is_current() -> Column:
    """A belief that nothing supersedes and that isn't resolved; an empty string is nothing."""
    return (F.coalesce("superseded_by", F.lit("")) == "") & (F.coalesce("resolved_at", F.lit("")) == "")


def expand_in_scope(results: DataFrame, relations: DataFrame, beliefs: DataFrame, excluded: DataFrame) -> DataFrame:
    """``query_id, id``: participants of a query's relations, current, in its scope and not excluded.

    ``results(query_id, scope, id)``, ``relations(id, participants)``, ``beliefs(id, scope,
    superseded_by, resolved_at)``, ``excluded(query_id, id)``.
    """
    parts = results.join(relations, "id").select("query_id", F.col("scope").alias("wanted"), F.explode("participants").alias("id")).distinct()
    met = parts.join(beliefs, "id").where(is_current() & scope_overlaps("scope", F.col("wanted")))
    return met.select("query_id", "id").distinct().join(excluded, ["query_id", "id"], "left_anti")


def precision_summary(graded: DataFrame) -> DataFrame:
    """One row of ``graded(expected, pinned, forbidden, allowed, got)``: what is expected is less what is pinned.

    A case passes if all of that and nothing forbidden or over was returned.
    """
    wanted = F.array_except("expected", "pinned")
    hit = F.size(F.array_intersect("got", wanted))
    missing, extra = F.size(F.array_except(wanted, "got")), F.size(F.array_except("got", F.array_union(F.array_union("expected", "pinned"), F.col("allowed"))))
    rows = graded.select(missing.alias("missing"), extra.alias("extra"), F.size(F.array_intersect("got", "forbidden")).alias("forbidden"), F.try_divide(hit.cast("double"), F.size("got").cast("double")).alias("precision"), F.try_divide(hit.cast("double"), F.size(wanted).cast("double")).alias("recall"))
    passed = (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("forbidden") == 0)
    return rows.agg(F.count("*").alias("cases"), F.count_if(passed).alias("passes"), F.sum("missing").alias("missing"), F.count_if(F.col("extra") > 0).alias("over_return"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"))


def claim_matches(memories: DataFrame, claims: DataFrame) -> DataFrame:
    """``case_id, memory, claim_id, kind`` of the memories of a case that bear out, or break, a claim of it.

    ``memories(case_id, memory, content, subject, evidence)``, ``claims(case_id, claim_id, kind,
    all_terms, any_terms, exempt, subject, evidence)``; kinds are required, allowed and
    forbidden.  The text must have all of the one terms and any of the other; required
    and allowed claims also share evidence, forbidden ones aren't broken by a text with
    an exempt term.  A case's memories and claims, a few of each, meet by its id.
    """
    met = memories.join(claims.withColumnRenamed("subject", "about").withColumnRenamed("evidence", "proof"), "case_id")
    low = F.lower("content")
    has = lambda t: F.contains(low, F.lower(t))
    text = F.forall("all_terms", has) & ((F.size("any_terms") == 0) | F.exists("any_terms", has)) & (F.col("about").isNull() | F.coalesce(F.col("subject") == F.col("about"), F.lit(False)))
    proven = F.coalesce(F.arrays_overlap("evidence", "proof"), F.lit(False))
    broken = (F.col("kind") == "forbidden") & ~F.exists("exempt", has)
    return met.where(text & F.when(F.col("kind") == "forbidden", broken).otherwise(proven)).select("case_id", "memory", "claim_id", "kind")


def writer_cases(cases: DataFrame, memories: DataFrame, claims: DataFrame, operations: DataFrame) -> DataFrame:
    """Counts of every kind of failure of each case, and whether it passed.

    ``cases(case_id, domain, split, trace, quiet, seeds)``: a quiet case wants no memory;
    ``seeds`` may not be changed.  ``operations(case_id, op, target, memory)``; a claim may
    name the operation that it wants, ``want_op`` and ``want_target``.
    """
    met = claim_matches(memories, claims)
    required = claims.where("kind = 'required'")
    per_claim = required.select("case_id", "claim_id", "want_op", "want_target").join(met.where("kind = 'required'").select("case_id", "claim_id", "memory"), ["case_id", "claim_id"], "left")
    done = operations.select("case_id", "memory", F.col("op").alias("did"), F.col("target").alias("did_target"))
    fits = (F.col("did") == F.col("want_op")) & F.when(F.col("want_op") == "add", F.col("did_target").isNull()).otherwise(F.col("did_target").eqNullSafe(F.col("want_target")))
    claim = per_claim.join(done, ["case_id", "memory"], "left").groupBy("case_id", "claim_id", "want_op").agg(F.count_distinct("memory").alias("n"), F.coalesce(F.bool_or(fits), F.lit(False)).alias("fits"))
    claim = claim.groupBy("case_id").agg(F.count("*").alias("required_claims"), F.count_if(F.col("n") > 0).alias("required_found"), F.count_if(F.col("n") > 1).alias("duplicate_claims"), F.count_if((F.col("n") > 0) & F.col("want_op").isNotNull() & ~F.col("fits")).alias("unmatched"))
    supported = met.where("kind <> 'forbidden'").select("case_id", "memory").distinct().withColumn("supported", F.lit(True))
    one = memories.join(supported, ["case_id", "memory"], "left").join(cases.select("case_id", "trace"), "case_id")
    per_memory = one.groupBy("case_id").agg(F.count("*").alias("memories"), F.count_if(F.col("supported").isNull()).alias("unsupported_memories"), F.count_if(F.size(F.array_except("evidence", "trace")) > 0).alias("evidence_failures"), F.sum(F.length("content")).alias("content_chars"))
    broken = met.where("kind = 'forbidden'").groupBy("case_id").agg(F.count("*").alias("forbidden_violations"))
    changed = operations.where("op in ('update', 'supersede') and target is not null").select("case_id", "target").distinct()
    kept = changed.join(cases.select("case_id", F.explode("seeds").alias("target")), ["case_id", "target"], "left_semi").groupBy("case_id").agg(F.count("*").alias("preserved_seed_violations"))
    expected = required.where("want_op in ('update', 'supersede')").select("case_id", F.col("want_target").alias("target")).distinct()
    odd = changed.join(expected, ["case_id", "target"], "left_anti").groupBy("case_id").agg(F.count("*").alias("unexpected"))
    acted = operations.groupBy("case_id").agg(F.count("*").alias("operations"))
    out = cases.select("case_id", "domain", "split", "quiet")
    for part in (claim, per_memory, broken, kept, odd, acted):
        out = out.join(part, "case_id", "left")
    counts = [c for c in out.columns if c not in ("case_id", "domain", "split", "quiet")]
    out = out.fillna(0, counts).withColumn("operation_failures", F.col("unmatched") + F.col("unexpected")).withColumn("missing_required", F.col("required_claims") - F.col("required_found"))
    noisy = F.col("quiet") & ((F.col("memories") > 0) | (F.col("operations") > 0))
    failures = ("missing_required", "duplicate_claims", "operation_failures", "unsupported_memories", "evidence_failures", "forbidden_violations", "preserved_seed_violations")
    fine = ~noisy
    for c in failures:
        fine = fine & (F.col(c) == 0)
    return out.select("case_id", "domain", "split", "required_claims", "required_found", *failures, noisy.alias("noisy"), "content_chars", fine.alias("passed"))


def writer_metrics(scored: DataFrame) -> DataFrame:
    """Sums of scored cases, by domain, by split and over all."""
    sums = [F.sum(c).alias(c) for c in ("required_claims", "required_found", "unsupported_memories", "forbidden_violations", "duplicate_claims", "operation_failures", "evidence_failures", "preserved_seed_violations", "content_chars")]
    recall = F.round(F.coalesce(F.try_divide(F.sum("required_found").cast("double"), F.sum("required_claims").cast("double")), F.lit(1.0)), 6)
    return scored.groupingSets([["domain"], ["split"], []], "domain", "split").agg(F.count_if("passed").alias("passed_cases"), F.count_if(~F.col("passed")).alias("failed_cases"), *sums, recall.alias("required_claim_recall"))


def label_metrics(records: DataFrame) -> DataFrame:
    """One row of held-out ``records(expected, forbidden, found, found_forbidden, oversized, failed)``: recall, rates, budget."""
    fine = records.where("not failed")
    rate = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    found, wanted = F.sum(F.size(F.array_intersect("expected", "found"))), F.sum(F.size("expected"))
    bad, banned, n = F.sum(F.size("found_forbidden")), F.sum(F.size("forbidden")), F.count("*")
    some, within = F.count_if(F.size("found_forbidden") > 0), F.count_if(~F.col("oversized"))
    errors = records.agg(F.count_if("failed").alias("errors"))
    out = fine.agg(n.alias("cases"), rate(found, wanted).alias("task_recall"), rate(bad, banned).alias("forbidden_label_rate"), rate(some, n).alias("forbidden_case_rate"), rate(within, n).alias("budget_pass_rate"))
    return out.crossJoin(F.broadcast(errors))


def attempt_outcomes(predicted: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``attempt_id`` with how many predicted cases were fixed, missed or passed already, and what passed before and broke unforeseen.

    ``predicted(attempt_id, case_id)``, ``before`` and ``after(attempt_id, case_id, passed)``.
    """
    key = ["attempt_id", "case_id"]
    cases = before.select(*key, F.col("passed").alias("was")).join(after.select(*key, F.col("passed").alias("now")), key).join(predicted.select(*key, F.lit(True).alias("foreseen")), key, "left")
    foreseen = F.coalesce("foreseen", F.lit(False))
    was, now = F.col("was"), F.col("now")
    return cases.groupBy("attempt_id").agg(
        F.count_if(foreseen & ~was & now).alias("fixed"), F.count_if(foreseen & ~now).alias("missed"), F.count_if(foreseen & was & now).alias("already"), F.count_if(~foreseen & was & ~now).alias("collateral"), F.count_if(now).alias("passed"), F.count("*").alias("total")
    )


def calibration(attempts: DataFrame) -> DataFrame:
    """Fixed by predicted cases of evaluated ``attempts(objective, backfilled, predicted, fixed, evaluated_at)``, by objective and by when they were written."""
    done = attempts.where("predicted > 0 and evaluated_at is not null")
    written = F.when(F.coalesce("backfilled", F.lit(False)), "backfilled").otherwise("fresh")
    out = done.groupBy(F.coalesce("objective", F.lit("unknown")).alias("objective"), written.alias("written")).agg(F.sum("predicted").alias("predicted"), F.sum("fixed").alias("fixed"), F.count("*").alias("attempts"))
    return out.withColumn("hit_rate", F.round(F.col("fixed") / F.col("predicted"), 6))


def rehearsal_probes(items: DataFrame) -> DataFrame:
    """``probe_id, query, target, canonical_name, alias, split``: a label and a key token of each item that has both.

    A token with a digit comes before others, else the first that isn't the label.
    """
    label = F.trim(F.coalesce("canonical_name", F.lit("")))
    others = F.filter(key_tokens("content"), lambda t: F.lower(t) != F.lower(label))
    digits = F.filter(others, lambda t: F.regexp_like(t, F.lit("[0-9]")))
    attribute = F.coalesce(F.try_element_at(digits, F.lit(1)), F.try_element_at(others, F.lit(1)))
    rows = items.select(F.col("id").alias("probe_id"), F.concat(label, F.lit(" "), attribute).alias("query"), F.col("id").alias("target"), label.alias("canonical_name"), "alias", hash_split("id").alias("split"))
    return rows.where((F.col("canonical_name") != "") & F.col("query").isNotNull())


def rehearsal_controls(probes: DataFrame, numbered: DataFrame) -> DataFrame:
    """Every probe with the next one's target, the last with the first one's: these must miss.

    ``numbered`` are the probes with ``i`` from 0, so no window holds them all.
    """
    n = probes.agg(F.count("*").alias("n"))
    shifted = numbered.select(F.col("i").alias("next"), F.col("target").alias("wrong"))
    met = numbered.crossJoin(F.broadcast(n)).where("n > 1").withColumn("next", (F.col("i") + 1) % F.col("n")).join(shifted, "next")
    return met.select(F.concat(F.lit("control:"), F.col("probe_id").cast("string")).alias("probe_id"), "query", F.col("wrong").alias("target"), "split")


def alias_fixes(misses: DataFrame, items: DataFrame) -> DataFrame:
    """``target, content``: items that say a missed probe's one-word alias, told again under their label.

    Items and rules meet by label and word, so no item is compared with every rule of
    its label; an item goes by a hash of its columns until its text is needed.
    """
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rules = misses.where((F.length("alias") >= 2) & (F.size(words("alias")) == 1)).select("canonical_name", F.lower("alias").alias("rule")).distinct()
    keyed = items.drop("alias").withColumn("_key", F.xxhash64("id", "canonical_name", "content"))
    said = keyed.select("_key", "canonical_name", F.explode(F.array_distinct(words("content"))).alias("rule"))
    hits = said.join(rules, ["canonical_name", "rule"], "left_semi").select("_key").distinct()
    met = keyed.join(hits, "_key", "left_semi")
    return met.select(F.col("id").alias("target"), F.concat("canonical_name", F.lit(": "), "content").alias("content")).distinct()


def rehearsal_summary(scored: DataFrame) -> DataFrame:
    """``split, probes, hits, wrong_top1, over_return`` of ``scored(probe_id, target, split, control, got)``, controls left out; ``got`` has ids, best first."""
    hit = F.array_contains("got", F.col("target"))
    first = F.try_element_at("got", F.lit(1))
    over = F.size("got") - hit.cast("int")
    return scored.where("not control").groupBy("split").agg(F.count("*").alias("probes"), F.count_if(hit).alias("hits"), F.count_if(first.isNotNull() & (first != F.col("target"))).alias("wrong_top1"), F.sum(over).alias("over_return"))


def keeps_batch(before: DataFrame, after: DataFrame, fabricated: DataFrame) -> DataFrame:
    """One row, ``keep``: held-out hits rise, over-returns and fabricated rows don't, and there are fixes.

    ``before`` and ``after`` are summaries, ``fabricated(before, after, fixes)`` one row.
    """
    b = before.where("split = 'held'").select(F.col("hits").alias("hits_before"), F.col("over_return").alias("over_before"))
    a = after.where("split = 'held'").select("hits", "over_return")
    joined = b.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(fabricated))
    return joined.select(((F.col("fixes") > 0) & (F.col("hits") > F.col("hits_before")) & (F.col("over_return") <= F.col("over_before")) & (F.col("after") <= F.col("before"))).alias("keep"))


def states_against_reference(grades: DataFrame, reference: str) -> DataFrame:
    """``state, metric, n, mean`` of ``grades(state, probe_id, metric, value)``: each state's mean difference from the reference over common probes."""
    base = grades.where(F.col("state") == reference).select("probe_id", "metric", F.col("value").alias("base"))
    met = grades.where(F.col("state") != reference).join(base, ["probe_id", "metric"])
    return met.groupBy("state", "metric").agg(F.count("*").alias("n"), F.round(F.avg(F.col("base") - F.col("value")), 6).alias("mean"))


def numbered_pairs(grades: DataFrame, reference: str, state: str, metric: str) -> DataFrame:
    """``probe_id, diff`` of one state and metric, for an interval."""
    one = grades.where((F.col("metric") == metric) & F.col("state").isin(state, reference))
    sides = one.groupBy("probe_id").agg(F.max(F.when(F.col("state") == reference, F.col("value"))).alias("b"), F.max(F.when(F.col("state") == state, F.col("value"))).alias("a"))
    return sides.where("a is not null and b is not null").select("probe_id", (F.col("b") - F.col("a")).alias("diff"))


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("place = 1").drop("place")
