"""The corpus operators as queries over the documents tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import language_id, lm_score, pii
from memlake.llm.collocations import collocations
from memlake.llm.decontaminate import contaminated_spans
from memlake.llm.fill_in_middle import fill_in_middle
from memlake.llm.minhash_dedup import near_duplicates
from memlake.llm.mixing import mix
from memlake.llm.quality_rules import apply_quality_rules
from memlake.llm.secret_scan import BASE_RULES, scan_secrets, spans_text
from memlake.llm.simhash_dedup import simhash_groups
from memlake.llm.toxicity import held_out, score_documents
from memlake.llm.toxicity import train as train_toxicity
from memlake.llm.url_filter import filter_urls, rules_frame


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(_table(spark, sf_dir, "documents"), num=85, den=100)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = train_toxicity(documents, labels.where(~held_out(F.col("doc_id"))))
    scored = score_documents(documents, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "sentences")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), rules_frame(spark))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.train_and_score(documents, good)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    prototypes = language_id.train(documents.where(~out))
    return language_id.identify(documents, prototypes).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(base).cast("binary"), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    chars = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return made.select("doc_id", "n", "form", *chars, "output_sha256", "restored_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_url_filter": op5_url_filter,
    "op6_lm_score": op6_lm_score,
    "op7_language_id": op7_language_id,
    "op8_mix_sources": op8_mix_sources,
    "op9_secret_scan": op9_secret_scan,
    "op10_pii": op10_pii,
    "op11_collocations": op11_collocations,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}
