"""The named queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import ann, contamination, html_text, lm_score, merkle, mixing, negatives, packing, pii, quality, simhash, sketch, substrings
from marquee.llm.common import table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.KEEP_AT).cast("int").alias("predicted"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = html_text.extracted(pages, html_text.train(pages))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(table(spark, sf_dir, "documents").select("doc_id", "text"), own=False)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_likeness(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.digest("base"), 256).alias("base_sha256"),
        pii.digest("spans").alias("spans"),
    )


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(tampers, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = merkle.leaf_hash(*head, tampered)
    found = merkle.manifest(
        table(spark, sf_dir, "documents"),
        group=F.col("source"),
        order=F.col("doc_id"),
        leaf=merkle.leaf_hash(*head, F.col("text")),
        row=F.struct("doc_id", changed.alias("changed")),
    )
    folded = found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")],
        merkle.proof_hash("witness").alias("proof_sha256"),
        merkle.folded_root("row.changed", "witness").alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = contamination.windows(table(spark, sf_dir, "benchmark"), F.col("item_id"), F.col("text"))
    found = contamination.scanned(table(spark, sf_dir, "documents"), F.col("text"), F.col("doc_id"), windows)
    return found.select(
        F.col("row").alias("doc_id"),
        "n_words",
        contamination.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings")
    rows = negatives.stored(vectors, F.col("vec_id"), label, F.col("embedding"), scale=256.0)
    return negatives.mine(rows, is_anchor=F.col("vec_id") % 100 == 0, positives=5, negatives=5, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_html_extraction": op3_html_extraction,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_backoff_scores": op5_backoff_scores,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_personal_data": op8_personal_data,
    "op9_source_mix": op9_source_mix,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_benchmark_decontamination": op12_benchmark_decontamination,
    "op13_hard_negatives": op13_hard_negatives,
}
