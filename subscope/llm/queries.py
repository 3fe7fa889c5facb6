"""One query per corpus operator: production parameters, the whole table, the whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from subscope.llm import clusters, exact, language, licenses, manifest, mixing, packing, passages, pii, sharding, simhash, token_files, topk
from subscope.llm.common import table
from subscope.session import stage_path

#: The tokenizer that packing counts with; a file the workers have as well.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents")).drop("_mark")


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mixture(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "size", "source_size", "target", "taken", "copies", F.get("positions", F.lit(0)).alias("first_position")
    )


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.of_documents(spark, table(spark, sf_dir, "documents"), sf_dir).drop("_mark")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("_mark")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    base = [k.name for k in pii.KINDS if k.base]
    of_kind = lambda kind: F.filter("found", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in base]
    kept = pii.listed(F.filter("found", lambda s: s["kind"].isin(*base)))
    return found.select(
        "doc_id", *counts, F.sha2(kept, 256).alias("base_sha256"), pii.listed(F.col("found")).alias("spans"),
        F.array_max(F.transform("found", lambda s: s["score"])).alias("top_score"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    named = F.array_sort(F.array_union("base", F.transform("blocks", lambda b: b["label"])))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(named, ",").alias("labels"), "score",
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "shard_of_more", "text_group",
    )


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.centroid_clusters(table(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), stage_path(spark, "tokens"), tokenizer_path())


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents")).drop("path")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_exact_dedup, op2_mixture, op3_top_k, op4_passages, op5_language_id, op6_simhash, op7_pii, op8_licenses,
            op9_packing, op10_sharding, op11_clusters, op12_token_files, op13_manifest,
        )
    }
