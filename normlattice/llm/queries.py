"""The registered queries op1 to op13 with their production parameters, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, divergence, language_id, manifest, quality_knn, quality_rules, secrets, simhash, suffix_dedup, tokens, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def held_out(doc_id: str = "doc_id"):
    """A third of the documents, from whose labels nothing is learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_knn.fit(docs, _table(spark, sf_dir, "labels").filter(~held_out()))
    return quality_knn.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_model", "n_confirmed")


#: The rules of op4, the hosts whose canonical URLs make its list, and which of them: those whose MD5 starts below LISTED_SHARE.
URL_RULES = [
    url_filter.Rule("net/", "block"),
    url_filter.Rule("example.net/en/", "allow"),
    url_filter.Rule("example.com/de/", "block"),
    url_filter.Rule("org/fr/", "allow"),
]
LISTED_HOSTS = r"(^|\.)(casino-win|free-bets|spam-farm|cheap-pills|adult-x|ads-track)\."
LISTED_SHARE = "a"


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(url_filter.host_of(F.col("url")).rlike(LISTED_HOSTS) & (F.md5(F.col("url").cast("binary")) < LISTED_SHARE))
    return url_filter.judge(pages, listed, URL_RULES)


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the public tokenizers; TOKENIZER_DIR names another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_copies(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = warc.records(_table(spark, sf_dir, "pages"))
    return warc.audit(warc.tree(warc.leaves(recs)), warc.tree(warc.leaves(warc.damaged(recs))))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    apart = language_id.held_out(F.col("doc_id"))
    out = language_id.identify(docs, language_id.fit(docs.filter(~apart)))
    return out.select("doc_id", apart.alias("held_out"), "lang_pred", "score", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_secret_scans": op3_secret_scans,
        "op4_url_filters": op4_url_filters,
        "op5_token_counts": op5_token_counts,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_suffix_array_dedup": op7_suffix_array_dedup,
        "op8_warc_fixity": op8_warc_fixity,
        "op9_quality_rules": op9_quality_rules,
        "op10_bpe": op10_bpe,
        "op11_source_divergence": op11_source_divergence,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_language_id": op13_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filters": url_filter.oracle_sql(URL_RULES, LISTED_HOSTS, LISTED_SHARE),
        "op8_warc_fixity": warc.ORACLE_SQL,
        "op9_quality_rules": quality_rules.ORACLE_SQL,
        "op11_source_divergence": divergence.ORACLE_SQL,
        "op12_merkle_manifest": manifest.oracle_sql(),
    }
