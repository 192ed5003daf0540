"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayspark.sources.stages import fresh_path
from assayspark.sources.tables import load_table

from . import (
    byte_bpe,
    conversation_trie,
    decontamination,
    hard_negatives,
    language_id,
    license_scan,
    near_dedup,
    personal_data,
    quality_rules,
    sharding,
    substring_dedup,
    token_counts,
    url_filters,
)

SHARDS = 8


def _vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.document_licenses(load_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(load_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(load_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.find_personal_data(load_table(spark, sf_dir, "documents")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = _vocabulary()
    texts = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode_texts(texts, ranks, pattern).select("doc_id", "ids")
    decoded = byte_bpe.decode_ids(encoded, ranks, pattern)
    return decoded.select(
        "doc_id", byte_bpe.id_count(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_verdicts(load_table(spark, sf_dir, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *names, "base_failed", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")
    judged = url_filters.judge_urls(load_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents under two tokenizer versions, revise one of them, repeat a batch: the totals of what holds."""
    ranks, pattern = _vocabulary()
    docs = load_table(spark, sf_dir, "documents")
    first = token_counts.word_counts(docs, "words-1")
    second = token_counts.word_counts(docs, "words-2", r"[^\p{L}\p{N}]+")
    rollup = fresh_path(spark, "rollup")
    load = token_counts.signed(token_counts.bpe_counts(docs, {"byte_bpe_50k": ranks}, pattern), 1)
    token_counts.commit_batch(spark, rollup, "load", load.unionByName(token_counts.signed(first, 1)))
    revised = token_counts.signed(first, -1).unionByName(token_counts.signed(second, 1))
    for _ in range(2):
        token_counts.commit_batch(spark, rollup, "revise", revised)
    return token_counts.totals(spark, rollup, ["load", "revise"])


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = language_id.fit_languages(docs, ~held_out & F.col("doc_id").isNotNull(), F.col("doc_id"))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = conversation_trie.conversations_of(load_table(spark, sf_dir, "conversations"))
    conv_id = F.col("conv_id")
    head = (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("int")
    return conversation_trie.prefix_trie(conversation_trie.rebuild(own, conv_id - conv_id % 20, head))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = hard_negatives.whole_numbers(load_table(spark, sf_dir, "embeddings"), vec_id, F.col("embedding"), moved)
    return hard_negatives.mine(rows, vec_id % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_substring_dedup, op3_near_dedup, op4_sharding, op5_personal_data,
        op6_byte_bpe, op7_quality_rules, op8_decontamination, op9_url_filters, op10_token_counts,
        op11_language_id, op12_conversation_trie, op13_hard_negatives,
    )
}

ORACLE = {
    "op9_url_filters": url_filters.SQL, "op12_conversation_trie": conversation_trie.SQL, "op13_hard_negatives": hard_negatives.SQL,
}
