"""The registered query of each corpus operator: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, decontamination, html_text, jaccard_join, license_scans, line_dedup, lm_scoring, minhash, phrases, quality_rules, sentencepieces, suffix_dedup, url_filters
from .common import table

#: (host, path, allow); the names in results are host and path.
URL_RULES = [
    url_filters.Rule("org", "/", True),
    url_filters.Rule("example.org", "/es/", False),
    url_filters.Rule("example.org", "/en/1", False),
    url_filters.Rule("com", "/fr/", True),
    url_filters.Rule("com", "/de/", False),
]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: its lines, how many go, and the digest of the text that is left."""
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), held_out)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: its pieces, their number and digest, and whether they decode to the text; parity: whether the sentencepiece library's
    pieces and text are the same."""
    encoded = sentencepieces.encode_texts(table(spark, sf_dir, "documents"), ["doc_id", "text"], check=F.lit(True))
    digest = F.sha2(F.array_join(F.col("pieces").cast("array<string>"), ",").cast("binary"), 256)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return encoded.select("doc_id", "n_pieces", digest.alias("pieces_sha256"), same.alias("round_trip"), "parity", "pieces")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4).select("doc_id", "n_shingles", "component_id", "kept")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scans.scan_licenses(table(spark, sf_dir, "documents"), license_scans.known_licenses(spark))
    return found.withColumn("notices", F.array_join("notices", ","))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontamination.find_contamination(docs, items, ["doc_id"])
    items_sha256 = decontamination.items_digest(F.col("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_sha256.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.turns_in_order(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(conversation_trie.sequences(conversation_trie.rebuilt(turns)))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"))
