"""The corpus pipeline: each stage calls one operator on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm import decontamination, line_dedup, minhash, quality_rules, sentencepieces
from quaymark.llm.common import table, written

#: No SQL expresses the tokenizer's stage; tests hold the rows against a plain version of every stage.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go."""
    rows = docs.select(F.struct("*").alias("_row"), "text", "lang", "source")
    return quality_rules.judge(rows, ["_row"], store=False).where("kept").select("_row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that repeat go, n_chars follows the text, and documents that lose lines and keep no word go."""
    left = line_dedup.dedup_lines(docs.select(F.struct("*").alias("_row"), "doc_id", "text"))
    left = left.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    n_chars = F.when(F.col("n_removed") == 0, F.col("_row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return left.select(F.col("_row").withField("text", F.col("text")).withField("n_chars", n_chars).alias("_row")).select("_row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on shingles of five words: of each group the document with the smallest id stays. Rows of one id with different texts go or stay by their own
    texts; rows without an id go if their text is another document's."""
    gone = minhash.near_duplicates(docs.select("doc_id", "text"), shingle_words=5).where("not kept").select(F.col("doc_id").alias("_id"), "text_hash").distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("text_hash")), "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with words of a benchmark window go."""
    rows = docs.select(F.struct("*").alias("_row"), "text")
    found = decontamination.find_contamination(rows, table(spark, sf_dir, "benchmark"), ["_row"])
    return found.where("n_hit = 0").select("_row.*")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: every text's pieces, and whether they decode to the text."""
    rows = docs.select(F.struct("*").alias("_row"), "text")
    out = sentencepieces.encode_texts(rows, ["_row"])
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("pieces", "n_pieces", "round_trip")]
    return out.select(*kept, "pieces", "n_pieces", (F.col("decoded") == F.coalesce(F.col("_row.text"), F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("sentencepiece", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
