"""The corpus queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridproof.llm import line_dedup, ngram_join, substring_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridproof.llm import quality_crf

    docs = table(spark, sf_dir, "documents")
    return quality_crf.judge(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridproof.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridproof.llm import token_counts

    vocabulary = token_counts.Vocabulary.from_sentencepiece(token_counts.DEFAULT_MODEL)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridproof.llm.mixing import mix_plan

    return mix_plan(table(spark, sf_dir, "documents")).taken()


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridproof.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridproof.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.expr("aggregate(spans, 0L, (n, x) -> n + x.stop - x.start)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridproof.llm.maxent_lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def _lines_left(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two lines alone, as its SQL has it."""
    return _lines_left(line_dedup.dedup_lines(table(spark, sf_dir, "documents"), line_words=None))


def op9_long_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two lines, and long lines by themselves, as in the pipeline."""
    return _lines_left(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridproof.llm.pii import digest, find_personal_data

    return digest(find_personal_data(table(spark, sf_dir, "documents")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridproof.llm import conversation_repair

    return conversation_repair.digest(conversation_repair.repair(conversation_repair.with_damage(table(spark, sf_dir, "conversations"))))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (n, x) -> n + x.stop - x.start)").alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridproof.llm import periodic_runs

    return periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_importance": op5_importance,
    "op6_ngram_join": op6_ngram_join,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_line_dedup": op9_line_dedup,
    "op9_long_line_dedup": op9_long_line_dedup,
    "op10_pii": op10_pii,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op6_ngram_join": ngram_join.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op9_long_line_dedup": line_dedup.ORACLE_LONG_LINES,
    "op12_substring_dedup": substring_dedup.ORACLE,
}
