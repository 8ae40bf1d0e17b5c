"""The registered corpus queries: thin, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, licences, lines, quality, warc
from .common import table


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives, responses

    d = derivatives(responses(table(spark, sf_dir, "pages")))
    return d.select(
        "page_id",
        F.col("record_id").alias("refers_to"),
        "conversion_id",
        "metadata_id",
        "payload_digest",
        "lang",
        "n_links",
        F.octet_length("text").cast("long").alias("text_bytes"),
        F.sha2("text", 256).alias("text_sha256"),
        F.sha2("conversion_record", 256).alias("conversion_sha256"),
        F.sha2("metadata_record", 256).alias("metadata_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import BASE, POLICIES, ledger, verdict

    led = ledger(table(spark, sf_dir, "documents"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits", (~verdict(BASE)).alias("base_failed"), verdict(POLICIES[1]).alias("kept")
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import ablations, ledger

    return ablations(ledger(table(spark, sf_dir, "documents")))


def op4_multi_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), window=50).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licence", "dice", "line", "n_found")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import lpt_shards

    d = lpt_shards(table(spark, sf_dir, "documents"), shards=40)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dialogues import damaged, report

    conversations = table(spark, sf_dir, "conversations")
    return report(conversations, damaged(conversations))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifier import classify

    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


QUERIES = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_quality_rules": op2_quality_rules,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_multi_index_neighbours": op4_multi_index_neighbours,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_bpe": op6_bpe,
    "op7_licence_scan": op7_licence_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_lpt_shards": op9_lpt_shards,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_collocations": op11_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_quality_classifier": op13_quality_classifier,
    "quality_ablation": quality_ablation,
}

ORACLES: dict[str, str] = {
    "op1_warc_derivatives": warc.SQL,
    "op2_quality_rules": quality.SQL_LEDGER,
    "op7_licence_scan": licences.SQL,
    "quality_ablation": quality.SQL_ABLATION,
    "op8_line_dedup": lines.SQL,
    "op11_collocations": collocations.SQL,
}
