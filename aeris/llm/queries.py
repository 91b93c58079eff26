"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeris.llm import (chat, decontaminate, exact_dedup, fill_middle, html_text, jaccard_join, lang_id, licenses, packing,
                       prefix_trie, repeats, sql, token_count, warc)
from aeris.llm.common import read_table, ship


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a vocabulary of the public tokenizers lies on this machine (the same place on every machine)."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read_table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(read_table(spark, sf_dir, "pages")).drop("target_uri")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(read_table(spark, sf_dir, "conversations"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_id(read_table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.transform(read_table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(text, 256).alias("restored_sha256"))


def op12_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)
    query.__name__, query.__doc__ = f.__name__, f.__doc__
    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f) for f in (
        op1_html_text, op2_license_scan, op3_jaccard_join, op4_warc, op5_exact_dedup, op6_packing, op7_chat_collapse,
        op8_language_id, op9_repeats, op10_decontaminate, op11_fill_middle, op12_token_count, op13_prefix_trie)}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": sql.EXACT_DEDUP, "op7_chat_collapse": sql.CHAT_COLLAPSE, "op11_fill_middle": sql.FILL_MIDDLE,
    "op13_prefix_trie": sql.PREFIX_TRIE}
