"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, compaction, exactdedup, filteraudit, fingerprints, licenses, mixing, orctokens, packing, pii, quality, simhash, urlfilter
from ._shared import scratch, table
from .tokens import public_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), 1)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    hosts = spark.createDataFrame([(h,) for h in urlfilter.BLOCKED], "host string")
    return urlfilter.judge(pages, blocked=urlfilter.link_lists(pages).union(hosts))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op8_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    orctokens.write_tokens(table(spark, sf_dir, "documents"), path, public_path("word_bpe_49k.json"), 2)
    return orctokens.token_digests(spark, path)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op10_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compacted(table(spark, sf_dir, "documents"), scratch(spark, "shards"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(pii.find_pii(table(spark, sf_dir, "documents")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(instructions(table(spark, sf_dir, "conversations")), public_path("byte_bpe_50k.json"), 1, prompt_col="prompt", max_segments=4, max_loss=1536)


def instructions(conversations: DataFrame) -> DataFrame:
    """(doc_id, prompt, text): every turn of an assistant with the user's turn before it as a prompt, which bears no loss.

    doc_id is conv_id * 2^20 + turn, so that conversations of up to a million turns don't clash. Without a user's turn just
    before there is no prompt; of several rows of one such turn the least text is it, so that rows don't multiply. A null
    text is empty, rows without conv_id or turn have no prompt and no id, other roles and nulls are left out; repeated turns
    of an assistant are packed each. An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    asked = turns.filter("role = 'user'").groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("prompt"))
    pairs = turns.filter("role = 'assistant'").select("conv_id", "turn", "text").join(asked, ["conv_id", "turn"], "left")
    return pairs.select((F.col("conv_id") * (1 << 20) + F.col("turn")).alias("doc_id"), "prompt", "text")


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_winnowing": op2_winnowing,
    "op3_simhash": op3_simhash,
    "op4_url_filter": op4_url_filter,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_mixing": op7_mixing,
    "op8_orc_tokens": op8_orc_tokens,
    "op9_quality": op9_quality,
    "op10_compaction": op10_compaction,
    "op11_pii": op11_pii,
    "op12_alignment": op12_alignment,
    "op13_filter_audit": op13_filter_audit,
    "instruction_packing": instruction_packing,
}
ORACLES: dict[str, str] = {"op4_url_filter": urlfilter.oracle(own=True), "op5_exact_dedup": exactdedup.ORACLE, "op13_filter_audit": filteraudit.ORACLE}
