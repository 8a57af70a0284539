"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe_digests
from .conversation_trie import prefix_trie
from .embedding_dedup import near_duplicate_vectors
from .mixing import mix_sources
from .ngram_jaccard import ngram_jaccard_join, ngram_jaccard_links
from .quality import quality_rules
from .secrets import find_secrets
from .suffix_dedup import suffix_dedup
from .token_files import token_files_round_trip
from .tool_calls import link_tool_calls
from .toxicity import toxicity
from .warc import archive_round_trip
from .whitening import whiten


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer file; any other path may be passed to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_read(spark, sf_dir, "documents"))


def op1_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_links(_read(spark, sf_dir, "documents"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_read(spark, sf_dir, "pages"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files_round_trip(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


#: The tool that the query below reads dialogues as calls of.
REPLY_TOOL = {"reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 40}, "turn": {"type": "integer", "minimum": 0}}}}


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues as tool calls: each user turn calls a tool and builds on the call before, each assistant turn is a result.

    Every seventh conversation names the call after instead, which moves its calls.
    """
    turns = _read(spark, sf_dir, "conversations")
    call = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    after = F.when(F.col("conv_id") % 7 == 0, F.array(call(F.col("turn") + 2))).otherwise(F.array(call(F.col("turn") - 2)))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")), {"ignoreNullFields": "false"})
    made = F.to_json(F.struct(F.array(F.struct(call(F.col("turn")).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"), after.alias("after"))).alias("tool_calls")))
    got = F.to_json(F.struct(call(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    role = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    text = F.when(F.col("role") == "user", made).when(F.col("role") == "assistant", got).otherwise(F.col("text"))
    linked = link_tool_calls(turns.select("conv_id", "turn", role.alias("role"), text.alias("text")), REPLY_TOOL)
    return linked.withColumn("violations", F.array_join("violations", "; "))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digests(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector along the 16 largest components, whitened."""
    return whiten(_read(spark, sf_dir, "embeddings"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text; documents stand for repositories, their sources for owners."""
    return find_secrets(_read(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie(_read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op1_ngram_jaccard_links, op2_warc_archive, op3_token_files, op4_tool_call_linking, op5_suffix_dedup, op6_embedding_dedup, op7_quality_rules, op8_toxicity, op9_mix_sources, op10_byte_bpe, op11_embedding_whitening, op12_secret_scan, op13_conversation_trie)}
