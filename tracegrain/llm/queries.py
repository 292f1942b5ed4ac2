"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tracegrain.llm import binpack, divergence, lines, neighbours, ngram_join, pieces, quality, sharding, sketches, statements, substrings, token_rows, toxicity, turns
from tracegrain.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401


@query("op1_quality_rules", statements.QUALITY)
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).drop("host")


@query("op7_flow_resharding")
def op7_flow_resharding(spark: SparkSession, folder: str) -> DataFrame:
    """Documents lie in eight shards by their source (so one shard holds over a third) and move to eight of near equal bytes."""
    docs = table(spark, folder, "documents")
    old = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(8))
    plan = sharding.reshard(docs, old, 8, 8)
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


@query("op10_vantage_point_search", statements.NEAREST)
def op10_vantage_point_search(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10, relax=1.0)


@query("op2_substring_dedup", statements.SUBSTRINGS)
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digest(table(spark, folder, "documents"))


@query("op3_conflict_packing")
def op3_conflict_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Bins of 2,048 words; near duplicates (five-word shingles, similarity 0.8) are a cluster, equal texts among them."""
    docs = table(spark, folder, "documents")
    return binpack.pack(docs, F.xxhash64("text"), merged=ngram_join.near_clusters(docs))


@query("op5_piece_scan")
def op5_piece_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    encoded = pieces.encode(docs)
    return encoded.select("doc_id", "n_chunks", F.size("ids").alias("n_ids"), "ids", F.crc32(pieces.decode_column(F.col("ids")).cast("binary")).alias("decoded_crc32"))


@query("op6_ngram_join", statements.NGRAM_JOIN)
def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.component_table(table(spark, folder, "documents"))


@query("op9_token_rows")
def op9_token_rows(spark: SparkSession, folder: str) -> DataFrame:
    return token_rows.pack(table(spark, folder, "documents"))


@query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.digest(table(spark, folder, "documents"), least_words=1)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted on a sample of the labelled documents; every document is scored."""
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op11_divergence_audit", statements.DIVERGENCE)
def op11_divergence_audit(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


@query("op12_turn_repair", statements.TURNS)
def op12_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return turns.audit(turns.damage(conversations), conversations)


@query("op13_fast_sketches", statements.SKETCHED)
def op13_fast_sketches(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.near_duplicates(table(spark, folder, "documents"))
