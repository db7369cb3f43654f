"""Queries of the llm problems and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import canonical, garbled, packing, tokens
from strandwise.session import checkpointed
from strandwise.sources.tables import table


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_values(table(spark, d, "metadata"), table(spark, d, "host_reference"), table(spark, d, "location_reference"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("row_id", "field", "ref_id")


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canonical.unmatched_report(_mapped(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Per language: documents, and those whose decoded ids are their text again."""
    docs = table(spark, d, "documents")
    back = tokens.decode_documents(tokens.encode_documents(docs)).withColumnRenamed("text", "decoded")
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return docs.select("doc_id", "lang", "text").join(back, "doc_id").groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(same).alias("n_same"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(table(spark, d, "documents")), table(spark, d, "pack_capacities"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_report(p8_packed(spark, d), table(spark, d, "pack_capacities"))


def p8_faults(spark: SparkSession, d: str) -> DataFrame:
    """Per profile: documents, and what is wrong with their packing, counted anew from the result."""
    sizes = checkpointed(tokens.count_tokens(table(spark, d, "documents")))
    return packing.pack_faults(packing.pack(sizes, table(spark, d, "pack_capacities")), sizes, table(spark, d, "pack_capacities"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.find_garbled(table(spark, d, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.find_garbled(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p7_ids, p7_round_trip, p8_packed, p8_report, p8_faults, p9_found, p9_restored)}
ORACLE = {
    "p7_round_trip": "SELECT lang, count(*) AS n_docs, count(*) AS n_same FROM documents GROUP BY lang",
    "p8_faults": "SELECT profile, capacity_tokens, (SELECT count(*) FROM documents) AS n_docs, 0::BIGINT AS n_overfull, 0::BIGINT AS n_overlaps, 0::BIGINT AS n_split, 0::BIGINT AS n_wrong FROM pack_capacities",
}
