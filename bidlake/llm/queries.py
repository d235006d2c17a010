"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.llm import chat, delta_lloyd, fertility, heap_lloyd, langid, license_scan, linededup, minhash, packing, piece_dropout, radix_dedup, recursive_bpe, warc
from bidlake.llm.common import table
from bidlake.session import ship


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"), width=4)


def op6_radix_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.radix_classes(spark, table(spark, sf_dir, "documents"))


def op7_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return fertility.measured(table(spark, sf_dir, "documents"))


def op10_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model, fallback = langid.fit(spark, docs.where(~langid.held_out()))
    out = langid.predict(spark, docs.select("doc_id", "text"), model, fallback)
    return out.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    p = packing.packed(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op8_winnowed_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduplicated(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__deleted").alias("n_deleted"), "text")


def op1_piece_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return piece_dropout.encoded(table(spark, sf_dir, "documents"), seed=1)


def op3_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return chat.read_back(chat.formatted(chat.with_planted(spark, table(spark, sf_dir, "conversations"))))


def op4_warc_splittable(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return license_scan.scanned(table(spark, sf_dir, "documents"))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows, centroids = delta_lloyd.clustered(spark, table(spark, sf_dir, "embeddings"))
    return delta_lloyd.with_inertia(spark, rows, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_recursive_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = recursive_bpe.round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows, books, _ = heap_lloyd.compressed(spark, table(spark, sf_dir, "embeddings"))
    out = heap_lloyd.with_label_error(spark, rows)
    return out.select("vec_id", "code", "error", "label_error", F.lit(heap_lloyd.codebooks_digest(books)).alias("codebooks_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_piece_merge_dropout, op2_hierarchical_packing, op3_chat_round_trip, op4_warc_splittable, op5_minhash_near_dedup, op6_radix_exact_dedup, op7_tokeniser_fertility, op8_winnowed_line_dedup, op9_license_automaton, op10_language_bitmask, op11_delta_lloyd, op12_recursive_bpe, op13_heap_lloyd)
}


ORACLE_SQL = {
    "op6_radix_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM t JOIN g USING (text)
    """,
}


def _pipeline():
    import corpus_pipeline

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


_pipeline()
