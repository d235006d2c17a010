"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the next one's docs. All but the last return the columns of
documents. Null ids and texts pass or go by each operator's own rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.llm import fertility, langid, linededup, minhash, packing
from bidlake.llm.common import Workspace, table
from bidlake.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counts or the tokeniser bands reject go."""
    ship(spark)
    return fertility.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that was learned go; null languages are filled in."""
    ship(spark)
    return langid.keep_known(spark, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go from the texts; n_chars follows."""
    out = linededup.deduplicated(spark, docs).drop("__lines", "__deleted")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays; of rows that share the id that stays, one. Rows without an id stay."""
    ship(spark)
    names = docs.columns
    rows, at = docs.toDF(*[f"c{i}" for i in range(len(names))]), f"c{names.index('doc_id')}"
    dropped = minhash.near_duplicates(spark, docs.select("doc_id", "text")).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    stays = rows.join(dropped, F.col(at) == F.col("gone"), "left_anti")
    # ids are unique but for damaged tables: only rows whose id repeats are shuffled whole
    again = rows.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("again")
    if again.isEmpty():
        return stays.toDF(*names)
    once = stays.join(again, F.col(at) == F.col("again"), "left_semi").dropDuplicates([at])
    return stays.join(again, F.col(at) == F.col("again"), "left_anti").unionByName(once).toDF(*names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, as pieces of documents."""
    ship(spark)
    return packing.packed(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: Trained models, tokenisers and word hashes have no SQL form; the tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
