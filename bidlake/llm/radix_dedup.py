"""Exact dedup by distributed MSD radix partitioning.

A document's key is its length in bytes (the leading digit, so that all members of a
group end together) and then its bytes, read in digits that widen as groups thin out.
Each level counts the members of every (group, digit) pair; pairs of one member leave,
groups whose bytes are used up are classes of equal texts, the others go on. Bytes are
compared as they are: no digest decides equality.

Counting is a groupBy with map-side partial aggregation, so a class that holds a third
of all rows reaches the shuffle as a row for each task. A level reads one digit of the
documents that are still in a group, not their whole texts, so over all levels each byte
is shuffled about once. The joins are sort-merge joins at every size: what is still in a
group grows with the input, so it is never broadcast.

Defined cases. Null text counts as empty. Empty texts are equal to each other. Rows that
share doc_id and text are members of one class, each with its own output row; with a null
doc_id a row can stay only if no member has one. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.llm.common import Workspace

FIRST_DIGIT, WIDEN = 16, 16


def radix_classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST_DIGIT, widen: int = WIDEN) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256."""
    ws = Workspace(spark, "radix")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    # spot tells rows of one id apart that differ in text; it never decides equality
    rows = docs.select(F.col(id_col).alias("id"), body.alias("b")).select("id", "b", F.octet_length("b").cast("long").alias("n"), F.xxhash64("b").alias("spot"))
    done: list[DataFrame] = []
    live, start, width, level = None, 0, first, 0
    while True:
        digit = F.substring("b", start + 1, width)
        if live is None:
            members = rows.select("id", "spot", "n", F.lit(None).cast("long").alias("grp"), digit.alias("digit"))
            on = ["n", "digit"]
        else:
            left = rows.where(F.col("n") > start).select("id", "spot", "n", digit.alias("digit"))
            right = live.select(F.col("id").alias("id_"), F.col("spot").alias("spot_"), "grp")
            members = ws.cut(left.join(right.hint("merge"), F.col("id").eqNullSafe(F.col("id_")) & (F.col("spot") == F.col("spot_"))).drop("id_", "spot_"), f"members{level}")
            on = ["grp", "digit"]
        # a group's number: the smallest spot of its members is no key of equality, only a name within (n, path)
        groups = members.groupBy(*on).agg(F.count(F.lit(1)).alias("size"), F.max("id").alias("keep"), *([] if "n" in on else [F.first("n").alias("n")])).where("size > 1")
        groups = ws.cut(groups.withColumn("name", F.monotonically_increasing_id()), f"groups{level}")
        named = groups.select(*(F.col(c).alias(c + "_") for c in on), "name", "keep", "size")
        state = ws.cut(members.join(named.hint("merge"), [members[c] == named[c + "_"] for c in on]).select("id", "spot", "n", F.col("name").alias("grp"), "keep", "size").distinct(), f"state{level}")
        ws.drop(f"members{level}", f"groups{level}")
        start, width, level = start + width, width * widen, level + 1
        done.append(state.where(F.col("n") <= start).select("id", "spot", "keep", "size"))
        live = state.where(F.col("n") > start)
        if live.isEmpty():
            break
    classes = reduce(DataFrame.unionByName, done).withColumnsRenamed({"id": "id_", "spot": "spot_"})
    out = rows.select("id", "spot", F.sha2("b", 256).alias("text_sha256")).join(classes.hint("merge"), F.col("id").eqNullSafe(F.col("id_")) & (F.col("spot") == F.col("spot_")), "left")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256")
