"""Exact quantiles of groups of any size, none of which lies in one buffer.

1. A mergeable sketch of each measure over all rows gives SPLITS places that cut its values into parts of about equal size.
2. Each group's rows are counted by part, in every task before the shuffle; running sums over a group's parts (at most SPLITS + 1) tell which
   part holds a wanted rank.
3. Only rows of those parts are looked at again, as counts by value, and running sums over them find the rank.

So a task needs the distinct values of a part of the table, and a group of all rows is no harder than many. The sketch
decides only how even the parts are, not the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = 127


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float, str]]) -> DataFrame:
    """The keys (nulls are a group) and a column for each wanted quantile: name -> (value, q, "linear" or "nearest").

    linear is between the two neighbours of rank q * (n - 1), nearest is the value of rank ceil(q * n). Null and NaN values don't count; a group without any has null.
    """
    names = list(wanted)
    measures = F.array(*[F.struct(F.lit(k).alias("m"), v.cast("double").alias("v")) for k, (v, _, _) in enumerate(wanted.values())])
    rows = df.select(F.struct(*keys).alias("key"), F.explode(measures).alias("x")).select("key", "x.m", "x.v").where("v IS NOT NULL AND NOT isnan(v)")
    cuts = [(k + 1) / (SPLITS + 1) for k in range(SPLITS)]
    splits = rows.groupBy("m").agg(F.percentile_approx("v", cuts, 10 * SPLITS).alias("splits"))  # a row for each quantile
    parted = rows.join(F.broadcast(splits), "m").withColumn("part", F.size(F.filter("splits", lambda s: s < F.col("v")))).drop("splits")
    counts = parted.groupBy("key", "m", "part").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("key", "m")
    counts = counts.withColumn("n", F.sum("c").over(group)).withColumn("before", F.sum("c").over(group.orderBy("part")) - F.col("c"))
    asks = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(how == "linear").alias("linear")) for _, q, how in wanted.values()])
    counts = counts.withColumn("ask", F.get(asks, F.col("m")))
    place = F.when(F.col("ask.linear"), F.col("ask.q") * (F.col("n") - 1)).otherwise(F.ceil(F.col("ask.q") * F.col("n")) - 1)
    ranks = counts.withColumn("place", F.greatest(place, F.lit(0.0))).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place"))))).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c")))
    ranks = ranks.select("key", "m", "part", "place", "rank", (F.col("rank") - F.col("before")).alias("local"))
    inside = parted.join(ranks.select("key", "m", "part").distinct(), ["key", "m", "part"], "left_semi").groupBy("key", "m", "part", "v").agg(F.count(F.lit(1)).alias("c"))
    inside = inside.withColumn("upto", F.sum("c").over(Window.partitionBy("key", "m", "part").orderBy("v")))
    hit = inside.join(ranks, ["key", "m", "part"]).where((F.col("local") < F.col("upto")) & (F.col("local") >= F.col("upto") - F.col("c")))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    at = F.first("place") - F.min("rank")
    found = hit.groupBy("key", "m").agg(F.when(at > 0, low * (1 - at) + high * at).otherwise(low).alias("value"))
    wide = found.groupBy("key").agg(*[F.max(F.when(F.col("m") == k, F.col("value"))).alias(n) for k, n in enumerate(names)])
    every = df.select(F.struct(*keys).alias("key")).distinct()
    return every.join(wide, "key", "left").select(*[F.col("key")[k].alias(k) for k in keys], *names)


def with_quantiles(grouped: DataFrame, df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float, str]]) -> DataFrame:
    """Aggregates of the same groups with the quantiles beside them."""
    q = quantiles(df, keys, wanted).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return grouped.join(q, same, "left").drop(*(f"__{k}" for k in keys))
