"""Streaming and incremental operators (R1-R10) over the events table.

Each takes a DataFrame that may be a stream; a batch gives the same rows as the finished stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidlake.catalog import register
from bidlake.functions.scalars import fingerprint, same_value
from bidlake.sources.procurement import raw

LATE = "10 minutes"


def event_stream(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is that of the files there now."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def _late(df: DataFrame, column: str = "ts", by: str = LATE) -> DataFrame:
    df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df.withWatermark(column, by) if df.isStreaming else df


def tumbling(df: DataFrame, width: str = "1 hour") -> DataFrame:
    g = _late(df).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("v"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", F.col("v").cast("double").alias("v"))


def sliding(df: DataFrame, width: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    g = _late(df).groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
    return g.select(F.col("w.start").alias("start"), "n", "most")


def sessions(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with no gap: a run's end is its last event plus the gap."""
    g = _late(df).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(df: DataFrame, key: list[str]) -> DataFrame:
    """The first of each key; a stream forgets keys when the watermark has passed."""
    return _late(df).dropDuplicatesWithinWatermark(key) if df.isStreaming else df.dropDuplicates(key)


def changed_only(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """New rows whose fields differ from the old ones; numbers compare as numbers."""
    o = old.select(F.col(key).alias("__k"), *[F.col(f).cast("string").alias(f"__{f}") for f in fields])
    j = new.join(o, F.col(key) == F.col("__k"), "left")
    same = F.lit(True)
    for f in fields:
        same = same & same_value(F.col(f).cast("string"), F.col(f"__{f}"))
    return j.where(F.col("__k").isNull() | ~same).select(*new.columns)


def next_attempt(attempts, last, error):
    """Minutes of 2^n after a passing error, none after a lasting one or the fourth try."""
    return F.when(~error.isin("gone", "forbidden") & (attempts < 4), last + F.make_dt_interval(mins=F.pow(F.lit(2), attempts).cast("int")))


def run_available(df: DataFrame, table: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and return its rows; the checkpoint lets the next run go on from there."""
    q = df.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(table)


BUCKETS = 64


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that upsert_batches keeps: each bucket's newest version."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/version=*")
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi").drop("bucket", "version")  # at most BUCKETS rows


def _drop_superseded(spark: SparkSession, path: str) -> None:
    """Remove the versions of each bucket before its last two: the one before the newest may still be read."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    seen: dict[str, int] = {}
    versions = sorted((int(x.getPath().getName().split("=")[1]), x.getPath()) for x in files.listStatus(place) if x.getPath().getName().startswith("version=")) if files.exists(place) else []
    for _, version in reversed(versions):
        for x in files.listStatus(version):
            name = x.getPath().getName()
            if name.startswith("bucket="):
                seen[name] = seen.get(name, 0) + 1
                if seen[name] > 2:
                    files.delete(x.getPath(), True)


def upsert_batches(df: DataFrame, path: str, key: list[str], checkpoint: str, buckets: int = BUCKETS):
    """Each micro-batch is merged into a Parquet table by key: the buckets its keys fall in are written anew as a version of their own.

    A batch that is run again writes the same version again. Rows of other buckets are not touched;
    current() reads the table.
    """
    from bidlake.sources.ingest import upserted

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets`
        rows = new
        if number:
            old = spark.read.option("basePath", path).parquet(f"{path}/version=*").where((F.col("version") < number) & F.col("bucket").isin(touched))
            newest = old.groupBy("bucket").agg(F.max("version").alias("version"))
            rows = upserted(old.join(F.broadcast(newest), ["bucket", "version"], "left_semi").select(*new.columns), new, key)
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")
        new.unpersist()
        _drop_superseded(spark, path)

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@register("R1_tumbling_window", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS v FROM events GROUP BY ALL")
def r1(spark, sf):
    return tumbling(raw(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("R2_work_list_hash", "SELECT user_id, count(*) AS total, sha256(string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY CAST(event_id AS VARCHAR))) AS key FROM events GROUP BY user_id")
def r2(spark, sf):
    """A checkpoint's key: it is valid only for the same list of work."""
    return raw(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), fingerprint(F.collect_set(F.col("event_id").cast("string"))).alias("key"))


@register("R3_changed_rows", "SELECT event_id, value FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value + 1 ELSE value END AS value FROM events WHERE event_id % 3 <> 0) n WHERE event_id % 4 = 0 OR event_id % 5 = 0")
def r3(spark, sf):
    e = raw(spark, sf, "events").select("event_id", "value")
    new = e.where("event_id % 3 <> 0").withColumn("value", F.when(F.col("event_id") % 4 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return changed_only(e.where("event_id % 5 <> 0"), new, "event_id", ["value"])


@register("R4_retry_schedule", "SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 6 < 4 THEN ts + to_minutes(CAST(pow(2, event_id % 6) AS INTEGER)) END AS next_at FROM events WHERE event_type = 'error'")
def r4(spark, sf):
    k = F.col("event_id")
    error = F.when(k % 7 == 0, "gone").otherwise("timeout")
    return raw(spark, sf, "events").where("event_type = 'error'").select("event_id", next_attempt((k % 6).cast("int"), F.col("ts"), error).alias("next_at"))


#: What a run reports: all done, stopped with work left, or stopped by its circuit breaker.
DONE, PARTIAL, BUSY = 0, 7, 8


def budgeted(work: DataFrame, group: list[str], order: list[str], cost: str, failed: Column, budget: float, most_failures: int) -> DataFrame:
    """What a run within a budget does of each group's work list, in order: n_done, n_left, code.

    An item begins while the cost of those before it is below the budget, unless `most_failures` in a
    row have failed by then.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    recent = F.sum(failed.cast("int")).over(w.rowsBetween(-most_failures + 1, 0)) == most_failures
    x = work.withColumn("spent", F.coalesce(F.sum(cost).over(before), F.lit(0))).withColumn("broken", recent.cast("int"))
    x = x.withColumn("stopped", F.coalesce(F.max("broken").over(before), F.lit(0)) == 1).withColumn("out", F.col("spent") >= budget)
    g = x.groupBy(*group).agg(F.count_if(~F.col("stopped") & ~F.col("out")).alias("n_done"), F.count_if(F.col("stopped") | F.col("out")).alias("n_left"), F.bool_or(F.col("stopped") & ~F.col("out")).alias("tripped"))
    return g.select(*group, "n_done", "n_left", F.when(F.col("tripped"), BUSY).when(F.col("n_left") > 0, PARTIAL).otherwise(DONE).alias("code"))


@register("R5_budgeted_run", """WITH x AS (SELECT *, coalesce(sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS broken FROM events),
    y AS (SELECT *, coalesce(max(broken::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped, spent >= 5000 AS out FROM x)
    SELECT user_id, count(*) FILTER (WHERE NOT stopped AND NOT out) AS n_done, count(*) FILTER (WHERE stopped OR out) AS n_left, CASE WHEN bool_or(stopped AND NOT out) THEN 8 WHEN count(*) FILTER (WHERE stopped OR out) > 0 THEN 7 ELSE 0 END AS code FROM y GROUP BY user_id""")
def r5(spark, sf):
    e = raw(spark, sf, "events").withColumn("cost", F.col("value").cast("decimal(18,4)"))
    return budgeted(e, ["user_id"], ["ts", "event_id"], "cost", F.col("event_type") == "error", 5000, 3)


def change_feed(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """What subscribers are told: key, op (insert, update, delete) and the names of the fields that moved."""
    o = old.select(F.col(key).alias("ok"), *[F.col(f).alias(f"o_{f}") for f in fields])
    j = o.join(new.select(F.col(key).alias("nk"), *[F.col(f).alias(f"n_{f}") for f in fields]), F.col("ok") == F.col("nk"), "full_outer")
    moved = F.array_compact(F.array(*[F.when(~F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}")), f) for f in fields]))
    op = F.when(F.col("ok").isNull(), "insert").when(F.col("nk").isNull(), "delete").when(F.size(moved) > 0, "update")
    return j.select(F.coalesce("ok", "nk").alias(key), op.alias("op"), F.when(op == "update", F.array_join(moved, ",")).otherwise("").alias("fields")).where("op IS NOT NULL")


@register("R9_change_feed", "SELECT coalesce(o.event_id, n.event_id) AS event_id, CASE WHEN o.event_id IS NULL THEN 'insert' WHEN n.event_id IS NULL THEN 'delete' ELSE 'update' END AS op, CASE WHEN o.event_id IS NULL OR n.event_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.event_type IS DISTINCT FROM n.event_type THEN 'event_type' END, CASE WHEN o.value IS DISTINCT FROM n.value THEN 'value' END) END AS fields FROM (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00') o FULL OUTER JOIN (SELECT event_id, CASE event_type WHEN 'signup' THEN 'view' ELSE event_type END AS event_type, CASE WHEN value > 100 THEN 100 ELSE value END AS value FROM events WHERE event_type <> 'error') n ON o.event_id = n.event_id WHERE o.event_id IS NULL OR n.event_id IS NULL OR o.event_type IS DISTINCT FROM n.event_type OR o.value IS DISTINCT FROM n.value")
def r9(spark, sf):
    """A state of the table against a later one in which values are capped, a type is renamed and errors are gone."""
    e = raw(spark, sf, "events").select("event_id", "event_type", "value", "ts")
    new = e.where("event_type <> 'error'").select("event_id", F.when(F.col("event_type") == "signup", "view").otherwise(F.col("event_type")).alias("event_type"), F.least("value", F.lit(100.0)).alias("value"))
    return change_feed(e.where(F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")), new, "event_id", ["event_type", "value"])


@register("R6_sessions", """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s""")
def r6(spark, sf):
    return sessions(raw(spark, sf, "events")).select("user_id", F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"), "n")


@register("R8_deduplicated", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def r8(spark, sf):
    return once(raw(spark, sf, "events"), ["user_id", "event_type"]).agg(F.count(F.lit(1)).alias("n"))


@register("R10_rolling_latency", "SELECT start, count(*) AS n, max(value) AS most FROM (SELECT value, time_bucket(INTERVAL '1 minute', ts) - to_minutes(i) AS start FROM events, (SELECT unnest([0, 1, 2, 3, 4])::INTEGER AS i)) GROUP BY start")
def r10(spark, sf):
    return sliding(raw(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("R11_as_of_join", "SELECT e.event_id, p.value AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'error'")
def r11(spark, sf):
    """The last purchase at or before each error: one window over both sides together, no pairs."""
    w = Window.partitionBy("user_id").orderBy("ts", (F.col("event_type") == "error").cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    e = raw(spark, sf, "events").where(F.col("event_type").isin("error", "purchase"))
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w)
    return e.select("event_id", "event_type", last.alias("last_purchase")).where("event_type = 'error'").select("event_id", "last_purchase")
