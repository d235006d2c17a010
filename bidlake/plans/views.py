"""The semantic layer (V1-V18): coverage, agreement and health views.

Buckets add up to totals; a residual column says so. Shares are null where nothing was
measured, or where fewer than a stated number of cases were.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.catalog import register
from bidlake.operators.quantiles import with_quantiles
from bidlake.operators.filters import is_open
from bidlake.sources.procurement import good, product, raw, sql, tender

OPEN_SQL = "status = 'open' AND (close_at IS NULL OR close_at > $now)"
FEW = 10


def n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def percent(part, whole, least: int = 1):
    """100 * part / whole to two places; null below `least` cases."""
    return F.when(whole >= least, F.round(100.0 * part / whole, 2))


def document_state(spark, sf) -> DataFrame:
    """Documents beside their processing state: full outer, so that orphans on either side show."""
    d = raw(spark, sf, "documents").select(F.col("doc_id").alias("a"), "lang", "source", "n_chars")
    t = raw(spark, sf, "labels").select(F.col("doc_id").alias("b"), "quality", "toxic")
    j = d.join(t, d.a == t.b, "full_outer")
    state = F.when(F.col("a").isNull(), "orphan").when(F.col("b").isNull(), "pending").when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 0, "unreadable").otherwise("ok")
    return j.select(F.coalesce("a", "b").alias("doc_id"), "lang", "source", "n_chars", state.alias("state"))


_STATE = """state AS (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, source, n_chars, CASE WHEN d.doc_id IS NULL THEN 'orphan' WHEN l.doc_id IS NULL THEN 'pending' WHEN toxic = 1 THEN 'blocked' WHEN quality = 0 THEN 'unreadable' ELSE 'ok' END AS state
    FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id)"""
STATES = ["ok", "pending", "blocked", "unreadable", "orphan"]


def coverage(df: DataFrame, by: list[str], state: str, states: list[str]) -> DataFrame:
    """A count for each state, the total, and what no state accounts for."""
    g = df.groupBy(*by).agg(n("total"), *[F.count_if(F.col(state) == s).alias(f"n_{s}") for s in states])
    return g.withColumn("not_accounted", F.col("total") - reduce(lambda a, b: a + b, [F.col(f"n_{s}") for s in states]))


@register("V2_document_coverage", f"WITH {_STATE} SELECT coalesce(lang, '?') AS lang, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS n_{s}" for s in STATES) + ", 0::BIGINT AS not_accounted FROM state GROUP BY 1")
def v2(spark, sf):
    return coverage(document_state(spark, sf).withColumn("lang", F.coalesce("lang", F.lit("?"))), ["lang"], "state", STATES)


@register("V2b_orphans", f"WITH {_STATE} SELECT doc_id FROM state WHERE state = 'orphan'")
def v2b(spark, sf):
    return document_state(spark, sf).where("state = 'orphan'").select("doc_id")


@register("V2c_document_coverage_all", f"WITH {_STATE} SELECT coalesce(lang, '?') AS lang, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS n_{s}" for s in STATES) + ", 0::BIGINT AS not_accounted FROM state GROUP BY 1")
def v2c(spark, sf):
    """V2 under the name it had while V2 left documents out."""
    return coverage(document_state(spark, sf).withColumn("lang", F.coalesce("lang", F.lit("?"))), ["lang"], "state", STATES)


@register("V2d_orphans_all", f"WITH {_STATE} SELECT doc_id FROM state WHERE state = 'orphan'")
def v2d(spark, sf):
    return document_state(spark, sf).where("state = 'orphan'").select("doc_id")


@register("V3_evidence_inconsistent", "SELECT count(*) FILTER (WHERE d.doc_id IS NULL) AS label_without_doc, count(*) FILTER (WHERE d.n_chars <> length(d.text)) AS wrong_length, count(*) FILTER (WHERE l.quality = 1 AND l.toxic = 1) AS good_and_toxic FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def v3(spark, sf):
    d = raw(spark, sf, "documents").select("doc_id", "n_chars", F.length("text").alias("len"))
    j = raw(spark, sf, "labels").join(d, "doc_id", "left")
    return j.agg(F.count_if(F.col("n_chars").isNull()).alias("label_without_doc"), F.count_if(F.col("n_chars") != F.col("len")).alias("wrong_length"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("good_and_toxic"))


@register("V4_embedding_coverage", "SELECT label % 3 AS grp, count(*) AS total, count(*) FILTER (WHERE vec_id % 4 = 0) AS stale, count(*) FILTER (WHERE vec_id % 4 <> 0) AS ready, count(DISTINCT md5(CAST(embedding AS VARCHAR))) AS distinct_vectors FROM embeddings GROUP BY 1")
def v4(spark, sf):
    e = raw(spark, sf, "embeddings")
    return e.groupBy((F.col("label") % 3).alias("grp")).agg(n("total"), F.count_if(F.col("vec_id") % 4 == 0).alias("stale"), F.count_if(F.col("vec_id") % 4 != 0).alias("ready"), F.countDistinct(F.xxhash64("embedding")).alias("distinct_vectors"))


@register("V5_etl_health", """SELECT user_id, runs, failed, round(100.0 * (runs - failed) / nullif(runs, 0), 2)::DOUBLE AS useful_pct, CASE WHEN runs < 10 THEN 'no_data' WHEN 100.0 * (runs - failed) / runs >= 95 THEN 'pass' ELSE 'fail' END AS verdict, round(p95, 6) AS p95
    FROM (SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failed, quantile_cont(value, 0.95) FILTER (WHERE event_type <> 'error') AS p95 FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '7 days' GROUP BY user_id)""")
def v5(spark, sf):
    e = raw(spark, sf, "events").where(F.col("ts") > F.lit("2024-01-24 00:00:00").cast("timestamp"))
    g = e.groupBy("user_id").agg(n("runs"), F.count_if(F.col("event_type") == "error").alias("failed"))
    g = with_quantiles(g, e, ["user_id"], {"p95": (F.when(F.col("event_type") != "error", F.col("value")), 0.95, "linear")}).withColumn("p95", F.round("p95", 6))
    pct = 100.0 * (F.col("runs") - F.col("failed")) / F.col("runs")
    return g.select("user_id", "runs", "failed", F.round(pct, 2).alias("useful_pct"), F.when(F.col("runs") < FEW, "no_data").when(pct >= 95, "pass").otherwise("fail").alias("verdict"), "p95")


@register("V5b_stuck_runs", "SELECT user_id, max(ts) AS last_beat FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30 18:00:00'")
def v5b(spark, sf):
    return raw(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_beat")).where(F.col("last_beat") < F.lit("2024-01-30 18:00:00").cast("timestamp"))


@register("V6_open_without_goods", sql("tender good", f"SELECT p.source_platform, coalesce(n, 0) AS n FROM (VALUES ('portal_a'), ('portal_b'), ('portal_c')) p(source_platform) LEFT JOIN (SELECT source_platform, count(*) AS n FROM tender WHERE {OPEN_SQL} AND id NOT IN (SELECT tender_id FROM good) GROUP BY source_platform) x USING (source_platform)"))
def v6(spark, sf):
    g = good(spark, sf)
    bare = tender(spark, sf).where(is_open()).join(g, F.col("id") == g.tender_id, "left_anti").groupBy("source_platform").agg(n())
    frame = spark.createDataFrame([("portal_a",), ("portal_b",), ("portal_c",)], "source_platform string")
    return frame.join(bare, "source_platform", "left").select("source_platform", F.coalesce("n", F.lit(0)).alias("n"))


@register("V6b_ops_health", sql("tender", f"SELECT 'tenders' AS part, count(*) AS n, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END AS state FROM tender UNION ALL SELECT 'open', count(*), CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END FROM tender WHERE {OPEN_SQL} UNION ALL SELECT 'errors', count(*), CASE WHEN count(*) > 100 THEN 'alarm' ELSE 'ok' END FROM events WHERE event_type = 'error'"))
def v6b(spark, sf):
    line = lambda part, df, state: df.agg(n()).select(F.lit(part).alias("part"), "n", state.alias("state"))
    filled = F.when(F.col("n") == 0, "empty").otherwise("ok")
    t = tender(spark, sf)
    return line("tenders", t, filled).unionByName(line("open", t.where(is_open()), filled)).unionByName(line("errors", raw(spark, sf, "events").where("event_type = 'error'"), F.when(F.col("n") > 100, "alarm").otherwise("ok")))


def reviews(spark, sf) -> DataFrame:
    """Machine verdicts (by a length rule) beside people's (the labels)."""
    d = raw(spark, sf, "documents").select("doc_id", "source", F.when(F.col("n_chars") % 3 == 0, "bad").when(F.col("n_chars") % 3 == 1, "good").otherwise("unsure").alias("machine"), (F.col("n_chars") % 100 / 100.0).alias("confidence"))
    p = raw(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "bad").when(F.col("quality") == 1, "good").otherwise("unsure").alias("person"))
    return d.join(p, "doc_id", "left")


_REVIEWS = """reviews AS (SELECT d.doc_id, source, CASE n_chars % 3 WHEN 0 THEN 'bad' WHEN 1 THEN 'good' ELSE 'unsure' END AS machine, (n_chars % 100)::DOUBLE / 100.0 AS confidence, CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'bad' WHEN quality = 1 THEN 'good' ELSE 'unsure' END AS person FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@register("V7_review_coverage", f"WITH {_REVIEWS} SELECT machine, count(*) AS total, count(person) AS reviewed, count(*) - count(person) AS waiting, CASE WHEN count(*) >= 10 THEN round(100.0 * count(person) / count(*), 2)::DOUBLE END AS pct FROM reviews GROUP BY machine")
def v7(spark, sf):
    return reviews(spark, sf).groupBy("machine").agg(n("total"), F.count("person").alias("reviewed")).select("machine", "total", "reviewed", (F.col("total") - F.col("reviewed")).alias("waiting"), percent(F.col("reviewed"), F.col("total"), FEW).alias("pct"))


@register("V8_disagreement_bands", f"WITH {_REVIEWS} SELECT CASE WHEN confidence < 0.4 THEN 'low' WHEN confidence < 0.75 THEN 'middle' ELSE 'high' END AS band, count(person) AS n, count(*) FILTER (WHERE person IS NOT NULL AND person <> machine) AS differ, CASE WHEN count(person) >= 10 THEN round(100.0 * count(*) FILTER (WHERE person IS NOT NULL AND person <> machine) / count(person), 2)::DOUBLE END AS pct FROM reviews GROUP BY 1")
def v8(spark, sf):
    band = F.when(F.col("confidence") < 0.4, "low").when(F.col("confidence") < 0.75, "middle").otherwise("high")
    g = reviews(spark, sf).groupBy(band.alias("band")).agg(F.count("person").alias("n"), F.count_if(F.col("person") != F.col("machine")).alias("differ"))
    return g.withColumn("pct", percent(F.col("differ"), F.col("n"), FEW))


@register("V9_pilot_state", f"WITH {_REVIEWS} SELECT source, CASE WHEN count(person) = count(*) THEN 'done' WHEN count(person) = 0 THEN 'new' ELSE 'running' END AS state, count(*) AS size, count(person) AS done FROM reviews GROUP BY source")
def v9(spark, sf):
    g = reviews(spark, sf).groupBy("source").agg(n("size"), F.count("person").alias("done"))
    return g.select("source", F.when(F.col("done") == F.col("size"), "done").when(F.col("done") == 0, "new").otherwise("running").alias("state"), "size", "done")


GATES = [("reviewed", 40), ("toxic_seen", 10), ("purchases", 200)]


@register("V10_quality_gates", """WITH seen AS (SELECT 'reviewed' AS gate, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good FROM labels UNION ALL SELECT 'toxic_seen', count(*), count(*) FILTER (WHERE quality = 0) FROM labels WHERE toxic = 1 UNION ALL SELECT 'purchases', count(*), count(*) FILTER (WHERE value > 5) FROM events WHERE event_type = 'purchase')
    SELECT g.gate, g.least, n, CASE WHEN n >= g.least THEN round(100.0 * good / n, 2)::DOUBLE END AS pct, n >= g.least AS reached FROM (VALUES ('reviewed', 40), ('toxic_seen', 10), ('purchases', 200)) g(gate, least) JOIN seen USING (gate)""")
def v10(spark, sf):
    lab, e = raw(spark, sf, "labels"), raw(spark, sf, "events")
    part = lambda gate, df, ok: df.agg(n(), F.count_if(ok).alias("good")).select(F.lit(gate).alias("gate"), "n", "good")
    seen = part("reviewed", lab, F.col("quality") == 1).unionByName(part("toxic_seen", lab.where("toxic = 1"), F.col("quality") == 0)).unionByName(part("purchases", e.where("event_type = 'purchase'"), F.col("value") > 5))
    gates = spark.createDataFrame(GATES, "gate string, least int")
    return gates.join(seen, "gate").select("gate", "least", "n", F.when(F.col("n") >= F.col("least"), F.round(100.0 * F.col("good") / F.col("n"), 2)).alias("pct"), (F.col("n") >= F.col("least")).alias("reached"))


@register("V11_confusion_matrix", f"WITH {_REVIEWS} SELECT m.v AS machine, p.v AS person, count(r.doc_id) AS n FROM (VALUES ('bad'), ('good'), ('unsure')) m(v) CROSS JOIN (VALUES ('bad'), ('good'), ('unsure')) p(v) LEFT JOIN reviews r ON r.machine = m.v AND r.person = p.v GROUP BY ALL")
def v11(spark, sf):
    kinds = [(k,) for k in ("bad", "good", "unsure")]
    frame = spark.createDataFrame(kinds, "machine string").crossJoin(spark.createDataFrame(kinds, "person string"))
    got = reviews(spark, sf).where("person IS NOT NULL").groupBy("machine", "person").agg(n())
    return frame.join(got, ["machine", "person"], "left").select("machine", "person", F.coalesce("n", F.lit(0)).alias("n"))


@register("V11b_agreement", f"WITH {_REVIEWS} SELECT source, n, same, CASE WHEN n >= 10 THEN round(100.0 * same / n, 2)::DOUBLE END AS pct FROM (SELECT source, count(*) AS n, count(*) FILTER (WHERE machine = person) AS same FROM reviews WHERE person IS NOT NULL AND machine <> 'unsure' AND person <> 'unsure' GROUP BY source)")
def v11b(spark, sf):
    decided = reviews(spark, sf).where("person <> 'unsure' AND machine <> 'unsure'")
    return decided.groupBy("source").agg(n(), F.count_if(F.col("machine") == F.col("person")).alias("same")).withColumn("pct", percent(F.col("same"), F.col("n"), FEW))


@register("V12_code_coverage", sql("product", "SELECT company_id, count(*) AS total, count(code) AS coded, count(*) FILTER (WHERE code IS NULL AND stock_qty IS NULL) AS uncoded_no_stock, count(*) FILTER (WHERE code IS NULL AND stock_qty IS NOT NULL) AS uncoded, 0::BIGINT AS not_accounted, round(100.0 * count(code) / count(*), 2)::DOUBLE AS pct FROM product GROUP BY company_id"))
def v12(spark, sf):
    kind = F.when(F.col("code").isNotNull(), "coded").when(F.col("stock_qty").isNull(), "uncoded_no_stock").otherwise("uncoded")
    c = coverage(product(spark, sf).withColumn("kind", kind), ["company_id"], "kind", ["coded", "uncoded_no_stock", "uncoded"])
    return c.select("company_id", "total", F.col("n_coded").alias("coded"), F.col("n_uncoded_no_stock").alias("uncoded_no_stock"), F.col("n_uncoded").alias("uncoded"), "not_accounted", percent(F.col("n_coded"), F.col("total")).alias("pct"))


@register("V12b_uncoded_queue", sql("product good", "SELECT p.name, count(DISTINCT p.product_id) AS products, coalesce(max(g.n), 0) AS lots FROM product p LEFT JOIN (SELECT name, count(*) AS n FROM good GROUP BY name) g ON g.name = p.name WHERE p.code IS NULL GROUP BY p.name ORDER BY lots DESC, p.name LIMIT 25"))
def v12b(spark, sf):
    open_names = product(spark, sf).where("code IS NULL").groupBy("name").agg(n("products"))
    lots = good(spark, sf).groupBy("name").agg(n("lots"))
    return open_names.join(lots, "name", "left").select("name", "products", F.coalesce("lots", F.lit(0)).alias("lots")).orderBy(F.desc("lots"), "name").limit(25)


@register("V13_decision_measure", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.5), 6) AS median, CASE WHEN count(DISTINCT user_id) >= 50 THEN round(avg(value), 4) END AS mean FROM events GROUP BY event_type")
def v13(spark, sf):
    e = raw(spark, sf, "events")
    g = e.groupBy("event_type").agg(n(), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("m"))
    g = with_quantiles(g, e, ["event_type"], {"median": (F.col("value"), 0.5, "linear")}).withColumn("median", F.round("median", 6))
    return g.select("event_type", "n", "users", "median", F.when(F.col("users") >= 50, F.col("m")).alias("mean"))


@register("V14_stale_models", "SELECT label, count(*) AS n, max(vec_id) AS newest, count(*) FILTER (WHERE label IS DISTINCT FROM CASE WHEN vec_id % 6 = 0 THEN NULL ELSE label END) AS stale FROM embeddings GROUP BY label")
def v14(spark, sf):
    seen = F.when(F.col("vec_id") % 6 != 0, F.col("label"))
    return raw(spark, sf, "embeddings").groupBy("label").agg(n(), F.max("vec_id").alias("newest"), F.count_if(~F.col("label").eqNullSafe(seen)).alias("stale"))


@register("V15_profile_completeness", sql("product", "SELECT company_id, max(CASE WHEN code IS NOT NULL THEN 1 ELSE 0 END) + max(CASE WHEN stock_qty IS NOT NULL THEN 1 ELSE 0 END) + max(CASE WHEN len(keywords) > 1 THEN 1 ELSE 0 END) + max(CASE WHEN price > 100000 THEN 1 ELSE 0 END) AS filled, 4 AS of_parts FROM product GROUP BY company_id"))
def v15(spark, sf):
    has = lambda c: F.max(c.cast("int"))
    filled = has(F.col("code").isNotNull()) + has(F.col("stock_qty").isNotNull()) + has(F.size("keywords") > 1) + has(F.col("price") > 100000)
    return product(spark, sf).groupBy("company_id").agg(filled.alias("filled")).withColumn("of_parts", F.lit(4))


@register("V16_source_coverage", "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n, count(*) FILTER (WHERE url LIKE 'https:%') AS secure, max(length(html)) AS longest FROM pages GROUP BY 1")
def v16(spark, sf):
    return raw(spark, sf, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(n(), F.count_if(F.col("url").startswith("https:")).alias("secure"), F.max(F.length("html")).cast("long").alias("longest"))


@register("V17_attribution_quality", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE user_id IS NULL) AS unattributed, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS no_detail, count(*) FILTER (WHERE user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL) AS complete FROM events GROUP BY event_type")
def v17(spark, sf):
    k = F.get_json_object("props", "$.k")
    return raw(spark, sf, "events").groupBy("event_type").agg(n(), F.count_if(F.col("user_id").isNull()).alias("unattributed"), F.count_if(k.isNull()).alias("no_detail"), F.count_if(F.col("user_id").isNotNull() & k.isNotNull()).alias("complete"))


@register("V18_chat_recovery", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS chats, round(quantile_cont(length(text), 0.5), 2)::DOUBLE AS median_chars, CASE WHEN count(*) >= 10 THEN round(100.0 * count(*) FILTER (WHERE turn > 1) / count(*), 2)::DOUBLE END AS later_pct FROM conversations GROUP BY role")
def v18(spark, sf):
    c = raw(spark, sf, "conversations")
    g = c.groupBy("role").agg(n(), F.countDistinct("conv_id").alias("chats"), F.count_if(F.col("turn") > 1).alias("later"))
    g = with_quantiles(g, c, ["role"], {"median_chars": (F.length("text"), 0.5, "linear")}).withColumn("median_chars", F.round("median_chars", 2))
    return g.select("role", "n", "chats", "median_chars", percent(F.col("later"), F.col("n"), FEW).alias("later_pct"))
