"""Aggregations (A1-A29). Sums are of decimals and leave as doubles; ratios are null where nothing was measured."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bidlake.catalog import register
from bidlake.operators.quantiles import quantiles, with_quantiles
from bidlake.operators.filters import is_open
from bidlake.plans.rewrites import ancestors, code_levels, code_prefix_join, prefix_join
from bidlake.sources.procurement import area, good, now, product, raw, sql, tender


def _n(name="n"):
    return F.count(F.lit(1)).alias(name)


def money(c):
    return F.sum(c).cast("double")


def share(part, whole):
    """part / whole, null where whole is 0."""
    return F.when(whole != 0, part / whole)


OPEN_SQL = "status = 'open' AND (close_at IS NULL OR close_at > $now)"


@register("A1_area_status_currency", sql("tender", "SELECT area_path, status, currency, count(*) AS n, CAST(sum(totalcost) AS DOUBLE) AS total FROM tender GROUP BY ALL"))
def a1(spark, sf):
    return tender(spark, sf).groupBy("area_path", "status", "currency").agg(_n(), money("totalcost").alias("total"))


@register("A2_top_categories", sql("good", "SELECT category, count(DISTINCT tender_id) AS n_tenders, CAST(sum(totalcost_item) AS DOUBLE) AS spend FROM good GROUP BY category ORDER BY spend DESC NULLS LAST"))
def a2(spark, sf):
    return good(spark, sf).groupBy("category").agg(F.countDistinct("tender_id").alias("n_tenders"), money("totalcost_item").alias("spend")).orderBy(F.desc_nulls_last("spend"))


@register("A3_currency_totals", sql("tender", f"SELECT currency, count(*) AS n, CAST(coalesce(sum(totalcost), 0) AS DOUBLE) AS total FROM tender WHERE {OPEN_SQL} GROUP BY currency"))
def a3(spark, sf):
    return tender(spark, sf).where(is_open()).groupBy("currency").agg(_n(), F.coalesce(money("totalcost"), F.lit(0.0)).alias("total"))


@register("A4_province_rollup", sql("tender area", f"""SELECT a.area_id, a.name, coalesce(sum(x.n), 0)::BIGINT AS n, coalesce(string_agg(x.currency || ':' || x.total, ';' ORDER BY x.currency), '') AS totals
    FROM area a LEFT JOIN (SELECT array_to_string(string_split(area_path, '.')[1:2], '.') AS p, currency, count(*) AS n, CAST(coalesce(sum(totalcost), 0) AS BIGINT) AS total FROM tender WHERE {OPEN_SQL} GROUP BY ALL) x ON x.p = a.area_id WHERE a.level = 1 GROUP BY a.area_id, a.name"""))
def a4(spark, sf):
    p = area(spark, sf).where("level = 1").select("area_id", "name")
    hits = prefix_join(tender(spark, sf).where(is_open()).select("id", "area_path", "currency", "totalcost"), "area_path", F.broadcast(p.select("area_id")), "area_id")
    by = hits.groupBy("area_id", "currency").agg(_n(), F.round(F.coalesce(F.sum("totalcost"), F.lit(0))).cast("long").alias("total"))
    rolled = by.groupBy("area_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("currency", "total"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["currency"], x["total"].cast("string"))), ";")
    return p.join(rolled, "area_id", "left").select("area_id", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(text, F.lit("")).alias("totals"))


@register("A5_locality_rollup", sql("tender", "SELECT CASE WHEN len(string_split(area_path, '.')) = 3 AND buyer_id % 2 = 0 THEN area_path END AS locality, currency, count(*) AS n FROM tender GROUP BY ALL"))
def a5(spark, sf):
    level = F.size(F.split("area_path", r"\."))
    return tender(spark, sf).groupBy(F.when((level == 3) & (F.col("buyer_id") % 2 == 0), F.col("area_path")).alias("locality"), "currency").agg(_n())


@register("A6_product_facet", sql("good", "SELECT name, count(DISTINCT tender_id) AS n FROM good GROUP BY name ORDER BY n DESC, name LIMIT 20"))
def a6(spark, sf):
    return good(spark, sf).groupBy("name").agg(F.countDistinct("tender_id").alias("n")).orderBy(F.desc("n"), "name").limit(20)


@register("A7_category_tree", sql("good product", """SELECT c.code, count(DISTINCT g.tender_id) AS n FROM (SELECT DISTINCT substr(code, 1, 2) AS code FROM product WHERE code IS NOT NULL UNION SELECT DISTINCT substr(code, 1, 5) FROM product WHERE code IS NOT NULL) c
    LEFT JOIN good g ON g.good_code = c.code OR g.good_code LIKE c.code || '.%' GROUP BY c.code"""))
def a7(spark, sf):
    codes = product(spark, sf).where("code IS NOT NULL").select(F.explode(code_levels(F.col("code"), (2, 5))).alias("code")).distinct()
    n = good(spark, sf).select("tender_id", F.explode(ancestors(F.col("good_code"))).alias("code")).groupBy("code").agg(F.countDistinct("tender_id").alias("n"))
    return codes.join(n, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


@register("A8_conditional_counts", "SELECT count(*) AS n, count(*) FILTER (WHERE n_chars > 1000) AS long_docs, count(*) FILTER (WHERE lang = 'en') AS english, count(DISTINCT source) FILTER (WHERE lang = 'fr') AS fr_sources FROM documents")
def a8(spark, sf):
    return raw(spark, sf, "documents").agg(_n(), F.count_if(F.col("n_chars") > 1000).alias("long_docs"), F.count_if(F.col("lang") == "en").alias("english"), F.countDistinct(F.when(F.col("lang") == "fr", F.col("source"))).alias("fr_sources"))


@register("A9_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.5) FILTER (WHERE user_id < 50), 6) AS p50_small FROM events GROUP BY event_type")
def a9(spark, sf):
    v = F.col("value")
    q = quantiles(raw(spark, sf, "events"), ["event_type"], {"p50": (v, 0.5, "linear"), "p95": (v, 0.95, "linear"), "p50_small": (F.when(F.col("user_id") < 50, v), 0.5, "linear")})
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p50_small")])


@register("A10_latency_nearest_rank", """SELECT w, event_type, n, p50, p95 FROM (SELECT time_bucket(INTERVAL '5 minutes', ts) AS w, event_type, count(*) AS n, list_sort(list(value))[CAST(ceil(0.5 * count(*)) AS INTEGER)] AS p50, list_sort(list(value))[CAST(ceil(0.95 * count(*)) AS INTEGER)] AS p95 FROM events GROUP BY ALL)""")
def a10(spark, sf):
    e = raw(spark, sf, "events").withColumn("w", F.window("ts", "5 minutes")["start"])
    key, v = ["w", "event_type"], F.col("value")
    return with_quantiles(e.groupBy(*key).agg(_n()), e, key, {"p50": (v, 0.5, "nearest"), "p95": (v, 0.95, "nearest")}).select(*key, "n", "p50", "p95")


@register("A11_string_agg_distinct", sql("good", "SELECT tender_id, string_agg(DISTINCT name, ' | ' ORDER BY name) AS names FROM good GROUP BY tender_id"))
def a11(spark, sf):
    return good(spark, sf).groupBy("tender_id").agg(F.array_join(F.array_sort(F.collect_set("name")), " | ").alias("names"))


@register("A12_array_slice", sql("good", "SELECT good_code, array_to_string(list_sort(list(DISTINCT name))[1:3], ',') AS names, array_to_string(list_sort(list(tender_id))[1:8], ',') AS first_tenders FROM good GROUP BY good_code"))
def a12(spark, sf):
    # the smallest eight are kept while aggregating a partition's rows, not after collecting them all
    w = Window.partitionBy("good_code").orderBy("tender_id")
    ids = good(spark, sf).select("good_code", "tender_id", F.row_number().over(w).alias("k")).where("k <= 8").groupBy("good_code").agg(F.array_join(F.array_sort(F.collect_list("tender_id")).cast("array<string>"), ",").alias("first_tenders"))
    names = good(spark, sf).groupBy("good_code").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 3), ",").alias("names"))
    return names.join(ids, "good_code").select("good_code", "names", "first_tenders")


@register("A13_json_agg", sql("good", """SELECT tender_id, '[' || string_agg('{"no":' || good_no || ',"name":"' || name || '"}', ',' ORDER BY good_no, name) || ']' AS goods FROM good GROUP BY tender_id"""))
def a13(spark, sf):
    return good(spark, sf).groupBy("tender_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("good_no").alias("no"), "name")))).alias("goods"))


@register("A14_bool_or", sql("good", "SELECT tender_id, bool_or(amount > 45) AS any_big, bool_and(unit = 'kg') AS all_kg FROM good GROUP BY tender_id"))
def a14(spark, sf):
    return good(spark, sf).groupBy("tender_id").agg(F.bool_or(F.col("amount") > 45).alias("any_big"), F.bool_and(F.col("unit") == "kg").alias("all_kg"))


GRADE = {"person": 3, "rule": 2, "model": 1}


@register("A15_provenance_grade", sql("product", "SELECT name, max(CASE WHEN code IS NULL THEN 0 WHEN product_id % 4 = 0 THEN 3 WHEN product_id % 4 = 1 THEN 2 ELSE 1 END) AS grade FROM product GROUP BY name"))
def a15(spark, sf):
    k = F.col("product_id") % 4
    grade = F.when(F.col("code").isNull(), 0).when(k == 0, GRADE["person"]).when(k == 1, GRADE["rule"]).otherwise(GRADE["model"])
    return product(spark, sf).groupBy("name").agg(F.max(grade).alias("grade"))


@register("A16_having", sql("tender", "SELECT n, count(*) AS buyers FROM (SELECT buyer_id, count(*) AS n FROM tender GROUP BY buyer_id HAVING count(*) > 5) GROUP BY n"))
def a16(spark, sf):
    return tender(spark, sf).groupBy("buyer_id").agg(_n()).where("n > 5").groupBy("n").agg(_n("buyers"))


@register("A17_share_of_total", sql("tender", "SELECT status, currency, round(100.0 * count(*) / nullif(sum(count(*)) OVER (PARTITION BY currency), 0), 4)::DOUBLE AS pct FROM tender GROUP BY status, currency"))
def a17(spark, sf):
    total = F.sum("n").over(Window.partitionBy("currency"))
    return tender(spark, sf).groupBy("status", "currency").agg(_n()).select("status", "currency", F.round(100.0 * share(F.col("n"), total), 4).alias("pct"))


def centroids(df, key: str, vec: str, least: int):
    """Mean vector of each key that has at least `least` rows, as (key, pos, x): sums by position, so a large group is pre-aggregated."""
    n = df.groupBy(key).agg(_n()).where(F.col("n") >= least)
    return df.join(n, key).select(key, F.posexplode(vec).alias("pos", "v")).groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("x"))


@register("A18_vector_centroid", "SELECT label, pos - 1 AS pos, round(avg(v::DOUBLE), 6) AS x FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 50)) GROUP BY ALL")
def a18(spark, sf):
    return centroids(raw(spark, sf, "embeddings"), "label", "embedding", 50).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@register("A19_monthly_ledger", "SELECT user_id, date_trunc('month', ts)::TIMESTAMP AS month, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS spent, sum(CAST(value AS DECIMAL(18,4))) > 500 AS over_quota FROM events WHERE event_type = 'purchase' GROUP BY ALL")
def a19(spark, sf):
    v = F.sum(F.col("value").cast("decimal(18,4)"))
    return raw(spark, sf, "events").where("event_type = 'purchase'").groupBy("user_id", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(_n(), v.cast("double").alias("spent"), (v > 500).alias("over_quota"))


@register("A20_attempts_since_success", """SELECT e.user_id, count(*) AS n FROM events e LEFT JOIN (SELECT user_id, max(ts) AS ok FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY user_id) s ON e.user_id = s.user_id
    WHERE e.event_type = 'error' AND e.ts <= TIMESTAMP '2024-01-20 00:00:00' AND e.ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL '7 days' AND (s.ok IS NULL OR e.ts > s.ok) GROUP BY e.user_id""")
def a20(spark, sf):
    at = F.lit("2024-01-20 00:00:00").cast("timestamp")
    e = raw(spark, sf, "events").where((F.col("ts") <= at) & F.col("event_type").isin("error", "signup"))
    # one pass: the last success of each user beside its failures
    ok = F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).over(Window.partitionBy("user_id"))
    f = e.withColumn("ok", ok).where((F.col("event_type") == "error") & (F.col("ts") > at - F.make_dt_interval(F.lit(7))) & (F.col("ok").isNull() | (F.col("ts") > F.col("ok"))))
    return f.groupBy("user_id").agg(_n())


@register("A21_code_dictionary", sql("good tender", f"""SELECT code, n_goods, n_open, names FROM (SELECT code, sum(c)::BIGINT AS n_goods, string_agg(name, ',' ORDER BY c DESC, name) FILTER (WHERE rn <= 8) AS names FROM
    (SELECT code, name, count(*) AS c, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, name) AS rn FROM (SELECT unnest([substr(good_code, 1, 2), substr(good_code, 1, 5), good_code]) AS code, name FROM good) GROUP BY code, name) GROUP BY code)
    JOIN (SELECT code, count(DISTINCT CASE WHEN {OPEN_SQL} THEN id END) AS n_open FROM (SELECT unnest([substr(good_code, 1, 2), substr(good_code, 1, 5), good_code]) AS code, tender_id FROM good) JOIN tender ON tender_id = id GROUP BY code) USING (code)"""))
def a21(spark, sf):
    """Goods are counted once by whole code and name; the shorter codes are sums of that."""
    g = good(spark, sf)
    counted = g.groupBy("good_code", "name").agg(_n("c"))
    by_name = counted.select("name", "c", F.explode(code_levels(F.col("good_code"))).alias("code")).groupBy("code", "name").agg(F.sum("c").alias("c")).withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("c"), "name")))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 8, F.struct("rn", "name")))), lambda x: x["name"]), ",")
    dictionary = by_name.groupBy("code").agg(F.sum("c").alias("n_goods"), names.alias("names"))
    t = tender(spark, sf).where(is_open()).select("id")
    opened = g.select("tender_id", "good_code").join(t, g.tender_id == t.id).select("id", "good_code").distinct()
    opened = opened.select("id", F.explode(code_levels(F.col("good_code"))).alias("code")).distinct().groupBy("code").agg(_n("n_open"))
    return dictionary.join(opened, "code", "left").select("code", "n_goods", F.coalesce("n_open", F.lit(0)).alias("n_open"), "names")


@register("A22_matched_positions", sql("good product tender", f"""SELECT id, count(DISTINCT good_no) AS n_positions, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes, CAST(sum(totalcost_item) AS DOUBLE) AS total FROM
    (SELECT t.id, g.good_no, g.totalcost_item, substr(g.good_code, 1, 5) AS code FROM good g JOIN tender t ON g.tender_id = t.id WHERE {OPEN_SQL} AND substr(g.good_code, 1, 5) IN (SELECT substr(code, 1, 5) FROM product WHERE company_id = 1 AND code IS NOT NULL)) GROUP BY id"""))
def a22(spark, sf):
    k = product(spark, sf).where("company_id = 1 AND code IS NOT NULL").select(F.substring("code", 1, 5).alias("code")).distinct()
    hits = code_prefix_join(good(spark, sf), "good_code", k, "code", (5,))
    t = tender(spark, sf).where(is_open()).select("id")
    return hits.join(t, hits.tender_id == t.id).groupBy("id").agg(F.countDistinct("good_no").alias("n_positions"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), money("totalcost_item").alias("total"))


@register("A23_evidence_listing", sql("good tender", f"""SELECT code, name, n, n_open FROM (SELECT substr(good_code, 1, 2) AS code, name, count(*) AS n, count(DISTINCT id) FILTER (WHERE {OPEN_SQL}) AS n_open, row_number() OVER (PARTITION BY substr(good_code, 1, 2) ORDER BY count(*) DESC, name) AS rn
    FROM good JOIN tender ON tender_id = id GROUP BY 1, 2) WHERE rn <= 6"""))
def a23(spark, sf):
    t, g = tender(spark, sf), good(spark, sf)
    j = g.select("tender_id", F.substring("good_code", 1, 2).alias("code"), "name").join(t.select("id", is_open().alias("live")), g.tender_id == t.id)
    agg = j.groupBy("code", "name").agg(_n(), F.countDistinct(F.when(F.col("live"), F.col("id"))).alias("n_open"))
    return agg.withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "name"))).where("rn <= 6").select("code", "name", "n", "n_open")


@register("A24_position_search", sql("good", "SELECT good_code, count(*) AS n, count(DISTINCT tender_id) AS n_tenders, min(name) AS sample FROM good WHERE contains(name, 'bolt') GROUP BY good_code"))
def a24(spark, sf):
    return good(spark, sf).where(F.col("name").contains("bolt")).groupBy("good_code").agg(_n(), F.countDistinct("tender_id").alias("n_tenders"), F.min("name").alias("sample"))


@register("A25_frequency_counters", sql("tender", "SELECT status, close_at IS NOT NULL AS has_end, count(*) AS n FROM tender GROUP BY ALL ORDER BY n DESC"))
def a25(spark, sf):
    return tender(spark, sf).groupBy("status", F.col("close_at").isNotNull().alias("has_end")).agg(_n()).orderBy(F.desc("n"))


@register("A26_review_pace", """SELECT user_id, n, round(median_s, 3) AS median_s, CASE WHEN span_days >= 2 THEN round(median_s * 100 / 3600, 3) END AS hours_left, CASE WHEN median_s > 0 THEN CAST(floor(8 * 3600 / median_s) AS BIGINT) END AS per_day FROM
    (SELECT user_id, count(*) AS n, quantile_cont(gap, 0.5) AS median_s, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS span_days FROM (SELECT user_id, ts, epoch(ts::TIMESTAMP(0)) - epoch(lag(ts::TIMESTAMP(0)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM (SELECT user_id, event_id, date_trunc('second', ts) AS ts FROM events)) GROUP BY user_id)""")
def a26(spark, sf):
    e = raw(spark, sf, "events").select("user_id", "event_id", F.date_trunc("second", "ts").alias("ts"))
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    e = e.withColumn("gap", gap)
    a = with_quantiles(e.groupBy("user_id").agg(_n(), F.datediff(F.max("ts"), F.min("ts")).alias("days")), e, ["user_id"], {"m": (F.col("gap"), 0.5, "linear")})
    return a.select("user_id", "n", F.round("m", 3).alias("median_s"), F.when(F.col("days") >= 2, F.round(F.col("m") * 100 / 3600, 3)).alias("hours_left"), F.when(F.col("m") > 0, F.floor(F.lit(8 * 3600) / F.col("m"))).alias("per_day"))


@register("A27_requirement_summary", "SELECT d.source, count(*) FILTER (WHERE l.quality = 1) AS good, count(*) FILTER (WHERE l.toxic = 1) AS toxic, count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled, coalesce(string_agg(DISTINCT d.lang, ',' ORDER BY d.lang) FILTER (WHERE l.quality = 0), '') AS langs FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source")
def a27(spark, sf):
    j = raw(spark, sf, "documents").join(raw(spark, sf, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("quality") == 0, F.col("lang")))), ",").alias("langs"))


@register("A28_freshness", sql("tender", "SELECT source_platform, max(published_at) AS latest, date_diff('day', max(published_at)::DATE, DATE '2001-12-31') AS age_days, bool_or(close_at IS NULL) AS any_missing FROM tender GROUP BY source_platform"))
def a28(spark, sf):
    return tender(spark, sf).groupBy("source_platform").agg(F.max("published_at").alias("latest"), F.datediff(F.lit("2001-12-31").cast("date"), F.max("published_at")).cast("long").alias("age_days"), F.bool_or(F.col("close_at").isNull()).alias("any_missing"))


@register("A29_release_gate", "SELECT round(100.0 * count(*) FILTER (WHERE event_type <> 'error') / nullif(count(*), 0), 3)::DOUBLE AS useful_pct, count(*) FILTER (WHERE event_type NOT IN ('click', 'error', 'purchase', 'signup', 'view')) AS unknown, CASE WHEN count(*) = 0 THEN 'no_data' WHEN 100.0 * count(*) FILTER (WHERE event_type <> 'error') / count(*) >= 95 THEN 'pass' ELSE 'fail' END AS verdict FROM events")
def a29(spark, sf):
    a = raw(spark, sf, "events").agg(_n(), F.count_if(F.col("event_type") != "error").alias("ok"), F.count_if(~F.col("event_type").isin("click", "error", "purchase", "signup", "view")).alias("unknown"))
    pct = 100.0 * share(F.col("ok"), F.col("n"))
    return a.select(F.round(pct, 3).alias("useful_pct"), "unknown", F.when(F.col("n") == 0, "no_data").when(pct >= 95, "pass").otherwise("fail").alias("verdict"))
