"""Window functions (W1-W8), sorting and top-k (T1-T8) and set operations (U1-U4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.catalog import register
from bidlake.operators.filters import is_open
from bidlake.sources.procurement import good, now, product, raw, sql, tender

OPEN_SQL = "status = 'open' AND (close_at IS NULL OR close_at > $now)"


def ranked(df: DataFrame, cap: int, *order) -> DataFrame:
    """The first `cap` rows in an order, numbered. The global window sees the cap's rows only."""
    return df.orderBy(*order).limit(cap).withColumn("rn", F.row_number().over(Window.orderBy(*order)))


def top_per(df: DataFrame, key: list[str], k: int, *order) -> DataFrame:
    """The first k rows of each key; Spark cuts each task's rows to k before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rn") <= k)


def cosine_distance(vec: str, query: list[float]):
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(F.col(vec), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(F.col(vec), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    own = sum(x * x for x in query) ** 0.5
    return 1 - dot / F.when(norm > 0, norm * own)


_QUERY = [((7 * k) % 11 - 5) / 10 for k in range(64)]
_QUERY_SQL = "[" + ",".join(map(str, _QUERY)) + "]::DOUBLE[]"


@register("W1_vector_row_number", f"SELECT vec_id, rn FROM (SELECT vec_id, row_number() OVER (ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], {_QUERY_SQL}), 9), vec_id) AS rn FROM embeddings) WHERE rn <= 50")
def w1(spark, sf):
    e = raw(spark, sf, "embeddings").select("vec_id", F.round(cosine_distance("embedding", _QUERY), 9).alias("d"))
    return ranked(e, 50, "d", "vec_id").select("vec_id", "rn")


@register("W2_evidence_rank", sql("good", "SELECT code, rn FROM (SELECT substr(good_code, 1, 5) AS code, row_number() OVER (ORDER BY count(*) DESC, max(amount) DESC, substr(good_code, 1, 5)) AS rn FROM good GROUP BY 1) WHERE rn <= 30"))
def w2(spark, sf):
    g = good(spark, sf).groupBy(F.substring("good_code", 1, 5).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.max("amount").alias("best"))
    return ranked(g, 30, F.desc("n"), F.desc("best"), "code").select("code", "rn")


@register("W3_fair_interleave", sql("tender", "SELECT id, source_platform, rn FROM (SELECT id, source_platform, row_number() OVER (PARTITION BY source_platform ORDER BY published_at DESC, id) AS rn FROM tender) ORDER BY rn, source_platform LIMIT 40"))
def w3(spark, sf):
    t = top_per(tender(spark, sf), ["source_platform"], 40, F.desc("published_at"), "id")
    return t.orderBy("rn", "source_platform").limit(40).select("id", "source_platform", "rn")


@register("W4_share_window", sql("tender", "SELECT source_platform, status, round(n::DOUBLE / sum(n) OVER (PARTITION BY source_platform), 6) AS part FROM (SELECT source_platform, status, count(*) AS n FROM tender GROUP BY ALL)"))
def w4(spark, sf):
    return tender(spark, sf).groupBy("source_platform", "status").agg(F.count(F.lit(1)).alias("n")).select("source_platform", "status", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source_platform")), 6).alias("part"))


@register("W5_distinct_on", sql("tender", "SELECT DISTINCT ON (buyer_id) buyer_id, id, published_at FROM tender ORDER BY buyer_id, published_at DESC, id DESC"))
def w5(spark, sf):
    last = F.max(F.struct("published_at", "id"))
    return tender(spark, sf).groupBy("buyer_id").agg(last.alias("x")).select("buyer_id", "x.id", "x.published_at")


@register("W6_round_robin", sql("tender", """SELECT id, grp, rn, row_number() OVER (ORDER BY rn, grp) <= 10 AS blind FROM (
    SELECT id, 'deadline' AS grp, row_number() OVER (ORDER BY close_at, id) AS rn FROM tender WHERE close_at > $now QUALIFY rn <= 10 UNION ALL
    SELECT id, 'random', row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR))) AS rn FROM tender QUALIFY rn <= 10 UNION ALL
    SELECT id, 'value', row_number() OVER (ORDER BY totalcost DESC NULLS LAST, id) AS rn FROM tender QUALIFY rn <= 10)"""))
def w6(spark, sf):
    t = tender(spark, sf)
    parts = [("deadline", t.where(F.col("close_at") > now()), ["close_at", "id"]), ("random", t.withColumn("h", F.md5(F.col("id").cast("string").cast("binary"))), ["h"]), ("value", t, [F.desc_nulls_last("totalcost"), "id"])]
    out = None
    for name, df, order in parts:
        p = ranked(df, 10, *order).select("id", F.lit(name).alias("grp"), "rn")
        out = p if out is None else out.unionByName(p)
    return out.withColumn("blind", F.row_number().over(Window.orderBy("rn", "grp")) <= 10)


@register("W7_total_with_page", sql("product", "SELECT product_id, name, total FROM (SELECT product_id, name, count(*) OVER () AS total FROM product WHERE company_id = 2) ORDER BY product_id LIMIT 15"))
def w7(spark, sf):
    p = product(spark, sf).where("company_id = 2")
    total = p.agg(F.count(F.lit(1)).alias("total"))
    return p.orderBy("product_id").limit(15).crossJoin(F.broadcast(total)).select("product_id", "name", "total")


@register("W8_distinct_on_priority", "SELECT DISTINCT ON (source) source, d.doc_id, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY source, l.doc_id IS NOT NULL DESC, quality DESC NULLS LAST, n_chars DESC, d.doc_id")
def w8(spark, sf):
    d = raw(spark, sf, "documents").select("doc_id", "source", "n_chars").join(raw(spark, sf, "labels"), "doc_id", "left")
    best = top_per(d, ["source"], 1, F.col("quality").isNotNull().desc(), F.desc_nulls_last("quality"), F.desc("n_chars"), "doc_id")
    return best.select("source", "doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@register("W9_frames_lag_lead", "SELECT event_id, lag(value) OVER w AS prev, lead(value) OVER w AS next, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS avg3, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rnk, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS drnk, ntile(4) OVER w AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w9(spark, sf):
    w, k = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy("event_type")
    return raw(spark, sf, "events").select("event_id", F.lag("value").over(w).alias("prev"), F.lead("value").over(w).alias("next"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("avg3"), F.rank().over(k).alias("rnk"), F.dense_rank().over(k).alias("drnk"), F.ntile(4).over(w).alias("quarter"))


def page(df: DataFrame, offset: int, limit: int, *order) -> tuple[DataFrame, DataFrame]:
    """A page and the total beside it."""
    return df.orderBy(*order).offset(offset).limit(limit), df.agg(F.count(F.lit(1)).alias("total"))


@register("T1_page", sql("tender", f"SELECT id, published_at FROM tender WHERE {OPEN_SQL} ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 20 OFFSET 40"))
def t1(spark, sf):
    rows, _ = page(tender(spark, sf).where(is_open()).select("id", "published_at"), 40, 20, F.desc_nulls_last("published_at"), F.desc("id"))
    return rows


@register("T1b_page_total", sql("tender", f"SELECT count(*) AS total FROM tender WHERE {OPEN_SQL}"))
def t1b(spark, sf):
    return page(tender(spark, sf).where(is_open()), 40, 20, "id")[1]


@register("T2_candidate_cap", sql("tender", "SELECT id FROM tender ORDER BY status = 'open' DESC, (close_at IS NULL OR close_at > $now) DESC, close_at ASC NULLS LAST, id LIMIT 300"))
def t2(spark, sf):
    live = F.col("close_at").isNull() | (F.col("close_at") > now())
    return tender(spark, sf).orderBy((F.col("status") == "open").desc(), live.desc(), F.asc_nulls_last("close_at"), "id").limit(300).select("id")


@register("T3_topk_per_group", sql("good", "SELECT tender_id, good_no, rn FROM (SELECT tender_id, good_no, row_number() OVER (PARTITION BY tender_id ORDER BY totalcost_item DESC, good_no, part_id) AS rn FROM good) WHERE rn <= 6"))
def t3(spark, sf):
    return top_per(good(spark, sf), ["tender_id"], 6, F.desc("totalcost_item"), "good_no", "part_id").select("tender_id", "good_no", "rn")


@register("T4_score_deadline", sql("tender", "SELECT id, CAST(id % 101 AS BIGINT) AS score FROM tender ORDER BY id % 101 DESC, close_at ASC NULLS LAST, id LIMIT 50"))
def t4(spark, sf):
    return tender(spark, sf).withColumn("score", F.col("id") % 101).orderBy(F.desc("score"), F.asc_nulls_last("close_at"), "id").limit(50).select("id", "score")


@register("T5_priority_queue", sql("tender", "SELECT id FROM tender ORDER BY CASE WHEN id % 7 = 0 THEN 0 WHEN id % 5 = 0 THEN 1 ELSE 2 END, close_at ASC NULLS LAST, id LIMIT 60"))
def t5(spark, sf):
    first = F.when(F.col("id") % 7 == 0, 0).when(F.col("id") % 5 == 0, 1).otherwise(2)
    return tender(spark, sf).orderBy(first, F.asc_nulls_last("close_at"), "id").limit(60).select("id")


@register("T6_priority_number", sql("tender", f"SELECT buyer_id, count(*) FILTER (WHERE {OPEN_SQL}) * 10 + count(*) FILTER (WHERE NOT ({OPEN_SQL})) AS priority FROM tender GROUP BY buyer_id"))
def t6(spark, sf):
    return tender(spark, sf).groupBy("buyer_id").agg((F.count_if(is_open()) * 10 + F.count_if(~is_open())).alias("priority"))


@register("T7_vector_queue", sql("tender", f"SELECT id FROM tender ORDER BY ({OPEN_SQL}) DESC, close_at ASC NULLS LAST, id DESC LIMIT 100"))
def t7(spark, sf):
    return tender(spark, sf).orderBy(is_open().desc(), F.asc_nulls_last("close_at"), F.desc("id")).limit(100).select("id")


@register("T8_seeded_sample", sql("tender", "SELECT id FROM tender ORDER BY md5('42:' || id), id LIMIT 50"))
def t8(spark, sf):
    return tender(spark, sf).orderBy(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string")).cast("binary")), "id").limit(50).select("id")


@register("U1_union_distinct", sql("tender good", "SELECT tender_id AS id FROM good WHERE contains(name, 'anvil') UNION SELECT id FROM tender WHERE contains(title, 'household')"))
def u1(spark, sf):
    a = good(spark, sf).where(F.col("name").contains("anvil")).select(F.col("tender_id").alias("id"))
    return a.union(tender(spark, sf).where(F.col("title").contains("household")).select("id")).distinct()


@register("U2_union_all_layers", sql("tender product", "SELECT 'tender' AS layer, status AS kind, count(*) AS n FROM tender GROUP BY status UNION ALL SELECT 'product', category, count(*) FROM product GROUP BY category UNION ALL SELECT 'event', event_type, count(*) FROM events GROUP BY event_type"))
def u2(spark, sf):
    layer = lambda name, df, c: df.groupBy(F.col(c).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), "kind", "n")
    return layer("tender", tender(spark, sf), "status").unionByName(layer("product", product(spark, sf), "category")).unionByName(layer("event", raw(spark, sf, "events"), "event_type"))


@register("U3_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u3(spark, sf):
    return raw(spark, sf, "documents").select("doc_id").subtract(raw(spark, sf, "labels").select("doc_id"))


@register("U4_id_algebra", sql("good", "SELECT tender_id, max(by_code) AS by_code, max(by_text) AS by_text FROM (SELECT tender_id, 1 AS by_code, 0 AS by_text FROM good WHERE good_code LIKE '11.%' UNION ALL SELECT tender_id, 0, 1 FROM good WHERE contains(name, 'ring')) GROUP BY tender_id"))
def u4(spark, sf):
    g = good(spark, sf)
    code, text = F.col("good_code").startswith("11."), F.col("name").contains("ring")
    return g.where(code | text).groupBy("tender_id").agg(F.max(code.cast("int")).alias("by_code"), F.max(text.cast("int")).alias("by_text"))


@register("U5_intersect", "SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def u5(spark, sf):
    e = raw(spark, sf, "events")
    return e.where("event_type = 'purchase'").select("user_id").intersect(e.where("event_type = 'error'").select("user_id"))


@register("U6_grouping_sets", sql("tender", "SELECT source_platform, status, currency, count(*) AS n FROM tender GROUP BY GROUPING SETS ((source_platform, status), (currency), ())"))
def u6(spark, sf):
    return tender(spark, sf).groupingSets([["source_platform", "status"], ["currency"], []], "source_platform", "status", "currency").agg(F.count(F.lit(1)).alias("n"))
