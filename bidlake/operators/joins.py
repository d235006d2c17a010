"""Join operators (J1-J18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.catalog import register
from bidlake.plans.rewrites import code_prefix_join, patterns_in, prefix_join, similar
from bidlake.sources.procurement import area, good, product, raw, sql, tender


@register("J1_left_dims", sql("tender area", "SELECT t.id, a.name AS area_name, a.level FROM tender t LEFT JOIN area a ON t.area_path = a.area_id AND a.level = 2"))
def j1(spark, sf):
    a = area(spark, sf).where("level = 2")
    return tender(spark, sf).join(F.broadcast(a), F.col("area_path") == a.area_id, "left").select("id", F.col("name").alias("area_name"), "level")


@register("J2_inner_equi", sql("tender good", "SELECT t.currency, g.category, count(*) AS n FROM good g JOIN tender t ON g.tender_id = t.id GROUP BY ALL"))
def j2(spark, sf):
    t, g = tender(spark, sf), good(spark, sf)
    return g.select("tender_id", "category").join(t.select("id", "currency"), g.tender_id == t.id).groupBy("currency", "category").agg(F.count(F.lit(1)).alias("n"))


@register("J3_prefix_theta", sql("tender area", "SELECT p.area_id, p.name, count(t.id) AS n FROM area p LEFT JOIN tender t ON t.area_path = p.area_id OR t.area_path LIKE p.area_id || '.%' WHERE p.level = 1 GROUP BY ALL"))
def j3(spark, sf):
    p = area(spark, sf).where("level = 1")
    n = prefix_join(tender(spark, sf).select("id", "area_path"), "area_path", F.broadcast(p.select("area_id")), "area_id").groupBy("area_id").agg(F.count("id").alias("n"))
    return p.join(n, "area_id", "left").select("area_id", "name", F.coalesce("n", F.lit(0)).alias("n"))


@register("J4_code_prefix", sql("good product", "SELECT k.code, count(*) AS n, count(DISTINCT g.tender_id) AS n_tenders FROM (SELECT DISTINCT substr(code, 1, 5) AS code FROM product WHERE company_id = 1 AND code IS NOT NULL) k JOIN good g ON g.good_code LIKE k.code || '%' GROUP BY k.code"))
def j4(spark, sf):
    k = product(spark, sf).where("company_id = 1 AND code IS NOT NULL").select(F.substring("code", 1, 5).alias("code")).distinct()
    return code_prefix_join(good(spark, sf), "good_code", k, "code", (5,)).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tender_id").alias("n_tenders"))


@register("J5_semi", sql("tender good", "SELECT id FROM tender WHERE id IN (SELECT tender_id FROM good WHERE unit = 'kg' AND amount > 45)"))
def j5(spark, sf):
    g = good(spark, sf).where("unit = 'kg' AND amount > 45")
    return tender(spark, sf).join(g, F.col("id") == g.tender_id, "left_semi").select("id")


@register("J6_anti", sql("tender good", "SELECT id FROM tender t WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.tender_id = t.id)"))
def j6(spark, sf):
    g = good(spark, sf)
    return tender(spark, sf).join(g, F.col("id") == g.tender_id, "left_anti").select("id")


@register("J7_full_outer_state", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS has_doc, l.doc_id IS NOT NULL AS has_label FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id")
def j7(spark, sf):
    d, lab = raw(spark, sf, "documents").select(F.col("doc_id").alias("a")), raw(spark, sf, "labels").select(F.col("doc_id").alias("b"))
    return d.join(lab, d.a == lab.b, "full_outer").select(F.coalesce("a", "b").alias("doc_id"), F.col("a").isNotNull().alias("has_doc"), F.col("b").isNotNull().alias("has_label"))


@register("J7b_full_outer_all", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS has_doc, l.doc_id IS NOT NULL AS has_label FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id")
def j7b(spark, sf):
    """J7 under the name it had while J7 took half of the documents."""
    return j7(spark, sf)


def fuse(rankings: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings (key, rnk): union and sum, which needs one shuffle and no outer joins."""
    out = None
    for n, r in enumerate(rankings):
        part = r.select(key, (F.lit(1.0) / (k + F.col("rnk"))).alias("s"), F.lit(n).alias("src"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("n_sources"))


@register("J8_rank_fusion", sql("tender", """, a AS (SELECT id, row_number() OVER (ORDER BY totalcost DESC, id) AS rnk FROM tender WHERE totalcost IS NOT NULL ORDER BY totalcost DESC, id LIMIT 50),
    b AS (SELECT id, row_number() OVER (ORDER BY published_at DESC, id) AS rnk FROM tender ORDER BY published_at DESC, id LIMIT 50)
    SELECT coalesce(a.id, b.id) AS id, round(coalesce(1.0::DOUBLE / (60 + a.rnk), 0) + coalesce(1.0::DOUBLE / (60 + b.rnk), 0), 9) AS score FROM a FULL OUTER JOIN b ON a.id = b.id"""))
def j8(spark, sf):
    t = tender(spark, sf)
    a = t.where("totalcost IS NOT NULL").orderBy(F.desc("totalcost"), "id").limit(50).withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("totalcost"), "id")))
    b = t.orderBy(F.desc("published_at"), "id").limit(50).withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("published_at"), "id")))
    return fuse([a, b], "id").select("id", F.round("score", 9).alias("score"))


@register("J9_skeleton", sql("tender", "SELECT p.source_platform, s.status, coalesce(n, 0) AS n FROM (VALUES ('portal_a'), ('portal_b'), ('portal_c')) p(source_platform) CROSS JOIN (VALUES ('open'), ('closed'), ('cancelled')) s(status) LEFT JOIN (SELECT source_platform, status, count(*) AS n FROM tender GROUP BY ALL) t ON t.source_platform = p.source_platform AND t.status = s.status"))
def j9(spark, sf):
    frame = spark.createDataFrame([(p, s) for p in ("portal_a", "portal_b", "portal_c") for s in ("open", "closed", "cancelled")], "source_platform string, status string")
    n = tender(spark, sf).groupBy("source_platform", "status").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(frame).join(n, ["source_platform", "status"], "left").select("source_platform", "status", F.coalesce("n", F.lit(0)).alias("n"))


@register("J10_pattern_counts", sql("good", "SELECT p.ord, p.pattern, count(g.name) AS n FROM (VALUES (0, 'bolt'), (1, 'red gear'), (2, 'anvil'), (3, 'absent')) p(ord, pattern) LEFT JOIN good g ON contains(g.name, p.pattern) GROUP BY ALL"))
def j10(spark, sf):
    p = spark.createDataFrame([(0, "bolt"), (1, "red gear"), (2, "anvil"), (3, "absent")], "ord int, pattern string")
    names = good(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("c"))
    n = patterns_in(names, "name", p, "pattern", inside=True).groupBy("pattern").agg(F.sum("c").alias("n"))
    return p.join(n, "pattern", "left").select("ord", "pattern", F.coalesce("n", F.lit(0)).alias("n"))


_TRI = "list_distinct([substr({0}, i, 3) for i in range(1, length({0}) - 1)])"


@register("J11_trigram_similarity", sql("product", f"""SELECT a.name AS a_name, b.name AS b_name, round(len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))), 6) AS sim
    FROM (SELECT DISTINCT name, {_TRI.format("name")} AS ga FROM product) a JOIN (SELECT DISTINCT name, {_TRI.format("name")} AS gb FROM product) b ON a.name < b.name
    WHERE len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))) >= 0.3"""))
def j11(spark, sf):
    p = product(spark, sf).select("name").distinct()
    return similar(p, "name", "name", p, "name", "name", 0.3).where("lid < rid").select(F.col("lid").alias("a_name"), F.col("rid").alias("b_name"), F.round("sim", 6).alias("sim"))


def _tri_sim(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"


@register("J11b_trigram_names_words", sql("product", f""", n AS (SELECT DISTINCT name AS t, {_TRI.format("name")} AS g FROM product),
    w AS (SELECT DISTINCT t, {_TRI.format("t")} AS g FROM (SELECT unnest(regexp_split_to_array(name, '[^[:alnum:]]+')) AS t FROM product) WHERE length(t) >= 4)
    SELECT 'name' AS kind, a.t AS a_text, b.t AS b_text, round({_tri_sim("a.g", "b.g")}, 6) AS sim FROM n a JOIN n b ON a.t < b.t WHERE {_tri_sim("a.g", "b.g")} >= 0.3
    UNION ALL SELECT 'word', a.t, b.t, round({_tri_sim("a.g", "b.g")}, 6) FROM w a JOIN n b ON a.t <> b.t WHERE {_tri_sim("a.g", "b.g")} >= 0.3"""))
def j11b(spark, sf):
    """The reference's threshold, for names with names and for names' words of four letters or more with names."""
    p = product(spark, sf).select("name").distinct()
    w = p.select(F.explode(F.split("name", r"[^\p{Alnum}]+")).alias("name")).where(F.length("name") >= 4).distinct()
    pairs = lambda kind, left, keep: similar(left, "name", "name", p, "name", "name", 0.3).where(keep).select(F.lit(kind).alias("kind"), F.col("lid").alias("a_text"), F.col("rid").alias("b_text"), F.round("sim", 6).alias("sim"))
    return pairs("name", p, "lid < rid").union(pairs("word", w, "lid <> rid"))


@register("J12_lateral_topk", sql("tender", "SELECT id, other, rn FROM (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.totalcost - b.totalcost), b.id) AS rn FROM tender a JOIN tender b ON a.buyer_id = b.buyer_id AND a.id <> b.id AND b.totalcost IS NOT NULL WHERE a.totalcost IS NOT NULL) WHERE rn <= 2"))
def j12(spark, sf):
    return nearest(tender(spark, sf).where("totalcost IS NOT NULL"), "buyer_id", "id", "totalcost", 2)


def nearest(df: DataFrame, group: str, key: str, value: str, k: int) -> DataFrame:
    """The k rows of the same group whose value is nearest, ties by key: (key, other, rn).

    They are among the k rows before and behind in the order of values and the first k + 1 of the same
    value, so windows do and no pairs are made.
    """
    up, down = Window.partitionBy(group).orderBy(F.col(value), F.col(key)), Window.partitionBy(group).orderBy(F.col(value), F.desc(key))
    same = Window.partitionBy(group, value).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct(F.col(key).alias("other"), F.col(value).alias("v"))
    found = [F.lead(row, n).over(up) for n in range(1, k + 1)] + [F.lag(row, n).over(down) for n in range(1, k + 1)] + [F.nth_value(row, n).over(same) for n in range(1, k + 2)]
    near = df.select(key, value, F.array(*found).alias("x"))
    others = F.filter(F.array_distinct(F.array_compact("x")), lambda x: x["other"] != F.col(key))
    best = F.slice(F.array_sort(F.transform(others, lambda x: F.struct(F.abs(x["v"] - F.col(value)).alias("d"), x["other"].alias("other")))), 1, k)
    return near.select(key, F.posexplode(best).alias("p", "x")).select(key, "x.other", (F.col("p") + 1).alias("rn"))


@register("J13_lateral_unnest", sql("product", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(name, ' ')) AS w FROM product) GROUP BY w"))
def j13(spark, sf):
    return product(spark, sf).select(F.explode(F.split("name", " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@register("J14_scalar_subqueries", sql("tender good", "SELECT t.id, (SELECT count(*) FROM good g WHERE g.tender_id = t.id) AS n_goods, (SELECT max(good_no) FROM good g WHERE g.tender_id = t.id) AS last_no, (SELECT string_agg(n, ',' ORDER BY n) FROM (SELECT DISTINCT category AS n FROM good g WHERE g.tender_id = t.id)) AS categories FROM tender t"))
def j14(spark, sf):
    g = good(spark, sf).groupBy("tender_id").agg(F.count(F.lit(1)).alias("n_goods"), F.max("good_no").alias("last_no"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    return tender(spark, sf).join(g, F.col("id") == g.tender_id, "left").select("id", F.coalesce("n_goods", F.lit(0)).alias("n_goods"), "last_no", "categories")


@register("J15_tenant_join", sql("product", "SELECT a.company_id, a.category, count(*) AS n FROM product a JOIN product b ON a.company_id = b.company_id AND a.name = b.name AND a.product_id < b.product_id GROUP BY ALL"))
def j15(spark, sf):
    # pairs of equal (company, name) counted from group sizes would lose the category of the smaller id, so rank instead of joining
    w = Window.partitionBy("company_id", "name")
    p = product(spark, sf).select("company_id", "category", F.count(F.lit(1)).over(w).alias("size"), F.row_number().over(w.orderBy("product_id")).alias("rn"))
    return p.groupBy("company_id", "category").agg(F.sum(F.col("size") - F.col("rn")).alias("n")).where("n > 0")


@register("J16_self_correction", "SELECT event_id, user_id FROM events e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'error' AND CAST(json_extract_string(c.props, '$.k') AS BIGINT) = e.event_id)")
def j16(spark, sf):
    e = raw(spark, sf, "events")
    c = e.where("event_type = 'error'").select(F.get_json_object("props", "$.k").cast("long").alias("fixes"))
    return e.where("event_type <> 'error'").join(c, F.col("event_id") == c.fixes, "left_anti").select("event_id", "user_id")


@register("J17_best_attribution", sql("good product", f"""SELECT code, g_name, max(name) AS product FROM (SELECT *, rank() OVER (PARTITION BY code, g_name ORDER BY sim DESC) AS r FROM
    (SELECT p.code, g.name AS g_name, p.name, len(list_intersect({_TRI.format("g.name")}, {_TRI.format("p.name")})) / len(list_distinct(list_concat({_TRI.format("g.name")}, {_TRI.format("p.name")}))) AS sim
     FROM (SELECT DISTINCT substr(good_code, 1, 2) AS code, name FROM good) g JOIN (SELECT DISTINCT substr(code, 1, 2) AS code, name FROM product WHERE company_id = 2 AND code IS NOT NULL) p ON g.code = p.code) WHERE sim >= 0.05) WHERE r = 1 GROUP BY code, g_name"""))
def j17(spark, sf):
    """Names are compared once, whatever codes they share, and only those that share rare trigrams; the codes are joined on afterwards."""
    g = good(spark, sf).select(F.substring("good_code", 1, 2).alias("code"), F.col("name").alias("g_name")).distinct()
    p = product(spark, sf).where("company_id = 2 AND code IS NOT NULL").select(F.substring("code", 1, 2).alias("code"), "name").distinct()
    names = lambda df, c: df.select(c).distinct().withColumn("id", F.col(c))
    near = similar(names(g, "g_name"), "id", "g_name", names(p, "name"), "id", "name", 0.05).select(F.col("lid").alias("g_name"), F.col("rid").alias("name"), "sim")
    j = g.join(near, "g_name").join(p, ["code", "name"])
    return j.groupBy("code", "g_name").agg(F.max(F.struct("sim", "name"))["name"].alias("product"))


@register("J18_null_safe_latest", sql("tender", "SELECT a.id FROM tender a JOIN tender b ON b.id = a.id + 1 WHERE a.close_at IS DISTINCT FROM b.close_at AND a.currency IS NOT DISTINCT FROM b.currency"))
def j18(spark, sf):
    t = tender(spark, sf).select("id", "close_at", "currency")
    b = t.select((F.col("id") - 1).alias("id"), F.col("close_at").alias("c2"), F.col("currency").alias("cur2"))
    return t.join(b, "id").where(~F.col("close_at").eqNullSafe(F.col("c2")) & F.col("currency").eqNullSafe(F.col("cur2"))).select("id")
