"""Decisions and their lifecycles (D16, D21, D40-D42, D45-D56), and evidence in texts (X6, X10, X11, X19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.catalog import _SQL, register
from bidlake.functions.text import fold
from bidlake.operators.filters import is_open
from bidlake.operators.ordering import ranked, top_per
from bidlake.plans.domain import priced, stock_check, stock_summary, stocked
from bidlake.plans.requirements import checked, summed
from bidlake.sources.procurement import good, now, product, raw, sql, tender

OPEN_SQL = "status = 'open' AND (close_at IS NULL OR close_at > $now)"

# --- texts ---

@register("X19_region_alias", "SELECT n_nationkey, '33.' || n_regionkey || '.' || n_nationkey AS area_id FROM nation")
def x19(spark, sf):
    """Names are matched without case and with one kind of apostrophe."""
    key = lambda c: F.translate(F.lower(F.trim(c)), "`’ʻ", "'''")
    n = raw(spark, sf, "nation")
    alias = n.select(key(F.col("n_name")).alias("k"), F.concat_ws(".", F.lit("33"), "n_regionkey", "n_nationkey").alias("area_id"))
    sent = n.select("n_nationkey", F.concat(F.lit(" "), F.initcap("n_name"), F.lit(" ")).alias("name"))
    return sent.join(F.broadcast(alias), key(F.col("name")) == F.col("k")).select("n_nationkey", "area_id")


# --- requirements ---


@register("D16_registry_rows", sql("good", "SELECT tender_id, name, row_number() OVER (PARTITION BY tender_id ORDER BY good_no, part_id) AS pos, 1.0::DOUBLE AS confidence FROM good"))
def d16(spark, sf):
    pos = F.row_number().over(Window.partitionBy("tender_id").orderBy("good_no", "part_id"))
    return good(spark, sf).select("tender_id", "name", pos.alias("pos"), F.lit(1.0).alias("confidence"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both that share a number or two terms: (key, numbers, terms, same)."""
    j = a.join(b, key)
    numbers, terms = F.size(F.array_intersect("numbers_a", "numbers_b")), F.size(F.array_intersect("terms_a", "terms_b"))
    return j.select(key, numbers.alias("numbers"), terms.alias("terms"), ((numbers > 0) | (terms >= 2)).alias("same"))


@register("D21_pattern_model_overlap", sql("tender good", """SELECT id, len(list_intersect(string_split(title, ' '), goods)) AS terms, 0 AS numbers, len(list_intersect(string_split(title, ' '), goods)) >= 2 AS same FROM tender JOIN (SELECT tender_id, list(DISTINCT category) AS goods FROM good GROUP BY tender_id) ON id = tender_id""").replace("AS terms, 0 AS numbers", "AS terms, 0::INTEGER AS numbers"))
def d21(spark, sf):
    none = F.array().cast("array<string>")
    a = tender(spark, sf).select("id", none.alias("numbers_a"), F.split("title", " ").alias("terms_a"))
    b = good(spark, sf).groupBy(F.col("tender_id").alias("id")).agg(F.collect_set("category").alias("terms_b")).withColumn("numbers_b", none)
    return overlap(a, b, "id").select("id", F.col("terms").cast("long").alias("terms"), "numbers", "same")


# --- decisions ---


def reviewed(rows: DataFrame, decisions: DataFrame, bulk: bool) -> DataFrame:
    """rows (id, status, blind) after decisions (id, new): the first blind verdict and the previous status are kept; a bulk write touches pending rows only."""
    j = rows.join(decisions, "id", "left")
    write = F.col("new").isNotNull() & ((F.col("status") == "pending") if bulk else F.lit(True))
    return j.select("id", F.when(write, F.col("new")).otherwise(F.col("status")).alias("status"), F.when(write, F.col("status")).alias("previous"), F.coalesce("blind", F.when(write, F.col("new"))).alias("blind"))


def _review_rows(spark, sf):
    k = F.col("doc_id")
    rows = raw(spark, sf, "documents").select(k.alias("id"), F.when(k % 3 == 0, "pending").otherwise("approved").alias("status"), F.when(k % 4 == 0, "rejected").alias("blind"))
    return rows, raw(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("new"))


_REV = "SELECT d.doc_id AS id, CASE WHEN d.doc_id % 3 = 0 THEN 'pending' ELSE 'approved' END AS old, CASE WHEN d.doc_id % 4 = 0 THEN 'rejected' END AS b, CASE WHEN l.doc_id IS NULL THEN NULL WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS new FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@register("D50_review_write", f"SELECT id, coalesce(new, old) AS status, CASE WHEN new IS NOT NULL THEN old END AS previous, coalesce(b, new) AS blind FROM ({_REV})")
def d50(spark, sf):
    return reviewed(*_review_rows(spark, sf), bulk=False)


@register("D50b_bulk_review", f"SELECT id, CASE WHEN old = 'pending' THEN coalesce(new, old) ELSE old END AS status, CASE WHEN new IS NOT NULL AND old = 'pending' THEN old END AS previous, coalesce(b, CASE WHEN old = 'pending' THEN new END) AS blind FROM ({_REV})")
def d50b(spark, sf):
    return reviewed(*_review_rows(spark, sf), bulk=True)


def frozen_sample(t: DataFrame, size: int) -> DataFrame:
    """Three strata (nearest deadline, seeded, highest value), each row once by the first stratum that has it."""
    seed = F.md5(F.concat(F.lit("pilot:"), F.col("id").cast("string")).cast("binary"))
    parts = [(0, "deadline", t.where(F.col("close_at") > now()), ["close_at", "id"]), (1, "random", t.withColumn("s", seed), ["s"]), (2, "value", t, [F.desc_nulls_last("totalcost"), "id"])]
    out = None
    for n, name, df, order in parts:
        p = ranked(df, size, *order).select("id", F.lit(n).alias("n"), F.lit(name).alias("stratum"), "rn")
        out = p if out is None else out.unionByName(p)
    return top_per(out.drop("rn"), ["id"], 1, "n").select("id", "stratum")


@register("D51_frozen_pilot", sql("tender", """SELECT id, stratum FROM (SELECT id, stratum, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM (
    SELECT id, 0 AS n, 'deadline' AS stratum FROM tender WHERE close_at > $now QUALIFY row_number() OVER (ORDER BY close_at, id) <= 15 UNION ALL
    SELECT id, 1, 'random' FROM tender QUALIFY row_number() OVER (ORDER BY md5('pilot:' || id)) <= 15 UNION ALL SELECT id, 2, 'value' FROM tender QUALIFY row_number() OVER (ORDER BY totalcost DESC NULLS LAST, id) <= 15)) WHERE k = 1"""))
def d51(spark, sf):
    return frozen_sample(tender(spark, sf), 15)


@register("D52_decision_lifecycle", """SELECT user_id, n_searches, CASE WHEN closed IS NOT NULL THEN 'closed' ELSE 'open' END AS state, CASE WHEN closed IS NOT NULL AND opened IS NOT NULL AND closed >= opened THEN CAST(floor(epoch(closed)) - floor(epoch(opened)) AS BIGINT) END AS seconds FROM
    (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS n_searches, min(ts) FILTER (WHERE event_type = 'view') AS opened, max(ts) FILTER (WHERE event_type = 'purchase') AS closed FROM events GROUP BY user_id)""")
def d52(spark, sf):
    """One row for each actor: opened by the first search, closed by the last purchase; an unmeasured start gives no duration."""
    when = lambda kind: F.when(F.col("event_type") == kind, F.col("ts"))
    g = raw(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("n_searches"), F.min(when("view")).alias("o"), F.max(when("purchase")).alias("c"))
    return g.select("user_id", "n_searches", F.when(F.col("c").isNotNull(), "closed").otherwise("open").alias("state"), F.when(F.col("c") >= F.col("o"), F.unix_timestamp("c") - F.unix_timestamp("o")).alias("seconds"))


def attached(products: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Codes for all products of a term that have none; a suggestion never replaces a code."""
    s = suggestions.select(F.col("term").alias("__t"), F.col("code").alias("__c"))
    j = products.join(s, fold("name") == F.col("__t"), "left")
    return j.select("product_id", F.coalesce("code", "__c").alias("code"), F.when(F.col("code").isNotNull(), "confirmed").when(F.col("__c").isNotNull(), "suggested").alias("origin"))


@register("D53_attach_codes", sql("product", "SELECT p.product_id, coalesce(p.code, s.code) AS code, CASE WHEN p.code IS NOT NULL THEN 'confirmed' WHEN s.code IS NOT NULL THEN 'suggested' END AS origin FROM product p LEFT JOIN (SELECT name, min(code) AS code FROM product WHERE code IS NOT NULL GROUP BY name) s ON p.name = s.name"))
def d53(spark, sf):
    p = product(spark, sf)
    s = p.where("code IS NOT NULL").groupBy(fold("name").alias("term")).agg(F.min("code").alias("code"))
    return attached(p, s)


# --- dossiers ---

MOST_COMPARED = 15


def compared(tenders: DataFrame, stock: DataFrame, documents: DataFrame, prices: DataFrame, most: int = MOST_COMPARED) -> DataFrame:
    """Up to `most` open tenders side by side, those that close first: what stock covers, what documents block, what the price leaves."""
    asked = tenders.where(is_open()).orderBy(F.asc_nulls_last("close_at"), "id").limit(most).select("id", F.col("totalcost").cast("double").alias("budget"))
    j = asked.join(stock.select(F.col("tender_id").alias("s_id"), "positions", "enough", "short", "unmatched", "preliminary"), F.col("id") == F.col("s_id"), "left").drop("s_id")
    j = j.join(documents.select(F.col("id").alias("d_id"), F.col("total").alias("documents"), "blocking", "asked"), F.col("id") == F.col("d_id"), "left").drop("d_id")
    return j.join(prices.select(F.col("id").alias("p_id"), "cost", "final", "margin", "left"), F.col("id") == F.col("p_id"), "left").drop("p_id")


@register("D40_compare_tenders", sql("tender", f"""SELECT a.id, budget, positions, enough, short, unmatched, preliminary, d.total AS documents, blocking, asked, cost, final, margin, "left" FROM (SELECT id, CAST(totalcost AS DOUBLE) AS budget FROM tender WHERE {OPEN_SQL} ORDER BY close_at NULLS LAST, id LIMIT {MOST_COMPARED}) a
    LEFT JOIN ({_SQL["D12b_stock_summary"]}) s ON s.tender_id = a.id LEFT JOIN ({_SQL["D15b_required_kinds"]}) d ON d.id = a.id LEFT JOIN ({_SQL["D10_pricing_steps"]}) p ON p.id = a.id"""))
def d40(spark, sf):
    """Only the goods and texts of the tenders asked for are read into the three parts."""
    t = tender(spark, sf)
    few = t.where(is_open()).orderBy(F.asc_nulls_last("close_at"), "id").limit(MOST_COMPARED).select("id")
    g = good(spark, sf).join(few, F.col("tender_id") == F.col("id"), "left_semi")
    own = product(spark, sf).where("company_id = 1")
    stock = stock_summary(stock_check(g, own), stocked(spark, sf, own), now())
    documents = summed(checked(spark, sf, few))
    cost = g.groupBy("tender_id").agg(F.sum("totalcost_item").cast("double").alias("cost"))
    prices = priced(t.select("id", F.col("totalcost").cast("double").alias("budget")).join(cost, F.col("id") == F.col("tender_id")), "cost", 3.0, 2.0, 15.0, 12.0, "budget")
    return compared(t, stock, documents, prices)


def dossier(parts: DataFrame, most: int) -> DataFrame:
    """A text for each key from its parts in order, cut to a size; what was cut is reported."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]), "\n")
    return parts.groupBy("id").agg(text.alias("t")).select("id", F.substring("t", 1, most).alias("text"), F.greatest(F.length("t") - most, F.lit(0)).alias("cut"))


@register("D42_dossier", sql("tender good", "SELECT id, left(t, 600) AS text, greatest(length(t) - 600, 0)::INTEGER AS cut FROM (SELECT id, string_agg(part, chr(10) ORDER BY ord, part) AS t FROM (SELECT id, 0 AS ord, title AS part FROM tender UNION ALL SELECT tender_id, 1, name FROM good WHERE tender_id IN (SELECT id FROM tender)) GROUP BY id)"))
def d42(spark, sf):
    t = tender(spark, sf)
    g = good(spark, sf).join(t.select("id"), F.col("tender_id") == F.col("id"), "left_semi")
    return dossier(t.select("id", F.lit(0).alias("ord"), F.col("title").alias("part")).union(g.select("tender_id", F.lit(1), "name")), 600)


@register("D45_progress", "SELECT count(*) AS before, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS after, count(*) > count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS moved FROM documents")
def d45(spark, sf):
    """A step's queue must have shrunk."""
    lab = raw(spark, sf, "labels").select("doc_id", F.lit(1).alias("done"))
    g = raw(spark, sf, "documents").select("doc_id").join(lab, "doc_id", "left").agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("done").isNull()).alias("after"))
    return g.withColumn("moved", F.col("before") > F.col("after"))


@register("D47_external_membership", sql("tender", "SELECT id, id IN (SELECT event_id FROM events WHERE event_type = 'purchase') AS in_erp FROM tender"))
def d47(spark, sf):
    e = raw(spark, sf, "events").where("event_type = 'purchase'").select("event_id").distinct().withColumn("x", F.lit(True))
    return tender(spark, sf).join(e, F.col("id") == F.col("event_id"), "left").select("id", F.coalesce("x", F.lit(False)).alias("in_erp"))
