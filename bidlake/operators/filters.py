"""Projections, filters and predicates (F1-F19) as reusable Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.catalog import register
from bidlake.functions.text import contains_any, fold
from bidlake.sources.procurement import good, now, product, raw, sql, tender


def is_open(at: Column | None = None) -> Column:
    """Open: the status says so and the deadline hasn't passed; a missing deadline doesn't close."""
    at = now() if at is None else at
    return (F.col("status") == "open") & (F.col("close_at").isNull() | (F.col("close_at") > at))


def in_region(path: Column, regions: list[str]) -> Column:
    """A region itself or anything below it; the dot keeps 33.2 from matching 33.21."""
    return reduce(lambda a, b: a | b, [(path == r) | path.startswith(r + ".") for r in regions], F.lit(False))


def in_subtree(code: Column, root: str, sep: str = "/") -> Column:
    return (code == root) | code.startswith(root + sep)


def all_of(*conditions: Column | None) -> Column:
    """The conditions that are set, joined by AND; none of them is true."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def tender_filters(status: str | None = None, regions: list[str] | None = None, currency: str | None = None, source: str | None = None, at: Column | None = None) -> Column:
    """A facet list as one predicate; empty facets are left out."""
    state = None if status is None else is_open(at) if status == "open" else F.col("status") == status
    return all_of(state, in_region(F.col("area_path"), regions) if regions else None, F.col("currency") == currency if currency else None, F.col("source_platform") == source if source else None)


def closed_reason(at: Column | None = None) -> Column:
    at = now() if at is None else at
    return F.when(F.col("status") != "open", F.concat(F.lit("status:"), F.col("status"))).when(F.col("close_at") <= at, "deadline")


#: The divisions of services, and the words in names that tell a service.
SERVICE_DIVISIONS = [*range(5, 10)]
SERVICE_WORDS = r"gizmo|gear"


def is_service(code: Column, name: Column) -> Column:
    """By division where the code has the shape NN., or by name; never null."""
    shaped = code.rlike(r"^\d{2}\.")
    return F.coalesce(shaped & F.substring(code, 1, 2).cast("int").isin(SERVICE_DIVISIONS), F.lit(False)) | F.coalesce(name.rlike(SERVICE_WORDS), F.lit(False))


SORTS = {"close_at": "close_at", "totalcost": "totalcost", "published_at": "published_at", "id": "id"}


def order_by(sort: str | None) -> list[Column]:
    """A whitelisted sort, `-` in front for descending; nulls last, id breaks ties, sums sort within their currency."""
    name, down = (sort or "-published_at").lstrip("-"), (sort or "-published_at").startswith("-")
    col = F.col(SORTS.get(name, "published_at"))
    first = [F.col("currency").asc_nulls_last()] if name == "totalcost" else []
    return [*first, col.desc_nulls_last() if down else col.asc_nulls_last(), F.col("id").desc()]


SELECTED = ["id", "status", "currency", "area_path"]


@register("F1_facet_filter", sql("tender", "SELECT id, status, currency, area_path FROM tender WHERE status = 'open' AND (close_at IS NULL OR close_at > $now) AND (area_path = '33.1' OR area_path LIKE '33.1.%' OR area_path = '33.2' OR area_path LIKE '33.2.%') AND currency = 'UZS' AND source_platform = 'portal_a'"))
def f1(spark, sf):
    return tender(spark, sf).where(tender_filters("open", ["33.1", "33.2"], "UZS", "portal_a")).select(*SELECTED)


@register("F2_open_predicate", sql("tender", "SELECT status, count(*) AS n, count(*) FILTER (WHERE status = 'open' AND (close_at IS NULL OR close_at > $now)) AS n_open FROM tender GROUP BY status"))
def f2(spark, sf):
    return tender(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_open()).alias("n_open"))


@register("F3_region_prefix", sql("tender", "SELECT area_path, count(*) AS n FROM tender WHERE area_path = '33.0.2' OR area_path LIKE '33.0.2.%' OR area_path = '33.3' OR area_path LIKE '33.3.%' GROUP BY area_path"))
def f3(spark, sf):
    return tender(spark, sf).where(in_region(F.col("area_path"), ["33.0.2", "33.3"])).groupBy("area_path").agg(F.count(F.lit(1)).alias("n"))


@register("F4_category_subtree", sql("tender good", "SELECT id FROM tender WHERE id IN (SELECT tender_id FROM good WHERE replace(good_code, '.', '/') = '07' OR replace(good_code, '.', '/') LIKE '07/%')"))
def f4(spark, sf):
    g = good(spark, sf).where(in_subtree(F.translate("good_code", ".", "/"), "07"))
    return tender(spark, sf).join(g, F.col("id") == g.tender_id, "left_semi").select("id")


@register("F5_product_exists", sql("tender good", "SELECT id FROM tender t WHERE EXISTS (SELECT 1 FROM good g WHERE g.tender_id = t.id AND (contains(lower(g.name), 'red bolt') OR contains(lower(g.name), 'anvil'))) AND currency = 'USD'"))
def f5(spark, sf):
    g = good(spark, sf).where(contains_any(fold("name"), ["red bolt", "anvil"]))
    return tender(spark, sf).where("currency = 'USD'").join(g, F.col("id") == g.tender_id, "left_semi").select("id")


@register("F6_free_text", sql("tender good", "SELECT id FROM tender t WHERE contains(lower(title), 'machinery') OR contains(lower(buyer_name), '#000000012') OR EXISTS (SELECT 1 FROM good g WHERE g.tender_id = t.id AND contains(lower(g.name), 'old plate'))"))
def f6(spark, sf):
    t, g = tender(spark, sf), good(spark, sf)
    own = t.where(contains_any(fold("title"), ["machinery"]) | contains_any(fold("buyer_name"), ["#000000012"])).select("id")
    by_good = g.where(contains_any(fold("name"), ["old plate"])).select(F.col("tender_id").alias("id"))
    return t.join(own.union(by_good), "id", "left_semi").select("id")


@register("F7_json_values_text", "SELECT event_id, concat_ws(' ', event_type, json_extract_string(props, '$.k'), json_extract_string(props, '$.missing')) AS txt FROM events")
def f7(spark, sf):
    return raw(spark, sf, "events").select("event_id", F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k"), F.get_json_object("props", "$.missing")).alias("txt"))


@register("F8_like_escape", sql("product", "SELECT product_id, name FROM product WHERE name LIKE '%d r%' OR name LIKE '%50\\%%' ESCAPE '\\'"))
def f8(spark, sf):
    return product(spark, sf).where(contains_any(F.col("name"), ["d r", "50%"])).select("product_id", "name")


@register("F9_service_classifier", sql("product", "SELECT coalesce(CAST(substr(code, 1, 2) AS INTEGER) BETWEEN 5 AND 9, false) OR regexp_matches(name, 'gizmo|gear') AS service, count(*) AS n FROM product GROUP BY 1"))
def f9(spark, sf):
    return product(spark, sf).groupBy(is_service(F.col("code"), F.col("name")).alias("service")).agg(F.count(F.lit(1)).alias("n"))


@register("F10_goods_lot", sql("good product", """SELECT g.tender_id, g.good_no, d.code IS NOT NULL AND NOT regexp_matches(d.name, 'gizmo|gear') AND NOT regexp_matches(g.name, 'gizmo|gear') AS is_goods
    FROM good g LEFT JOIN (SELECT code, max(name) AS name FROM product WHERE code IS NOT NULL GROUP BY code) d ON g.good_code = d.code"""))
def f10(spark, sf):
    d = product(spark, sf).where("code IS NOT NULL").groupBy("code").agg(F.max("name").alias("d_name"))
    g = good(spark, sf)
    j = g.join(d, g.good_code == d.code, "left")
    ok = F.col("code").isNotNull() & ~F.col("d_name").rlike(SERVICE_WORDS) & ~F.col("name").rlike(SERVICE_WORDS)
    return j.select("tender_id", "good_no", F.coalesce(ok, F.lit(False)).alias("is_goods"))


@register("F11_sort_whitelist", sql("tender", "SELECT id, currency, CAST(totalcost AS DOUBLE) AS totalcost FROM tender ORDER BY currency NULLS LAST, totalcost DESC NULLS LAST, id DESC LIMIT 100"))
def f11(spark, sf):
    return tender(spark, sf).orderBy(*order_by("-totalcost")).limit(100).select("id", "currency", F.col("totalcost").cast("double"))


@register("F12_closed_reason", sql("tender", "SELECT coalesce(CASE WHEN status <> 'open' THEN 'status:' || status WHEN close_at <= $now THEN 'deadline' END, 'none') AS reason, count(*) AS n FROM tender GROUP BY 1"))
def f12(spark, sf):
    return tender(spark, sf).groupBy(F.coalesce(closed_reason(), F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register("F13_optional_parameters", sql("tender", "SELECT count(*) AS n FROM tender WHERE currency = 'EUR'"))
def f13(spark, sf):
    return tender(spark, sf).where(tender_filters(currency="EUR")).agg(F.count(F.lit(1)).alias("n"))


@register("F14_routing_queue_filter", sql("tender", "SELECT id, CASE WHEN id % 4 = 0 THEN 'go' WHEN id % 4 = 1 THEN 'no_go' ELSE 'review' END AS decision, id % 5 = 0 AS stale FROM tender WHERE id % 4 = 0 AND id % 5 = 0 AND (area_path = '33.4' OR area_path LIKE '33.4.%')"))
def f14(spark, sf):
    t = tender(spark, sf).withColumn("decision", F.when(F.col("id") % 4 == 0, "go").when(F.col("id") % 4 == 1, "no_go").otherwise("review")).withColumn("stale", F.col("id") % 5 == 0)
    return t.where(all_of(F.col("decision") == "go", F.col("stale"), in_region(F.col("area_path"), ["33.4"]))).select("id", "decision", "stale")


@register("F15_review_queue_filter", "SELECT doc_id, quality, toxic FROM labels WHERE quality = 0 AND toxic = 0 AND doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 500 AND source IN ('src1', 'src2', 'src3'))")
def f15(spark, sf):
    d = raw(spark, sf, "documents").where((F.col("n_chars") > 500) & F.col("source").isin("src1", "src2", "src3"))
    return raw(spark, sf, "labels").where("quality = 0 AND toxic = 0").join(d, "doc_id", "left_semi").select("doc_id", "quality", "toxic")


@register("F16_projection_defaults", sql("tender area", "SELECT t.id, coalesce(a.name, t.area_path) AS region, coalesce(t.currency, '?') AS currency FROM tender t LEFT JOIN area a ON t.area_path = a.area_id"))
def f16(spark, sf):
    from bidlake.sources.procurement import area

    a = area(spark, sf)
    return tender(spark, sf).join(F.broadcast(a), F.col("area_path") == a.area_id, "left").select("id", F.coalesce("name", "area_path").alias("region"), F.coalesce("currency", F.lit("?")).alias("currency"))


def resolve_id(df: DataFrame, ref: int, id_col: str, source_col: str) -> DataFrame:
    """Rows whose id or source id is ref, the id first, three at most."""
    return df.where((F.col(id_col) == ref) | (F.col(source_col) == ref)).orderBy((F.col(id_col) == ref).desc(), F.col(id_col)).limit(3)


@register("F17_point_lookup", sql("tender", "SELECT id, buyer_id FROM tender WHERE id = 40 OR buyer_id = 40 ORDER BY id = 40 DESC, id LIMIT 3"))
def f17(spark, sf):
    return resolve_id(tender(spark, sf), 40, "id", "buyer_id").select("id", "buyer_id")


def of_company(df: DataFrame, company_id: int) -> DataFrame:
    """The rows of one tenant; private tables are read through this only."""
    return df.where(F.col("company_id") == company_id)


@register("F18_tenant_predicate", sql("product", "SELECT company_id, count(*) AS n, count(code) AS coded FROM product WHERE company_id = 3 GROUP BY company_id"))
def f18(spark, sf):
    return of_company(product(spark, sf), 3).groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.count("code").alias("coded"))


@register("F19_retry_eligible", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR (l.quality = 0 AND d.n_chars % 7 <= 3)")
def f19(spark, sf):
    d, lab = raw(spark, sf, "documents"), raw(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").where(F.col("quality").isNull() | ((F.col("quality") == 0) & (F.col("n_chars") % 7 <= 3))).select("doc_id")
