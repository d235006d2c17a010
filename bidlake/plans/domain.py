"""The product's core (D1-D59): matching, pricing, stock, requirements, routing, retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.catalog import register
from bidlake.functions.scalars import category_of, over_distinct, round2, spellings
from bidlake.functions.text import fold, word_starts, words
from bidlake.operators.filters import in_region, is_open
from bidlake.operators.joins import fuse
from bidlake.operators.ordering import _QUERY, _QUERY_SQL, cosine_distance, ranked, top_per
from bidlake.plans.rewrites import code_prefix_join, patterns_in, terms_in
from bidlake.sources.procurement import good, now, product, raw, sql, tender

OPEN_SQL = "status = 'open' AND (close_at IS NULL OR close_at > $now)"

# --- D1-D9: matching ---

#: Most points of each part of a score.
POINTS = {"keywords": 60.0, "region": 20.0, "budget": 15.0, "currency": 5.0}


def score(keywords: list[str], regions: list[str], low: float | None, high: float | None, currency: str | None) -> Column:
    """A struct of a tender's points and reasons against a profile; of unset parts keywords give nothing, the others half their points."""
    text = fold(F.concat_ws(" ", "title", "goods"))
    hits = [word_starts(text, k).cast("int") for k in keywords]
    matched = reduce(lambda a, b: a + b, hits, F.lit(0))
    kw = POINTS["keywords"] * matched / len(keywords) if keywords else F.lit(0.0)
    region = F.when(in_region(F.col("area_path"), regions), POINTS["region"]).otherwise(0.0) if regions else F.lit(POINTS["region"] / 2)
    comparable = F.col("totalcost").isNotNull() & (F.coalesce(F.col("currency") == currency, F.lit(False)) if currency else F.lit(True))
    inside = (F.col("totalcost") >= (low or 0)) & (F.col("totalcost") <= (high if high is not None else 1e18))
    budget = F.when(comparable, F.when(inside, POINTS["budget"]).otherwise(0.0)).otherwise(POINTS["budget"] / 2) if low is not None or high is not None else F.lit(POINTS["budget"] / 2)
    cur = F.when(F.col("currency") == currency, POINTS["currency"]).otherwise(0.0) if currency else F.lit(POINTS["currency"] / 2)
    total = F.coalesce(kw, F.lit(0.0)) + region + budget + cur
    why = F.filter(F.array(F.when(matched > 0, F.concat(F.lit("keywords:"), matched.cast("string"))), F.when(region > 0, "region"), F.when(budget > POINTS["budget"] / 2, "budget")), lambda x: x.isNotNull())
    return F.struct(F.bround(total, 0).cast("int").alias("score"), F.array_join(why, ",").alias("reasons"))


def candidates(spark, sf, only: DataFrame | None = None) -> DataFrame:
    """Tenders with their goods' names in one text; of `only` these tenders, where it is given, and then no other goods are gathered."""
    t = tender(spark, sf) if only is None else only
    g = good(spark, sf, only).groupBy("tender_id").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("goods"))
    return t.join(g, t.id == g.tender_id, "left").drop("tender_id")


_CAND = "cand AS (SELECT t.*, g.goods FROM tender t LEFT JOIN (SELECT tender_id, string_agg(DISTINCT name, ' ' ORDER BY name) AS goods FROM good GROUP BY tender_id) g ON t.id = g.tender_id)"
_BLOB = "lower(title || coalesce(' ' || goods, ''))"
_HIT = lambda k: f"CASE WHEN regexp_matches({_BLOB}, '(^|[^\\p{{L}}\\p{{N}}_]){k}') THEN 1 ELSE 0 END"


def _score_sql(keywords: list[str], regions: list[str], low: float | None, high: float | None, currency: str | None) -> str:
    """The oracle's counterpart of score()."""
    hits = " + ".join(map(_HIT, keywords))
    inside = f"totalcost >= {low or 0} AND totalcost <= {high if high is not None else 1e18}"
    parts = [
        f"60.0::DOUBLE * ({hits}) / {len(keywords)}" if keywords else "0.0::DOUBLE",
        "CASE WHEN " + " OR ".join(f"area_path = '{r}' OR area_path LIKE '{r}.%'" for r in regions) + " THEN 20 ELSE 0 END" if regions else "10",
        f"CASE WHEN {f'currency = {currency!r} AND ' if currency else ''}totalcost IS NOT NULL THEN CASE WHEN {inside} THEN 15 ELSE 0 END ELSE 7.5 END" if low is not None or high is not None else "7.5",
        f"CASE WHEN currency = '{currency}' THEN 5 ELSE 0 END" if currency else "2.5",
    ]
    return "CAST(round_even(" + " + ".join(parts) + ", 0) AS INTEGER)"


@register("D1_score_tender", sql("tender good", f""", {_CAND}, m AS (SELECT *, {_HIT("anvil")} + {_HIT("bolt")} + {_HIT("plate")} AS k FROM cand WHERE {OPEN_SQL})
    SELECT id, {_score_sql(["anvil", "bolt", "plate"], ["33.1"], 50_000, 300_000, "USD")} AS score,
    concat_ws(',', CASE WHEN k > 0 THEN 'keywords:' || k END, CASE WHEN area_path LIKE '33.1.%' THEN 'region' END, CASE WHEN currency = 'USD' AND totalcost BETWEEN 50000 AND 300000 THEN 'budget' END) AS reasons FROM m"""))
def d1(spark, sf):
    s = score(["anvil", "bolt", "plate"], ["33.1"], 50_000, 300_000, "USD")
    return candidates(spark, sf).where(is_open()).withColumn("s", s).select("id", "s.score", "s.reasons")


@register("D2_product_matches", sql("good product", """SELECT p.product_id, count(DISTINCT g.tender_id) AS n FROM product p JOIN good g ON (p.code IS NOT NULL AND g.good_code LIKE substr(p.code, 1, 5) || '%') OR (p.code IS NULL AND contains(' ' || g.name || ' ', ' ' || p.name || ' ')) WHERE p.company_id = 4 GROUP BY p.product_id"""))
def d2(spark, sf):
    """A confirmed code decides alone; only products without one fall back to text. Tenders are counted once for each code and name, products come last."""
    p = product(spark, sf).where("company_id = 4").select("product_id", F.when(F.col("code").isNotNull(), F.substring("code", 1, 5)).alias("p5"), "name")
    g = good(spark, sf).select("tender_id", F.substring("good_code", 1, 5).alias("p5"), "name").distinct()
    coded = g.join(p.where("p5 IS NOT NULL").select("p5").distinct(), "p5", "left_semi").groupBy("p5").agg(F.countDistinct("tender_id").alias("n"))
    text = p.where("p5 IS NULL").select("product_id", F.col("name").alias("pattern"))
    names = patterns_in(g.select("name").distinct(), "name", text, "pattern")
    texts = g.select("tender_id", "name").distinct().join(names, "name").groupBy("pattern").agg(F.countDistinct("tender_id").alias("n"))
    return p.join(coded, "p5").select("product_id", "n").union(text.join(texts, "pattern").select("product_id", "n"))


@register("D3_candidates", sql("tender good", f", {_CAND} SELECT id, coalesce(goods, '') AS goods FROM cand"))
def d3(spark, sf):
    return candidates(spark, sf).select("id", F.coalesce("goods", F.lit("")).alias("goods"))


@register("D4_catalog_terms", sql("product", "SELECT term, n FROM (SELECT term, count(*) AS n FROM (SELECT unnest(keywords) AS term FROM product WHERE company_id = 1) WHERE length(term) BETWEEN 3 AND 25 GROUP BY term) ORDER BY n DESC, term LIMIT 400"))
def d4(spark, sf):
    t = product(spark, sf).where("company_id = 1").select(F.explode("keywords").alias("term")).where(F.length("term").between(3, 25))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(400)


def text_match(spark, sf, terms: DataFrame) -> DataFrame:
    """Tenders whose goods' names hold one of the terms, each distinct term and name compared once."""
    g = good(spark, sf)
    names = patterns_in(g.select("name").distinct(), "name", terms, "term").select("name").distinct()
    return g.join(names, "name", "left_semi").select(F.col("tender_id").alias("id")).distinct()


@register("D5_text_match", sql("good product tender", "SELECT DISTINCT tender_id AS id FROM good g WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT unnest(keywords) AS term FROM product WHERE company_id = 0 AND code IS NULL) x WHERE contains(' ' || g.name || ' ', ' ' || x.term || ' '))"))
def d5(spark, sf):
    return text_match(spark, sf, product(spark, sf).where("company_id = 0 AND code IS NULL").select(F.explode("keywords").alias("term")).distinct())


@register("D5b_text_match_all", sql("good product tender", "SELECT DISTINCT tender_id AS id FROM good g WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT unnest(keywords) AS term FROM product WHERE company_id = 0 AND code IS NULL) x WHERE contains(' ' || g.name || ' ', ' ' || x.term || ' '))"))
def d5b(spark, sf):
    """D5 under the name it had while D5 took a part of the products."""
    return d5(spark, sf)


@register("D6_catalog_match", sql("good product tender", f"""SELECT t.id, max(x.score) AS score, NOT bool_or(area_path LIKE '33.2.%') AS outside FROM tender t JOIN (
    SELECT tender_id, 100 AS score FROM good WHERE good_code IN (SELECT code FROM product WHERE company_id = 2 AND code IS NOT NULL)
    UNION ALL SELECT tender_id, 80 FROM good WHERE substr(good_code, 1, 5) IN (SELECT substr(code, 1, 5) FROM product WHERE company_id = 2 AND code IS NOT NULL)
    UNION ALL SELECT tender_id, 60 FROM good WHERE name IN (SELECT name FROM product WHERE company_id = 2 AND code IS NULL)) x ON x.tender_id = t.id WHERE {OPEN_SQL} GROUP BY t.id"""))
def d6(spark, sf):
    """Whole codes score 100, their groups 80, names 60; the best counts."""
    p, g = product(spark, sf).where("company_id = 2"), good(spark, sf)
    codes = p.where("code IS NOT NULL").select(F.explode(F.array(F.struct("code", F.lit(100).alias("score")), F.struct(F.substring("code", 1, 5).alias("code"), F.lit(80).alias("score")))).alias("x")).select("x.code", "x.score").distinct()
    by_code = g.select("tender_id", F.explode(F.array("good_code", F.substring("good_code", 1, 5))).alias("code")).join(codes, "code").select("tender_id", "score")
    by_name = g.join(p.where("code IS NULL").select("name").distinct(), "name", "left_semi").select("tender_id", F.lit(60).alias("score"))
    best = by_code.union(by_name).groupBy("tender_id").agg(F.max("score").alias("score"))
    return tender(spark, sf).where(is_open()).join(best, F.col("id") == F.col("tender_id")).select("id", "score", (~in_region(F.col("area_path"), ["33.2"])).alias("outside"))


#: Parameters of the query: a company's profile (keywords, regions, least and most budget, currency).
PROFILE = (["anvil", "bolt", "plate"], ["33.1"], 50_000, 300_000, "USD")


def catalogue_scores(goods: DataFrame, products: DataFrame) -> DataFrame:
    """tender_id, c: 100 where a good has a product's confirmed code, 60 where the name of a product without one stands in a good's name."""
    codes = products.where("code IS NOT NULL").select("code").distinct()
    coded = code_prefix_join(goods.select("tender_id", "good_code"), "good_code", codes, "code").select("tender_id", F.lit(100).alias("c"))
    names = patterns_in(goods.select("name").distinct(), "name", products.where("code IS NULL"), "name").select(goods["name"]).distinct()
    named = goods.join(names, "name", "left_semi").select("tender_id", F.lit(60).alias("c"))
    return coded.unionByName(named).groupBy("tender_id").agg(F.max("c").alias("c"))


@register("D8_new_candidates", sql("tender", f"SELECT id FROM tender WHERE {OPEN_SQL} AND published_at > $now - INTERVAL '180 days' AND id NOT IN (SELECT event_id FROM events WHERE event_type = 'view') ORDER BY close_at NULLS LAST, id LIMIT 50"))
def d8(spark, sf):
    sent = raw(spark, sf, "events").where("event_type = 'view'").select("event_id")
    t = tender(spark, sf).where(is_open() & (F.col("published_at") > now() - F.make_dt_interval(F.lit(180))))
    return t.join(sent, F.col("id") == F.col("event_id"), "left_anti").orderBy(F.asc_nulls_last("close_at"), "id").limit(50).select("id")


# --- D10-D15: pricing, stock, documents ---


def priced(df: DataFrame, cost: str, logistics_pct: float, risk_pct: float, markup_pct: float, vat_pct: float, budget: str) -> DataFrame:
    """Each step of a price, rounded by itself; what is left of the budget is null without one."""
    out = df.withColumn("logistics", round2(F.col(cost) * logistics_pct / 100)).withColumn("risk", round2(F.col(cost) * risk_pct / 100))
    out = out.withColumn("total", round2(F.col(cost) + F.col("logistics") + F.col("risk")))
    out = out.withColumn("ex_vat", round2(F.col("total") * (1 + markup_pct / 100))).withColumn("vat", round2(F.col("ex_vat") * vat_pct / 100))
    out = out.withColumn("final", round2(F.col("ex_vat") + F.col("vat"))).withColumn("profit", round2(F.col("ex_vat") - F.col("total")))
    out = out.withColumn("margin", F.when(F.col("ex_vat") != 0, round2(100 * F.col("profit") / F.col("ex_vat"))))
    return out.withColumn("left", round2(F.col(budget) - F.col("final")))


_R2 = lambda x: f"sign({x}) * floor(abs({x}) * 100 + 1e-9 + 0.5) / 100"


@register("D10_pricing_steps", sql("tender good", f"""SELECT id, cost, logistics, risk, total, ex_vat, vat, final, profit, CASE WHEN ex_vat <> 0 THEN {_R2("(100 * profit / ex_vat)")} END AS margin, {_R2("(budget - final)")} AS "left" FROM (SELECT *, {_R2("(ex_vat + vat)")} AS final, {_R2("(ex_vat - total)")} AS profit FROM (SELECT *, {_R2("(ex_vat * 12.0::DOUBLE / 100)")} AS vat FROM
    (SELECT *, {_R2("(total * (1 + 15.0::DOUBLE / 100))")} AS ex_vat FROM (SELECT *, {_R2("(cost + logistics + risk)")} AS total FROM (SELECT *, {_R2("(cost * 3.0::DOUBLE / 100)")} AS logistics, {_R2("(cost * 2.0::DOUBLE / 100)")} AS risk FROM (SELECT t.id, CAST(t.totalcost AS DOUBLE) AS budget, CAST(sum(g.totalcost_item) AS DOUBLE) AS cost FROM tender t JOIN good g ON g.tender_id = t.id GROUP BY ALL))))))"""))
def d10(spark, sf):
    cost = good(spark, sf).groupBy("tender_id").agg(F.sum("totalcost_item").cast("double").alias("cost"))
    t = tender(spark, sf).select("id", F.col("totalcost").cast("double").alias("budget")).join(cost, F.col("id") == F.col("tender_id"))
    return priced(t, "cost", 3.0, 2.0, 15.0, 12.0, "budget").select("id", "cost", "logistics", "risk", "total", "ex_vat", "vat", "final", "profit", "margin", "left")


#: Inputs of a price where nobody set any.
DEFAULT_INPUTS = {"markup_percent": 15.0, "risk_percent": 5.0, "logistics_percent": 3.0, "vat_percent": 12.0}


def price_inputs(tenders: DataFrame, settings: DataFrame, saved: DataFrame, override: DataFrame) -> DataFrame:
    """The inputs of each tender's price: what the request says, else the saved estimate, else the company's settings, else the defaults.

    Null says nothing at any level. The currency is the tender's unless an estimate or a request
    names another; the budget is always the tender's. tenders: id, company_id, currency, totalcost;
    settings: company_id and inputs; saved and override: id, inputs and currency.
    """
    fields = list(DEFAULT_INPUTS)
    level = lambda df, key, tag: df.select(F.col(key).alias(f"{tag}_key"), *[F.col(c).alias(f"{tag}_{c}") for c in [*fields, "currency"] if c in df.columns])
    j = tenders.join(level(settings, "company_id", "set"), F.col("company_id") == F.col("set_key"), "left")
    j = j.join(level(saved, "id", "sav"), F.col("id") == F.col("sav_key"), "left").join(level(override, "id", "ask"), F.col("id") == F.col("ask_key"), "left")
    return j.select("id", *[F.coalesce(f"ask_{c}", f"sav_{c}", f"set_{c}", F.lit(DEFAULT_INPUTS[c])).alias(c) for c in fields], F.coalesce("ask_currency", "sav_currency", "currency").alias("currency"), F.col("totalcost").cast("double").alias("budget"))


def _estimates(spark, sf, kind: str) -> DataFrame:
    """Saved or asked inputs by tender: an event of the kind is an estimate of the tender of its number."""
    e = raw(spark, sf, "events").where(F.col("event_type") == kind)
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").alias("id"), F.when(F.col("value") < 40, F.col("value")).alias("markup_percent"), F.when(k < 10, k.cast("double")).alias("risk_percent"), F.when(k > 90, k / 10).alias("logistics_percent"), F.lit(None).cast("double").alias("vat_percent"), F.when(k % 9 == 0, "UZS").alias("currency"))


_ESTIMATE = lambda kind: f"SELECT event_id AS id, CASE WHEN value < 40 THEN value END AS m, CASE WHEN k < 10 THEN k::DOUBLE END AS r, CASE WHEN k > 90 THEN k / 10.0::DOUBLE END AS l, CASE WHEN k % 9 = 0 THEN 'UZS' END AS cur FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE event_type = '{kind}'"
_SETTINGS = [(0, 20.0, None, None, 12.0), (1, 18.0, 4.0, 2.0, None), (2, None, None, None, 0.0), (3, 25.0, 10.0, 6.0, 15.0)]


@register("D11_input_precedence", sql("tender", f""", st AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join("NULL" if x is None else str(x) for x in r) + ")" for r in _SETTINGS)}) v(company_id, m, r, l, v)), sv AS ({_ESTIMATE("purchase")}), ak AS ({_ESTIMATE("click")})
    SELECT t.id, CAST(coalesce(ak.m, sv.m, st.m, 15) AS DOUBLE) AS markup_percent, CAST(coalesce(ak.r, sv.r, st.r, 5) AS DOUBLE) AS risk_percent, CAST(coalesce(ak.l, sv.l, st.l, 3) AS DOUBLE) AS logistics_percent, CAST(coalesce(st.v, 12) AS DOUBLE) AS vat_percent, coalesce(ak.cur, sv.cur, t.currency) AS currency, CAST(t.totalcost AS DOUBLE) AS budget
    FROM tender t LEFT JOIN st ON st.company_id = t.buyer_id % 5 LEFT JOIN sv ON sv.id = t.id LEFT JOIN ak ON ak.id = t.id"""))
def d11(spark, sf):
    settings = F.broadcast(spark.createDataFrame(_SETTINGS, "company_id long, markup_percent double, risk_percent double, logistics_percent double, vat_percent double"))
    t = tender(spark, sf).select("id", (F.col("buyer_id") % 5).alias("company_id"), "currency", "totalcost")
    return price_inputs(t, settings, _estimates(spark, sf, "purchase"), _estimates(spark, sf, "click"))


STALE_DAYS = 14


def matched_products(positions: DataFrame, products: DataFrame) -> DataFrame:
    """name, product_id: for each position's name the product with the longest term (name or keyword, in any spelling) that stands in it; of equals the smallest id."""
    more = F.coalesce("keywords", F.array().cast("array<string>")) if "keywords" in products.columns else F.array().cast("array<string>")
    terms = products.select("product_id", F.explode(F.concat(F.array("name"), more)).alias("term")).where("term <> ''").distinct()
    spelt = over_distinct(terms, "term", "spelt", spellings).withColumn("n", F.length("term")).withColumn("kw", F.explode("spelt")).withColumn("kw", F.array_join(words(F.col("kw")), " "))
    best = spelt.groupBy("kw").agg(F.max(F.struct("n", (-F.col("product_id")).alias("k"))).alias("b"))
    texts = positions.select("name").distinct().withColumn("t", F.array_join(words(F.col("name")), " "))
    found = terms_in(texts, "t", best, "kw").join(best, "kw").groupBy("t").agg(F.max("b").alias("b"))
    return texts.join(found, "t").select("name", (-F.col("b.k")).alias("product_id"))


def stock_check(positions: DataFrame, products: DataFrame) -> DataFrame:
    """Positions against the stock of the product that their name speaks of, one tender at a time, in order.

    A position takes what it needs from the pool; an unknown need or another unit leaves the
    pool as it is (a unit that isn't told differs from none); the first that finds too little takes what there is, and what follows finds
    nothing. Up to that first one the pool is the stock less a running sum, so windows will do. Positions without a product are unmatched.
    """
    p = products.select("product_id", F.col("unit").alias("stock_unit"), F.col("stock_qty").alias("stock"))
    j = positions.join(matched_products(positions, products), "name", "left").join(p, "product_id", "left")
    same = F.col("unit").isNull() | F.col("stock_unit").isNull() | (F.col("unit") == F.col("stock_unit"))
    counts = F.col("stock").isNotNull() & F.col("amount").isNotNull() & same
    order = Window.partitionBy("tender_id", "product_id").orderBy("lot_id", "good_no", "part_id")
    used = F.sum(F.when(counts, F.col("amount"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    j = j.withColumn("counts", counts).withColumn("used", used)
    over = F.coalesce(F.max((F.col("counts") & (F.col("used") > F.col("stock"))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    pool = F.when(over, F.lit(0)).otherwise(F.col("stock") - F.col("used") + F.col("amount"))
    j = j.withColumn("pool", pool)
    state = F.when(F.col("product_id").isNull(), "unmatched").when(F.col("stock").isNull(), "unknown_stock").when(F.col("amount").isNull(), "unknown_need").when(~F.col("counts"), "unit_differs").when(F.col("amount") <= F.col("pool"), "enough").otherwise("short")
    taken = F.when(F.col("counts"), F.least("amount", "pool")).otherwise(0)
    return j.select("tender_id", "product_id", "lot_id", "good_no", "part_id", F.col("amount").cast("double").alias("need"), taken.cast("double").alias("taken"), state.alias("state"))


def stock_summary(checked: DataFrame, products: DataFrame, at: Column) -> DataFrame:
    """A row a tender: positions by state, how old the oldest stock figure of its products is, and whether that makes the check preliminary.

    products: product_id, stock_qty, updated_at. No stock figure at all, none with a date, or one older than STALE_DAYS makes it so.
    """
    n = lambda *states: F.count_if(F.col("state").isin(*states))
    counts = checked.groupBy("tender_id").agg(F.count(F.lit(1)).alias("positions"), n("enough").alias("enough"), n("short").alias("short"), n("unknown_stock", "unknown_need", "unit_differs").alias("unknown"), n("unmatched").alias("unmatched"))
    used = checked.where("product_id IS NOT NULL").select("tender_id", "product_id").distinct().join(products.select("product_id", "stock_qty", "updated_at"), "product_id")
    age = used.groupBy("tender_id").agg(F.count(F.lit(1)).alias("products"), F.count("stock_qty").alias("known"), F.min("updated_at").alias("oldest"))
    j = counts.join(age, "tender_id", "left").withColumn("age_days", F.greatest(F.floor((F.unix_timestamp(at) - F.unix_timestamp("oldest")) / 86400), F.lit(0)))
    warning = F.when(F.coalesce("known", F.lit(0)) == 0, "no_stock").when(F.col("oldest").isNull(), "no_date").when(F.col("age_days") > STALE_DAYS, "stale")
    return j.select("tender_id", "positions", "enough", "short", "unknown", "unmatched", F.coalesce("products", F.lit(0)).alias("products"), "age_days", warning.alias("warning"), warning.isNotNull().alias("preliminary"))


_MATCHED_SQL = """, pr AS (SELECT product_id, name, stock_qty, unit, keywords FROM product WHERE company_id = 1), tm AS (SELECT product_id, unnest(list_distinct([name] || keywords)) AS term FROM pr),
    mp AS (SELECT DISTINCT ON (g_name) g_name, product_id FROM (SELECT DISTINCT name AS g_name FROM good) JOIN tm ON contains(' ' || g_name, ' ' || term) ORDER BY g_name, length(term) DESC, product_id),
    j AS (SELECT g.*, m.product_id, p.stock_qty AS stock, p.unit AS stock_unit, p.stock_qty IS NOT NULL AND (g.unit IS NULL OR p.unit IS NULL OR g.unit = p.unit) AS ok, row_number() OVER (PARTITION BY tender_id, m.product_id ORDER BY lot_id, good_no, part_id) AS rn FROM good g LEFT JOIN mp m ON g.name = m.g_name LEFT JOIN pr p ON p.product_id = m.product_id),
    c AS (SELECT a.*, coalesce((SELECT sum(b.amount) FROM j b WHERE b.tender_id = a.tender_id AND b.product_id = a.product_id AND b.ok AND b.rn < a.rn), 0) AS before FROM j a),
    ck AS (SELECT tender_id, product_id, lot_id, good_no, part_id, CAST(amount AS DOUBLE) AS need, CASE WHEN ok THEN CAST(least(amount, greatest(stock - before, 0)) AS DOUBLE) ELSE 0 END AS taken, CASE WHEN product_id IS NULL THEN 'unmatched' WHEN stock IS NULL THEN 'unknown_stock' WHEN NOT ok THEN 'unit_differs' WHEN amount <= greatest(stock - before, 0) THEN 'enough' ELSE 'short' END AS state FROM c)"""


@register("D12_stock_check", sql("good product", f"{_MATCHED_SQL} SELECT * FROM ck"))
def d12(spark, sf):
    return stock_check(good(spark, sf), product(spark, sf).where("company_id = 1"))


def stocked(spark, sf, products: DataFrame) -> DataFrame:
    """Products with the age of their stock figure: a figure is as old as the last shipment."""
    g = good(spark, sf).where(F.col("shipped_at") <= now())
    return products.join(g.groupBy(F.col("part_id").alias("product_id")).agg(F.max("shipped_at").cast("timestamp").alias("updated_at")), "product_id", "left")


@register("D12b_stock_summary", sql("good product", f"""{_MATCHED_SQL}, up AS (SELECT part_id AS product_id, max(shipped_at) AS updated_at FROM good WHERE shipped_at <= $now GROUP BY 1), ag AS (SELECT tender_id, count(*) AS products, count(stock_qty) AS known, min(updated_at) AS oldest FROM (SELECT DISTINCT tender_id, product_id FROM ck WHERE product_id IS NOT NULL) JOIN pr USING (product_id) LEFT JOIN up USING (product_id) GROUP BY tender_id),
    ct AS (SELECT tender_id, count(*) AS positions, count(*) FILTER (WHERE state = 'enough') AS enough, count(*) FILTER (WHERE state = 'short') AS short, count(*) FILTER (WHERE state IN ('unknown_stock', 'unit_differs')) AS unknown, count(*) FILTER (WHERE state = 'unmatched') AS unmatched FROM ck GROUP BY tender_id)
    SELECT tender_id, positions, enough, short, unknown, unmatched, coalesce(products, 0) AS products, age_days, warning, warning IS NOT NULL AS preliminary FROM (SELECT *, CASE WHEN coalesce(known, 0) = 0 THEN 'no_stock' WHEN oldest IS NULL THEN 'no_date' WHEN age_days > {STALE_DAYS} THEN 'stale' END AS warning FROM (SELECT *, greatest(floor(epoch($now - oldest) / 86400), 0)::BIGINT AS age_days FROM ct LEFT JOIN ag USING (tender_id)))"""))
def d12b(spark, sf):
    own = product(spark, sf).where("company_id = 1")
    return stock_summary(stock_check(good(spark, sf), own), stocked(spark, sf, own), now())


@register("D13_external_stock", sql("product", "SELECT product_id, CAST(CASE WHEN (SELECT count(*) FROM lineitem) > 0 THEN m.q ELSE stock_qty END AS DOUBLE) AS stock FROM product LEFT JOIN (SELECT l_partkey, sum(CAST(l_quantity AS DECIMAL(18,3))) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_partkey) m ON product_id = l_partkey"))
def d13(spark, sf):
    li = raw(spark, sf, "lineitem")
    q = li.where("l_linestatus = 'O'").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,3)")).alias("q"))
    used = li.limit(1).agg((F.count(F.lit(1)) > 0).alias("used"))
    return product(spark, sf).crossJoin(F.broadcast(used)).join(q, F.col("product_id") == F.col("l_partkey"), "left").select("product_id", F.when(F.col("used"), F.col("q")).otherwise(F.col("stock_qty")).cast("double").alias("stock"))


# --- D16-D25: requirements, qualification, routing ---


def merged_requirements(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by id: a person's verdict survives unless the value changed, which reopens it and notes old and new."""
    j = old.select("id", F.col("value").alias("ov"), "status").join(new.select("id", F.col("value").alias("nv")), "id", "full_outer")
    changed = F.col("ov").isNotNull() & F.col("nv").isNotNull() & ~F.col("ov").eqNullSafe(F.col("nv"))
    note = F.when(changed, F.concat_ws("->", F.col("ov").cast("string"), F.col("nv").cast("string")))
    return j.select("id", F.coalesce("nv", "ov").alias("value"), F.when(changed, "pending").otherwise(F.coalesce("status", F.lit("pending"))).alias("status"), note.alias("note"))


@register("D19_requirement_upsert", "SELECT coalesce(o.id, n.id) AS id, coalesce(n.value, o.value) AS value, CASE WHEN o.id IS NOT NULL AND n.id IS NOT NULL AND o.value <> n.value THEN 'pending' ELSE coalesce(o.status, 'pending') END AS status, CASE WHEN o.value <> n.value THEN o.value || '->' || n.value END AS note FROM (SELECT doc_id AS id, n_chars AS value, CASE WHEN doc_id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status FROM documents WHERE doc_id % 3 <> 0) o FULL OUTER JOIN (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS value FROM documents WHERE doc_id % 4 <> 0) n ON o.id = n.id")
def d19(spark, sf):
    d, k = raw(spark, sf, "documents"), F.col("doc_id")
    old = d.where(k % 3 != 0).select(k.alias("id"), F.col("n_chars").alias("value"), F.when(k % 2 == 0, "approved").otherwise("rejected").alias("status"))
    new = d.where(k % 4 != 0).select(k.alias("id"), F.when(k % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("value"))
    return merged_requirements(old, new)


@register("D20_pending_work", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR (l.quality = 0 AND d.n_chars > 500)")
def d20(spark, sf):
    j = raw(spark, sf, "documents").select("doc_id", "n_chars").join(raw(spark, sf, "labels"), "doc_id", "left")
    return j.where(F.col("quality").isNull() | ((F.col("quality") == 0) & (F.col("n_chars") > 500))).select("doc_id")


def qualification(t: DataFrame, at: Column, most: float, regions: list[str]) -> DataFrame:
    """Each tender's criteria and verdict at a time: any failure is no_go, three good ones without a risk are go, the rest is for review."""
    left = F.datediff("close_at", at.cast("date"))
    live = (F.col("status") == "open") & (F.col("close_at").isNull() | (F.col("close_at") > at))
    c = {
        "deadline": F.when(F.col("close_at").isNull(), "no_data").when(left < 3, "risk").otherwise("ok"), "open": F.when(live, "ok").otherwise("fail"),
        "region": F.when(in_region(F.col("area_path"), regions), "ok").otherwise("risk"), "value": F.when(F.col("totalcost").isNull(), "no_data").when(F.col("totalcost") > most, "risk").otherwise("ok"),
    }
    count = lambda s: reduce(lambda a, b: a + b, [(x == s).cast("int") for x in c.values()])
    t = t.select("id", "source_platform", *[x.alias(k) for k, x in c.items()], count("fail").alias("n_fail"), count("ok").alias("n_ok"), count("risk").alias("n_risk"))
    return t.withColumn("verdict", F.when(F.col("n_fail") > 0, "no_go").when((F.col("n_ok") >= 3) & (F.col("n_risk") == 0), "go").otherwise("review"))


def _qualification_sql(at: str, most: int) -> str:
    """The oracle's counterpart of qualification() in the regions 33.1 and 33.2."""
    parts = {"deadline": f"CASE WHEN close_at IS NULL THEN 'no_data' WHEN date_diff('day', {at}::DATE, close_at::DATE) < 3 THEN 'risk' ELSE 'ok' END", "open": f"CASE WHEN status = 'open' AND (close_at IS NULL OR close_at > {at}) THEN 'ok' ELSE 'fail' END", "region": "CASE WHEN area_path LIKE '33.1.%' OR area_path LIKE '33.2.%' THEN 'ok' ELSE 'risk' END", "value": f"CASE WHEN totalcost IS NULL THEN 'no_data' WHEN totalcost > {most} THEN 'risk' ELSE 'ok' END"}
    count = lambda s: " + ".join(f"(\"{k}\" = '{s}')::INT" for k in parts)
    inner = ", ".join(f'{x} AS "{k}"' for k, x in parts.items())
    return f"""SELECT *, CASE WHEN n_fail > 0 THEN 'no_go' WHEN n_ok >= 3 AND n_risk = 0 THEN 'go' ELSE 'review' END AS verdict FROM (SELECT *, {count("fail")} AS n_fail, {count("ok")} AS n_ok, {count("risk")} AS n_risk FROM (SELECT id, source_platform, {inner} FROM tender))"""


REGIONS, MOST, EARLIER, EARLIER_MOST = ["33.1", "33.2"], 400_000, "1998-04-01 00:00:00", 300_000


@register("D22_qualification", sql("tender", f"SELECT id, n_fail, n_ok, verdict FROM ({_qualification_sql('$now', MOST)})"))
def d22(spark, sf):
    return qualification(tender(spark, sf), now(), MOST, REGIONS).select("id", "n_fail", "n_ok", "verdict")


#: The criteria of a go/no-go answer, in their order.
CRITERIA = ["requirements", "activity", "certificates", "finances", "experience", "deadline", "region", "resources", "safety", "value", "profit"]


def normalized(answers: DataFrame) -> DataFrame:
    """Answers (id, decision, criteria: an array of key and status) as exactly the fixed criteria in their order.

    What an answer leaves out or doesn't know has no data, keys that are none go, of repeated
    keys the last counts; a decision that is none becomes review.
    """
    known = lambda s: F.when(s.isin("ok", "risk", "fail"), s).otherwise("no_data")
    last = lambda k: F.try_element_at(F.filter("criteria", lambda x: x["key"] == k), F.lit(-1))["status"]
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("criterion"), known(last(k)).alias("status")) for i, k in enumerate(CRITERIA)])
    decision = F.when(F.col("decision").isin("go", "review", "no_go"), F.col("decision")).otherwise("review")
    return answers.select("id", decision.alias("decision"), F.explode(rows).alias("x")).select("id", "decision", "x.*")


_GIVEN = {"deadline": "deadline", "region": "region", "value": "value", "open": "requirements"}


@register("D23_fixed_criteria", sql("tender good product", f""", q AS ({_qualification_sql('$now', MOST)}), a AS (SELECT DISTINCT tender_id FROM good WHERE name IN (SELECT name FROM product WHERE company_id = 1)),
    r AS (SELECT q.*, CASE WHEN a.tender_id IS NULL THEN 'risk' ELSE 'ok' END AS activity FROM q LEFT JOIN a ON a.tender_id = q.id),
    x AS (SELECT id, verdict, unnest({CRITERIA!r}) AS criterion, unnest(range({len(CRITERIA)})) AS pos, r.* EXCLUDE (id, verdict) FROM r)
    SELECT pos::INTEGER AS pos, criterion, status, decision, count(*) AS n FROM (SELECT pos, criterion, verdict AS decision, CASE criterion WHEN 'activity' THEN activity {" ".join(f"WHEN '{v}' THEN \"{k}\"" for k, v in _GIVEN.items())} ELSE 'no_data' END AS status FROM x) GROUP BY ALL"""))
def d23(spark, sf):
    """What is measured here answers five of the criteria, out of order; the others have no data."""
    named = product(spark, sf).where("company_id = 1").select("name").distinct()
    active = good(spark, sf).join(named, "name", "left_semi").select("tender_id").distinct()
    q = qualification(tender(spark, sf), now(), MOST, REGIONS).join(active, F.col("id") == F.col("tender_id"), "left")
    entry = lambda k, s: F.struct(F.lit(k).alias("key"), s.alias("status"))
    answers = q.select("id", F.col("verdict").alias("decision"), F.array(*[entry(v, F.col(k)) for k, v in _GIVEN.items()], entry("activity", F.when(F.col("tender_id").isNull(), "risk").otherwise("ok")), entry("unheard_of", F.lit("ok"))).alias("criteria"))
    return normalized(answers).groupBy("pos", "criterion", "status", "decision").agg(F.count(F.lit(1)).alias("n"))


def routed(old: DataFrame, new: DataFrame, people: DataFrame) -> DataFrame:
    """The rows a new routing writes: those whose verdict or score moved, or that are new.

    old and new: id, verdict, score (old also first_old); people: id, decision. A person's decision
    goes stale when the machine's verdict moves; the verdict it was made against is kept once.
    """
    o = old.select(F.col("id").alias("old_id"), F.col("verdict").alias("old_verdict"), F.col("score").alias("old_score"), "first_old")
    j = new.join(o, F.col("id") == F.col("old_id"), "left").join(people.select(F.col("id").alias("by_id"), F.col("decision").alias("person")), F.col("id") == F.col("by_id"), "left")
    moved = F.col("old_verdict").isNotNull() & (F.col("old_verdict") != F.col("verdict"))
    stale = moved & F.col("person").isNotNull()
    j = j.where(F.col("old_id").isNull() | moved | ~F.col("old_score").eqNullSafe(F.col("score")))
    return j.select("id", "verdict", "score", "person", stale.alias("stale"), F.coalesce("first_old", F.when(stale, F.col("old_verdict"))).alias("first_old"))


def _routing(q: DataFrame) -> DataFrame:
    measured = F.col("n_ok") + F.col("n_risk") + F.col("n_fail")
    return q.select("id", "source_platform", "verdict", F.when(measured > 0, F.round(100.0 * F.col("n_ok") / measured, 1)).alias("score"))


def _people(spark, sf) -> DataFrame:
    """People's decisions: a purchase or a click on a tender of the event's number takes it, an error turns it down."""
    e = raw(spark, sf, "events").where(F.col("event_type").isin("purchase", "click", "error"))
    return e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "no_go").otherwise("go").alias("decision"))


_ROUTING_SQL = "SELECT id, source_platform, verdict, CASE WHEN n_ok + n_risk + n_fail > 0 THEN round(100.0::DOUBLE * n_ok / (n_ok + n_risk + n_fail), 1) END AS score FROM ({})"
_PEOPLE_SQL = "SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'no_go' ELSE 'go' END AS decision FROM events WHERE event_type IN ('purchase', 'click', 'error')"


@register("D24_routing_upsert", sql("tender", f""", o AS ({_ROUTING_SQL.format(_qualification_sql("TIMESTAMP '" + EARLIER + "'", EARLIER_MOST))}), n AS ({_ROUTING_SQL.format(_qualification_sql('$now', MOST))}), p AS ({_PEOPLE_SQL})
    SELECT n.id, n.verdict, n.score, p.decision AS person, o.verdict <> n.verdict AND p.decision IS NOT NULL AS stale, CASE WHEN o.verdict <> n.verdict AND p.decision IS NOT NULL THEN o.verdict END AS first_old FROM n JOIN o ON o.id = n.id LEFT JOIN p ON p.id = n.id WHERE o.verdict <> n.verdict OR o.score IS DISTINCT FROM n.score"""))
def d24(spark, sf):
    """Two months on, with a higher limit of value, against the decisions that people made between."""
    t = tender(spark, sf)
    old = _routing(qualification(t, F.lit(EARLIER).cast("timestamp"), EARLIER_MOST, REGIONS)).withColumn("first_old", F.lit(None).cast("string"))
    return routed(old, _routing(qualification(t, now(), MOST, REGIONS)).drop("source_platform"), _people(spark, sf))


def agreement(decided: DataFrame, least: int = 10) -> DataFrame:
    """How often people followed the machine, by source and verdict; decided: source_platform, verdict, person.

    No percentage for review, where the machine decided nothing, nor under `least` decisions; why says so.
    """
    g = decided.groupBy("source_platform", "verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("person") == "go").alias("taken"), F.count_if(F.col("person") == "no_go").alias("refused"))
    why = F.when(F.col("verdict") == "review", "undecided").when(F.col("n") < least, "few")
    same = F.when(F.col("verdict") == "go", F.col("taken")).otherwise(F.col("refused"))
    return g.select("source_platform", "verdict", "n", "taken", "refused", F.when(why.isNull(), F.round(100.0 * same / F.col("n"), 1)).alias("pct"), why.alias("why"))


@register("D25_agreement_report", sql("tender", f""", n AS ({_qualification_sql('$now', MOST)}), p AS ({_PEOPLE_SQL}), g AS (SELECT source_platform, verdict, count(*) AS n, count(*) FILTER (WHERE decision = 'go') AS taken, count(*) FILTER (WHERE decision = 'no_go') AS refused FROM n JOIN p ON p.id = n.id GROUP BY ALL)
    SELECT *, CASE WHEN verdict <> 'review' AND n >= 10 THEN round(100.0::DOUBLE * CASE verdict WHEN 'go' THEN taken ELSE refused END / n, 1) END AS pct, CASE WHEN verdict = 'review' THEN 'undecided' WHEN n < 10 THEN 'few' END AS why FROM g"""))
def d25(spark, sf):
    q = qualification(tender(spark, sf), now(), MOST, REGIONS).select("id", "source_platform", "verdict")
    return agreement(q.join(_people(spark, sf).withColumnsRenamed({"id": "by_id", "decision": "person"}), F.col("id") == F.col("by_id")))


# --- D26-D43: codes and retrieval ---


def suggested_codes(goods: DataFrame, vectors: DataFrame, term: str, known: list[str], k: int = 60, cap: int = 50, top: int = 8) -> DataFrame:
    """Codes for a term: reciprocal ranks of how often goods of that name have a code and of how near its goods' vectors come to the term's.

    goods: part_id, code, name; vectors: part_id, v. The term's vector is the mean of those of the parts whose
    name holds it. Families (first two characters) of codes that the company has already get a
    further 1/(k+1), and evidence counts up to `cap` goods, a hundred-thousandth each.
    """
    lex = ranked(goods.where(F.col("name").contains(term)).groupBy("code").agg(F.count(F.lit(1)).alias("n")), cap, F.desc("n"), "code").withColumnRenamed("rn", "rnk")
    parts = goods.select("part_id", "code", "name").distinct()
    told = parts.where(F.col("name").contains(term)).select("part_id").distinct().join(vectors, "part_id")
    mean = told.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.avg(F.col("x").cast("double")).alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda y: y["m"]).alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    near = vectors.crossJoin(F.broadcast(mean)).where(F.size("q") > 0).select("part_id", (dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q"))).alias("s"))
    best = parts.select("part_id", "code").distinct().join(near, "part_id").groupBy("code").agg(F.round(F.max("s"), 7).alias("s"))
    sem = ranked(best, cap, F.desc("s"), "code").withColumnRenamed("rn", "rnk")
    j = fuse([lex, sem], "code", k).join(lex.select("code", "n"), "code", "left")
    prior = F.when(F.substring("code", 1, 2).isin(known), 1.0 / (k + 1)).otherwise(0.0)
    s = F.round(F.col("score") + prior + F.least(F.coalesce("n", F.lit(0)), F.lit(cap)) * 1e-5, 9)
    return j.select("code", s.alias("score")).orderBy(F.desc("score"), "code").limit(top)


@register("D26_code_suggestion", sql("good", """, lex AS (SELECT code, row_number() OVER (ORDER BY n DESC, code) AS rnk, n FROM (SELECT substr(good_code, 1, 5) AS code, count(*) AS n FROM good WHERE contains(name, 'bolt') GROUP BY 1) ORDER BY n DESC, code LIMIT 50),
    pc AS (SELECT DISTINCT part_id, substr(good_code, 1, 5) AS code, name FROM good), v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT list(m ORDER BY p) AS q FROM (SELECT p, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS p FROM v WHERE vec_id IN (SELECT part_id FROM pc WHERE contains(name, 'bolt'))) GROUP BY p)),
    sem AS (SELECT code, row_number() OVER (ORDER BY s DESC, code) AS rnk FROM (SELECT code, round(max(list_cosine_similarity(v, q)), 7) AS s FROM (SELECT DISTINCT part_id, code FROM pc) JOIN v ON vec_id = part_id CROSS JOIN q GROUP BY code) ORDER BY s DESC, code LIMIT 50)
    SELECT code, round(s, 9) AS score FROM (SELECT coalesce(l.code, e.code) AS code, coalesce(1.0::DOUBLE / (60 + l.rnk), 0) + coalesce(1.0::DOUBLE / (60 + e.rnk), 0) + CASE WHEN substr(coalesce(l.code, e.code), 1, 2) IN ('12', '34') THEN 1.0::DOUBLE / 61 ELSE 0 END + least(coalesce(l.n, 0), 50) * 1e-5 AS s FROM lex l FULL OUTER JOIN sem e ON l.code = e.code) ORDER BY round(s, 9) DESC, code LIMIT 8"""))
def d26(spark, sf):
    g = good(spark, sf).select("part_id", F.substring("good_code", 1, 5).alias("code"), "name")
    return suggested_codes(g, raw(spark, sf, "embeddings").select(F.col("vec_id").alias("part_id"), F.col("embedding").alias("v")), "bolt", ["12", "34"])


def centred(df: DataFrame, vec: str) -> DataFrame:
    """df with vectors minus their mean, unit length: the mean is one row of fixed width."""
    mean = df.select(F.posexplode(vec).alias("p", "v")).groupBy("p").agg(F.avg(F.col("v").cast("double")).alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("mean"))
    c = F.zip_with(F.col(vec), F.col("mean"), lambda a, b: a.cast("double") - b)
    out = df.crossJoin(F.broadcast(mean)).withColumn("c", c)
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    return out.withColumn("c", F.transform("c", lambda x: x / norm)).drop("mean")


@register("D27_centred_cosine", f"""WITH m AS (SELECT p, avg(v) AS m FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY p), c AS (SELECT list(m ORDER BY p) AS mean FROM m), q AS (SELECT {_QUERY_SQL} AS q)
    SELECT vec_id FROM (SELECT vec_id, round(list_cosine_similarity([embedding[i]::DOUBLE - mean[i] for i in range(1, 65)], q), 7) AS s FROM embeddings, c, q) ORDER BY s DESC, vec_id LIMIT 20""")
def d27(spark, sf):
    e = centred(raw(spark, sf, "embeddings"), "embedding").select("vec_id", F.round(1 - cosine_distance("c", _QUERY), 7).alias("s"))
    return e.orderBy(F.desc("s"), "vec_id").limit(20).select("vec_id")


@register("D31_business_value", sql("good tender", f"SELECT g.name, count(DISTINCT t.id) AS n_open, CAST(sum(g.totalcost_item) AS DOUBLE) AS value FROM good g JOIN tender t ON g.tender_id = t.id WHERE {OPEN_SQL} AND (contains(g.name, 'red') OR contains(g.name, 'blue')) GROUP BY g.name"))
def d31(spark, sf):
    t = tender(spark, sf).where(is_open()).select("id")
    g = good(spark, sf).where(F.col("name").contains("red") | F.col("name").contains("blue"))
    return g.join(t, g.tender_id == t.id).groupBy("name").agg(F.countDistinct("id").alias("n_open"), F.sum("totalcost_item").cast("double").alias("value"))


@register("D32_term_queue", sql("product", "SELECT lower(name) AS term, count(*) AS total, count(code) AS coded, count(*) FILTER (WHERE code IS NULL AND product_id % 2 = 0) AS suggested, count(*) FILTER (WHERE code IS NULL AND product_id % 2 = 1) AS waiting FROM product GROUP BY 1 HAVING count(*) > count(code)"))
def d32(spark, sf):
    none = F.col("code").isNull()
    g = product(spark, sf).groupBy(fold("name").alias("term")).agg(F.count(F.lit(1)).alias("total"), F.count("code").alias("coded"), F.count_if(none & (F.col("product_id") % 2 == 0)).alias("suggested"), F.count_if(none & (F.col("product_id") % 2 == 1)).alias("waiting"))
    return g.where("total > coded")


@register("D33_code_search", sql("good product", "SELECT code, layer FROM (SELECT DISTINCT good_code AS code, 'positions' AS layer FROM good WHERE contains(name, 'hot gear') UNION ALL SELECT DISTINCT code, 'dictionary' FROM product WHERE contains(name, 'gear') AND code IS NOT NULL AND code NOT IN (SELECT good_code FROM good WHERE contains(name, 'hot gear')))"))
def d33(spark, sf):
    first = good(spark, sf).where(F.col("name").contains("hot gear")).select(F.col("good_code").alias("code")).distinct()
    second = product(spark, sf).where(F.col("name").contains("gear") & F.col("code").isNotNull()).select("code").distinct().join(first, "code", "left_anti")
    return first.withColumn("layer", F.lit("positions")).unionByName(second.withColumn("layer", F.lit("dictionary")))


@register("D34_categorize", sql("good", "SELECT DISTINCT tender_id, CASE WHEN d BETWEEN 1 AND 5 THEN 'machines' WHEN d BETWEEN 5 AND 9 THEN 'services' WHEN d BETWEEN 10 AND 17 THEN 'materials' WHEN d BETWEEN 18 AND 25 THEN 'furniture' ELSE 'other' END AS category FROM (SELECT tender_id, CAST(substr(good_code, 1, 2) AS INTEGER) AS d FROM good)"))
def d34(spark, sf):
    return good(spark, sf).select("tender_id", category_of(F.col("good_code")).alias("category")).distinct()


@register("D38_reuse_by_hash", "SELECT doc_id, donor FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS donor FROM documents) WHERE doc_id <> donor")
def d38(spark, sf):
    """The first document of each text is the donor of all others."""
    d = raw(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    donors = d.groupBy("h").agg(F.min("doc_id").alias("donor"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return d.join(donors, "h").where("doc_id <> donor").select("doc_id", "donor")


@register("D38b_reuse_by_hash_all", "SELECT doc_id, donor FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS donor FROM documents) WHERE doc_id <> donor")
def d38b(spark, sf):
    """D38 under the name it had while D38 took donors and receivers from different halves."""
    return d38(spark, sf)


@register("D39_text_for_vectors", sql("good", "SELECT tender_id, left(string_agg(name, '; ' ORDER BY rn), 1200) AS txt FROM (SELECT tender_id, name, row_number() OVER (PARTITION BY tender_id ORDER BY totalcost_item DESC, good_no, part_id) AS rn FROM good) WHERE rn <= 40 GROUP BY tender_id"))
def d39(spark, sf):
    g = top_per(good(spark, sf), ["tender_id"], 40, F.desc("totalcost_item"), "good_no", "part_id")
    names = F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"])
    return g.groupBy("tender_id").agg(F.substring(F.array_join(names, "; "), 1, 1200).alias("txt"))


def retrieval_metrics(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per question: recall, precision, reciprocal rank and nDCG at k; null where nothing is relevant."""
    total = relevant.groupBy("q").agg(F.count(F.lit(1)).alias("total"))
    hit = found.where(F.col("rank") <= k).join(relevant.withColumn("rel", F.lit(1)), ["q", "id"], "left")
    gain = F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    g = hit.groupBy("q").agg(F.count("rel").alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    j = g.join(total, "q", "left")
    some = F.col("total").isNotNull()
    return j.select("q", F.when(some, F.round(F.col("hits") / F.col("total"), 6)).alias("recall"), F.when(some, F.round(F.col("hits") / F.lit(k), 6)).alias("precision"), F.when(some, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6)).alias("mrr"), F.when(some, F.round(F.col("dcg") / ideal, 6)).alias("ndcg"))


@register("D41_retrieval_metrics", """WITH f AS (SELECT label AS q, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings), r AS (SELECT label AS q, vec_id AS id FROM embeddings WHERE vec_id % 5 = 0 AND label <> 9), t AS (SELECT q, count(*) AS total FROM r GROUP BY q),
    g AS (SELECT f.q, count(r.id) AS hits, min(f.rank) FILTER (WHERE r.id IS NOT NULL) AS first, sum(CASE WHEN r.id IS NOT NULL THEN 1 / log2(f.rank + 1) ELSE 0 END) AS dcg FROM f LEFT JOIN r ON f.q = r.q AND f.id = r.id WHERE f.rank <= 8 GROUP BY f.q)
    SELECT q, CASE WHEN total IS NOT NULL THEN round(hits::DOUBLE / total, 6) END AS recall, CASE WHEN total IS NOT NULL THEN round(hits::DOUBLE / 8, 6) END AS precision, CASE WHEN total IS NOT NULL THEN round(coalesce(1.0::DOUBLE / first, 0), 6) END AS mrr, CASE WHEN total IS NOT NULL THEN round(dcg / list_sum([1 / log2(i + 1) for i in range(1, least(total, 8) + 1)]), 6) END AS ndcg FROM g LEFT JOIN t USING (q)""")
def d41(spark, sf):
    e = raw(spark, sf, "embeddings")
    found = e.select(F.col("label").alias("q"), F.col("vec_id").alias("id"), F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.get("embedding", F.lit(0))), "vec_id")).alias("rank"))
    return retrieval_metrics(found, e.where("vec_id % 5 = 0 AND label <> 9").select(F.col("label").alias("q"), F.col("vec_id").alias("id")), 8)


@register("D43_reanalysis_selection", sql("product", "SELECT product_id FROM product WHERE product_id % 10 = 0 OR (code IS NULL AND product_id % 4 = 1) OR stock_qty IS NULL ORDER BY product_id LIMIT 100"))
def d43(spark, sf):
    k = F.col("product_id")
    return product(spark, sf).where((k % 10 == 0) | (F.col("code").isNull() & (k % 4 == 1)) | F.col("stock_qty").isNull()).orderBy("product_id").limit(100).select("product_id")


@register("D44_expire_stale", sql("tender", "SELECT source_platform, CASE WHEN status = 'open' AND close_at <= $now AND source_platform IN ('portal_a') THEN 'expired' ELSE status END AS status, count(*) AS n FROM tender GROUP BY ALL"))
def d44(spark, sf):
    """Expired only where the source was read without failure."""
    fresh = spark.createDataFrame([("portal_a", True)], "source_platform string, ok boolean")
    t = tender(spark, sf).join(F.broadcast(fresh), "source_platform", "left")
    status = F.when(F.col("ok") & (F.col("status") == "open") & (F.col("close_at") <= now()), "expired").otherwise(F.col("status"))
    return t.groupBy("source_platform", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("D46_nested_document", sql("good", """SELECT tender_id, '[' || string_agg('{"lot":' || lot_id || ',"goods":[' || goods || ']}', ',' ORDER BY lot_id) || ']' AS lots FROM (SELECT tender_id, lot_id, string_agg('{"no":' || good_no || ',"name":"' || name || '"}', ',' ORDER BY good_no, name) AS goods FROM good GROUP BY tender_id, lot_id) GROUP BY tender_id"""))
def d46(spark, sf):
    lots = good(spark, sf).groupBy("tender_id", "lot_id").agg(F.array_sort(F.collect_list(F.struct(F.col("good_no").alias("no"), "name"))).alias("goods"))
    return lots.groupBy("tender_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("lot_id").alias("lot"), "goods")))).alias("lots"))


@register("D48_context_block", "SELECT source, string_agg(doc_id || ':' || quality, ' ' ORDER BY quality DESC, n_chars DESC, doc_id) AS block, max(total) - count(*) AS dropped FROM (SELECT d.source, d.doc_id, n_chars, quality, row_number() OVER (PARTITION BY source ORDER BY quality DESC, n_chars DESC, d.doc_id) AS rn, count(*) OVER (PARTITION BY source) AS total FROM documents d JOIN labels l ON d.doc_id = l.doc_id) WHERE rn <= 40 GROUP BY source")
def d48(spark, sf):
    d = raw(spark, sf, "documents").select("doc_id", "source", "n_chars").join(raw(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    total = d.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    top = top_per(d, ["source"], 40, F.desc("quality"), F.desc("n_chars"), "doc_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("quality").cast("string")).alias("s")))), lambda x: x["s"]), " ")
    return top.groupBy("source").agg(text.alias("block"), F.count(F.lit(1)).alias("kept")).join(total, "source").select("source", "block", (F.col("total") - F.col("kept")).alias("dropped"))


@register("D49_trusted", "SELECT d.doc_id, coalesce(l.quality = 1, false) AS by_person, n_chars % 100 >= 85 AS by_confidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 OR n_chars % 100 >= 85")
def d49(spark, sf):
    person, sure = F.coalesce(F.col("quality") == 1, F.lit(False)), F.col("n_chars") % 100 >= 85
    return raw(spark, sf, "documents").select("doc_id", "n_chars").join(raw(spark, sf, "labels"), "doc_id", "left").where(person | sure).select("doc_id", person.alias("by_person"), sure.alias("by_confidence"))


@register("D57_actor_sync", "SELECT coalesce(a.user_id, b.c_custkey) AS actor, CASE WHEN a.user_id IS NULL THEN 'not_seen' WHEN b.c_custkey IS NULL THEN 'unmapped' ELSE 'mapped' END AS state FROM (SELECT DISTINCT user_id FROM events) a FULL OUTER JOIN customer b ON a.user_id = b.c_custkey")
def d57(spark, sf):
    a = raw(spark, sf, "events").select("user_id").distinct()
    b = raw(spark, sf, "customer").select("c_custkey")
    state = F.when(F.col("user_id").isNull(), "not_seen").when(F.col("c_custkey").isNull(), "unmapped").otherwise("mapped")
    return a.join(b, a.user_id == b.c_custkey, "full_outer").select(F.coalesce("user_id", "c_custkey").alias("actor"), state.alias("state"))


