"""The procurement model over the driver's tables: tenders, goods, catalogue products, chunks, runs.

Each table is a function of a session and a folder. `sql(...)` gives the same tables as
common table expressions in ANSI SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of all queries: results must not depend on when they run.
NOW = "1998-06-01 00:00:00"
#: Order priorities as currencies, order states as tender states, return flags as units.
CURRENCY = {"1-URGENT": "UZS", "2-HIGH": "USD", "3-MEDIUM": "EUR", "4-NOT SPECIFIED": "UZS", "5-LOW": "RUB"}
STATUS = {"O": "open", "F": "closed", "P": "cancelled"}
UNIT = {"A": "dona", "N": "kg", "R": "litr"}


def now():
    return F.lit(NOW).cast("timestamp")


def mapped(column: str, values: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def days(n):
    return F.make_dt_interval(n)


def tender(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = raw(spark, sf, "orders"), raw(spark, sf, "customer"), raw(spark, sf, "nation")
    key = F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        key.alias("id"),
        F.when(key % 3 == 0, "portal_b").otherwise("portal_a").alias("source_platform"),
        mapped("o_orderstatus", STATUS).alias("status"),
        F.when(key % 17 != 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("totalcost"),
        mapped("o_orderpriority", CURRENCY).alias("currency"),
        F.concat_ws(".", F.lit("33"), "n_regionkey", "n_nationkey").alias("area_path"),
        F.col("c_custkey").alias("buyer_id"), F.col("c_name").alias("buyer_name"),
        F.concat(F.lower("c_mktsegment"), F.lit(" supply "), (key % 97).cast("string")).alias("title"),
        F.col("o_orderdate").alias("published_at"),
        F.when(key % 11 != 0, F.col("o_orderdate") + days((key % 60 + 5).cast("int"))).alias("close_at"),
    )


def area(spark: SparkSession, sf: str) -> DataFrame:
    """Regions (level 1) and nations (level 2) as one hierarchy."""
    r, n = raw(spark, sf, "region"), raw(spark, sf, "nation")
    top = r.select(F.concat(F.lit("33."), F.col("r_regionkey").cast("string")).alias("area_id"), F.lit(1).alias("level"), F.col("r_name").alias("name"))
    return top.unionByName(n.select(F.concat_ws(".", F.lit("33"), "n_regionkey", "n_nationkey").alias("area_id"), F.lit(2).alias("level"), F.col("n_name").alias("name")))


def _code(p: DataFrame):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws(".", two(F.regexp_extract("p_brand", r"(\d+)$", 1)), two(p.p_size), two(p.p_partkey % 100))


def good(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Goods of all tenders, or `of` those given by their id: others are left out before they meet their parts."""
    li, p = raw(spark, sf, "lineitem"), raw(spark, sf, "part")
    if of is not None:
        li = li.join(of.select(F.col("id").alias("l_orderkey")), "l_orderkey", "left_semi")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("tender_id"), (F.col("l_linenumber") % 3 + 1).alias("lot_id"), F.col("l_linenumber").alias("good_no"), F.col("l_partkey").alias("part_id"),
        _code(p).alias("good_code"), F.col("p_name").alias("name"), F.lower("p_type").alias("category"), mapped("l_returnflag", UNIT).alias("unit"),
        F.col("l_quantity").cast("decimal(18,3)").alias("amount"), F.col("l_extendedprice").cast("decimal(18,2)").alias("totalcost_item"), F.col("l_shipdate").alias("shipped_at"),
    )


def product(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue products of five companies; a third of them have a confirmed code."""
    p = raw(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("product_id"), (k % 5).alias("company_id"), F.col("p_name").alias("name"), F.split("p_name", " ").alias("keywords"), F.lower("p_type").alias("category"),
        F.when(k % 13 != 0, (F.col("p_size") * 10).cast("decimal(18,3)")).alias("stock_qty"), F.when(k % 2 == 0, "dona").otherwise("kg").alias("unit"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("price"), F.when(k % 3 == 0, _code(p)).alias("code"),
    )


_SQL = {
    "tender": f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'portal_b' ELSE 'portal_a' END AS source_platform, {_case("o_orderstatus", STATUS)} AS status,
        CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS totalcost, {_case("o_orderpriority", CURRENCY)} AS currency,
        '33.' || n_regionkey || '.' || n_nationkey AS area_path, c_custkey AS buyer_id, c_name AS buyer_name, lower(c_mktsegment) || ' supply ' || (o_orderkey % 97) AS title, o_orderdate AS published_at,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 60 + 5 AS INTEGER)) END AS close_at
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "area": "SELECT '33.' || r_regionkey AS area_id, 1 AS level, r_name AS name FROM region UNION ALL SELECT '33.' || n_regionkey || '.' || n_nationkey, 2, n_name FROM nation",
    "good": f"""SELECT l_orderkey AS tender_id, l_linenumber % 3 + 1 AS lot_id, l_linenumber AS good_no, l_partkey AS part_id,
        lpad(regexp_extract(p_brand, '([0-9]+)$', 1), 2, '0') || '.' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS good_code, p_name AS name, lower(p_type) AS category, {_case("l_returnflag", UNIT)} AS unit,
        CAST(l_quantity AS DECIMAL(18,3)) AS amount, CAST(l_extendedprice AS DECIMAL(18,2)) AS totalcost_item, l_shipdate AS shipped_at FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "product": """SELECT p_partkey AS product_id, p_partkey % 5 AS company_id, p_name AS name, string_split(p_name, ' ') AS keywords, lower(p_type) AS category,
        CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_size * 10 AS DECIMAL(18,3)) END AS stock_qty, CASE WHEN p_partkey % 2 = 0 THEN 'dona' ELSE 'kg' END AS unit, CAST(p_retailprice AS DECIMAL(18,2)) AS price,
        CASE WHEN p_partkey % 3 = 0 THEN lpad(regexp_extract(p_brand, '([0-9]+)$', 1), 2, '0') || '.' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') END AS code FROM part""",
}


def sql(tables: str, body: str) -> str:
    """The oracle's query: the named tables (blank between) as CTEs, then the body; $now is the clock."""
    return "WITH " + ", ".join(f"{t} AS ({_SQL[t]})" for t in tables.split()) + "\n" + body.strip().replace("$now", f"TIMESTAMP '{NOW}'")
