"""Sources and sinks (S1-S20): nested records into tables, files into text, merges into stores."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidlake.catalog import register
from bidlake.session import ship
from bidlake.sources.procurement import good, product, raw, sql, tender

# --- S1-S8: portal records ---

PORTAL_A = """id long, type string, name string, status string, totalcost decimal(18,2), currency string, area string, company_id long, company_name string, publicated_at string, close_at string, remain_time int,
 meta struct<lots: array<struct<lot_id:int,item_count:int,total_sum_lot:decimal(18,2)>>, good_maps: array<struct<lot_id:int,id:string,name:string,unit:string,amount:decimal(18,3),price:decimal(18,2),totalcost_item:decimal(18,2),category:struct<uid:string,code:string,title:string>>>>"""
SECOND_SOURCE_OFFSET = 20_000_000_000


def latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row for each key, the last in the order: pages shift while they are read, so ids repeat."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def read_portal(spark: SparkSession, path: str, schema: str = PORTAL_A) -> DataFrame:
    """JSON lines of a portal, the last page's record of each id."""
    pages = spark.read.schema(schema).json(path).withColumn("__file", F.input_file_name())
    return latest(pages, ["id"], F.desc("__file")).drop("__file")


def flatten_portal(records: DataFrame) -> dict[str, DataFrame]:
    """The tables of nested records: tenders, lots, goods, categories."""
    goods = records.select(F.col("id").alias("tender_id"), F.explode("meta.good_maps").alias("g"))
    return {
        "tenders": records.drop("meta"),
        "lots": records.select(F.col("id").alias("tender_id"), F.explode("meta.lots").alias("l")).select("tender_id", "l.*"),
        "goods": latest(goods.select("tender_id", "g.lot_id", F.col("g.id").alias("good_code"), "g.name", "g.unit", "g.amount", "g.price", "g.totalcost_item"), ["tender_id", "lot_id", "good_code"], F.desc_nulls_last("totalcost_item")),
        "categories": goods.where("g.category.code IS NOT NULL").select("tender_id", "g.category.code", "g.category.title").distinct(),
    }


@register("S1_paged_latest", "SELECT buyer, orderkey FROM (SELECT o_custkey AS buyer, o_orderkey AS orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 10 DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def s1(spark, sf):
    o = raw(spark, sf, "orders").select(F.col("o_custkey").alias("buyer"), F.col("o_orderkey").alias("orderkey"))
    return latest(o, ["buyer"], (F.col("orderkey") % 10).desc(), F.desc("orderkey"))


#: A list record of the second portal.
PORTAL_B = "id long, name string, start_date string, end_date string, cost decimal(18,2), currency_codeabc string, seller_id long, seller_name string, region_name string"


def range_pages(records: DataFrame, id_col: str, size: int) -> DataFrame:
    """The pages a From/To source answers with: both ends count, so a page's last record is the next one's first."""
    k = F.floor(F.col(id_col) / size)
    return records.withColumn("page", F.explode(F.when((F.col(id_col) % size == 0) & (k > 0), F.array(k - 1, k)).otherwise(F.array(k))))


@register("S2_range_pages", "SELECT o_orderkey AS id, o_orderkey // 50 AS page, c_name AS seller_name, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS cost, CAST(o_orderdate AS DATE) AS start_date FROM orders JOIN customer ON o_custkey = c_custkey")
def s2(spark, sf):
    """The second portal's list: JSON records by its own schema, read in overlapping ranges, the last answer of each id."""
    o, c = raw(spark, sf, "orders"), raw(spark, sf, "customer")
    sent = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("k"), F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("start_date"), F.col("o_totalprice").cast("decimal(18,2)").alias("cost"), F.col("c_custkey").alias("seller_id"), F.col("c_name").alias("seller_name"))).alias("body"))
    pages = range_pages(sent, "k", 50).select("page", F.from_json("body", PORTAL_B).alias("r")).select("page", "r.*")
    return latest(pages, ["id"], F.desc("page")).select("id", "page", "seller_name", F.col("cost").cast("double").alias("cost"), F.to_date("start_date", "dd.MM.yyyy").alias("start_date"))


@register("S3_json_in_string", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def s3(spark, sf):
    return raw(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@register("S4_area_tree", "SELECT 'r' || r_regionkey AS node, NULL AS parent, 0 AS level FROM region UNION ALL SELECT 'r' || n_regionkey || '.n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation UNION ALL SELECT 'r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey, 'r' || n_regionkey || '.n' || n_nationkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey")
def s4(spark, sf):
    """A tree of three levels from its path strings: the level is the number of dots, the parent the path without its last step."""
    n, c = raw(spark, sf, "nation"), raw(spark, sf, "customer")
    step = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    top = raw(spark, sf, "region").select(step("r", "r_regionkey").alias("node"))
    mid = n.select(F.concat_ws(".", step("r", "n_regionkey"), step("n", "n_nationkey")).alias("node"))
    low = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.concat_ws(".", step("r", "n_regionkey"), step("n", "n_nationkey"), step("c", "c_custkey")).alias("node"))
    cut = F.regexp_extract("node", r"^(.*)\.[^.]+$", 1)
    return top.union(mid).union(low).select("node", F.when(cut != "", cut).alias("parent"), (F.size(F.split("node", r"\.")) - 1).alias("level"))


def nested(spark, sf) -> DataFrame:
    """Tenders with their goods as nested records, as a portal would send them."""
    g = good(spark, sf).groupBy("tender_id").agg(F.collect_list(F.struct("lot_id", "good_no", "good_code", "name", "amount", "category")).alias("good_maps"))
    return tender(spark, sf).join(g, F.col("id") == F.col("tender_id")).select("id", F.to_json(F.struct("good_maps")).alias("meta"))


@register("S5_flatten_record", sql("good", "SELECT tender_id, lot_id, good_no, good_code, CAST(amount AS DOUBLE) AS amount FROM good"))
def s5(spark, sf):
    maps = F.from_json("meta", "good_maps array<struct<lot_id:int,good_no:int,good_code:string,name:string,amount:decimal(18,3),category:string>>")["good_maps"]
    return nested(spark, sf).select(F.col("id").alias("tender_id"), F.explode(maps).alias("g")).select("tender_id", "g.lot_id", "g.good_no", "g.good_code", F.col("g.amount").cast("double").alias("amount"))


@register("S5b_record_categories", sql("good", "SELECT DISTINCT tender_id, category FROM good"))
def s5b(spark, sf):
    maps = F.from_json("meta", "good_maps array<struct<category:string>>")["good_maps"]
    return nested(spark, sf).select(F.col("id").alias("tender_id"), F.explode(maps).alias("g")).select("tender_id", "g.category").distinct()


@register("S6_second_source", sql("tender", "SELECT id + 20000000000 AS id, id AS source_id, 'open' AS status, 'portal_b' AS source_platform FROM tender WHERE source_platform = 'portal_b'"))
def s6(spark, sf):
    return tender(spark, sf).where("source_platform = 'portal_b'").select((F.col("id") + SECOND_SOURCE_OFFSET).alias("id"), F.col("id").alias("source_id"), F.lit("open").alias("status"), "source_platform")


@register("S7_find_files", "SELECT page_id, regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)[1] AS first_link, len(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS n_links FROM pages")
def s7(spark, sf):
    links = F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))
    return raw(spark, sf, "pages").select("page_id", F.get(links, 0).alias("first_link"), F.size(links).cast("long").alias("n_links"))


@register("S8_item_unwrap", "SELECT event_id, coalesce(CAST(regexp_extract('about ' || json_extract_string(props, '$.k') || ' pcs', '-?[0-9]+') AS INTEGER), 0) AS amount FROM events")
def s8(spark, sf):
    text = F.concat(F.lit("about "), F.get_json_object("props", "$.k"), F.lit(" pcs"))
    return raw(spark, sf, "events").select("event_id", F.coalesce(F.regexp_extract(text, r"(-?\d+)", 1).try_cast("int"), F.lit(0)).alias("amount"))


# --- S9-S11: files ---

#: First bytes of file formats.
MAGIC = {b"%PDF-": "pdf", b"PK\x03\x04": "zip", b"\xd0\xcf\x11\xe0": "ole", b"\x1f\x8b": "gz", b"{\\rtf": "rtf"}


def sniff(content: Column, name: Column, content_type: Column) -> Column:
    """Format by first bytes, else by extension, else by content type."""
    out = F.lit(None).cast("string")
    for k, v in MAGIC.items():
        out = F.when(F.substring(content, 1, len(k)) == F.lit(k), v).otherwise(out)
    ext = F.nullif(F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]{1,5})$", 1)), F.lit(""))
    return F.coalesce(out, ext, F.when(content_type.contains("html"), "html").when(content_type.contains("csv"), "csv"), F.lit("bin"))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "title"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def html_text(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    p.close()
    return re.sub(r"\s*\n\s*", "\n", "".join(p.out)).strip()


def _xml_text(data: bytes) -> str:
    return re.sub(r"[ \t]+", " ", re.sub(r"<[^>]+>", " ", re.sub(r"</w:p>|</row>", "\n", data.decode("utf-8", "replace")))).strip()


MEMBERS, MEMBER_BYTES = 40, 20 << 20


def file_text(content: bytes | None, kind: str, depth: int = 1) -> str:
    """Text of a file's bytes by kind; archives one level deep, at most 40 members."""
    if not content:
        return ""
    if kind in ("html", "htm", "xml"):
        return html_text(content.decode("utf-8", "replace"))
    if kind in ("txt", "csv"):
        for enc in ("utf-8-sig", "cp1251"):
            try:
                return content.decode(enc)
            except UnicodeDecodeError:
                pass
        return content.decode("latin-1")
    if kind in ("zip", "docx", "xlsx") and content[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            own = [n for n in names if n == "word/document.xml" or n == "xl/sharedStrings.xml"]
            if own:
                return "\n".join(_xml_text(z.read(n)) for n in own)
            parts = []
            for info in z.infolist()[:MEMBERS]:
                if depth and not info.is_dir() and info.file_size <= MEMBER_BYTES:
                    parts.append(file_text(z.read(info), info.filename.rpartition(".")[2].lower(), depth - 1))
            return "\n".join(p for p in parts if p)
    if kind == "ole":
        # two guesses at the text of an old binary file; the one with more letters wins
        guesses = [content.decode("utf-16-le", "ignore"), content.decode("cp1251", "ignore")]
        return max((" ".join(re.findall(r"[\w .,;:-]{4,}", g)) for g in guesses), key=lambda g: sum(c.isalpha() for c in g))
    return ""


def outcome(text: Column, kind: Column, size: Column, least_chars: int = 20, least_letters: int = 10, most: int = 50 << 20) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(size > most, "too_large").when(~kind.isin("html", "htm", "xml", "txt", "csv", "zip", "docx", "xlsx", "ole"), "unsupported").when((F.length(text) < least_chars) | (letters < least_letters), "unreadable").otherwise("ok")


def extracted(files: DataFrame) -> DataFrame:
    """path, kind, text and state of files (path, content, length), read by Spark's binaryFile source."""

    @F.pandas_udf("string")
    def text(content: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([file_text(bytes(c) if c is not None else None, k) for c, k in zip(content, kind, strict=True)])

    f = files.withColumn("kind", sniff(F.col("content"), F.col("path"), F.lit("")))
    f = f.withColumn("kind", F.when((F.col("kind") == "zip") & F.lower("path").rlike(r"\.(docx|xlsx)$"), F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))).otherwise(F.col("kind")))
    f = f.withColumn("text", text("content", "kind"))
    return f.select("path", "kind", "text", outcome(F.col("text"), F.col("kind"), F.col("length")).alias("state"))


#: Tags that begin a line, and named characters.
LINE_TAGS, NAMED = ["p", "br", "div", "li", "tr", "h1", "h2", "h3", "title"], {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "middot": "·", "copy": "©", "ndash": "–", "mdash": "—", "laquo": "«", "raquo": "»", "amp": "&"}
_STRIPPED = [r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>"]
_LINE, _TAG = rf"(?i)<(?:{'|'.join(LINE_TAGS)})\b[^>]*>", r"<[!/?A-Za-z][^>]*>"


def page_text(html: Column) -> Column:
    """The text of a page, of built-in functions: tags that begin a line are line ends, others go, characters by name or number are themselves."""
    t = F.coalesce(html, F.lit(""))
    for pattern in _STRIPPED:
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(F.regexp_replace(t, _LINE, "\n"), _TAG, "")
    numbers = F.filter(F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#(\d{1,7});"), F.lit(1))), lambda n: n.cast("int").between(1, 0xD7FF) | n.cast("int").between(0xE000, 0x10FFFF))
    t = F.aggregate(numbers, t, lambda acc, n: F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")))
    for name, char in NAMED.items():
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    return F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f\n]*\n[ \t\r\f\n]*", "\n"), r"^[ \t\r\f\n]+|[ \t\r\f\n]+$", "")


def _page_sql() -> str:
    t = "coalesce(html, '')"
    for pattern in _STRIPPED:
        t = f"regexp_replace({t}, '{pattern}', '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '{_LINE}', chr(10), 'g'), '{_TAG}', '', 'g')"
    for name, char in NAMED.items():
        t = f"replace({t}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace(regexp_replace({t}, '[ \\t\\r\\f\\n]*\\n[ \\t\\r\\f\\n]*', chr(10), 'g'), '^[ \\t\\r\\f\\n]+|[ \\t\\r\\f\\n]+$', '', 'g')"


@register("S9_html_text", f"SELECT page_id, length(t)::INTEGER AS n_chars, sha256(t) AS sha FROM (SELECT page_id, {_page_sql()} AS t FROM pages)")
def s9(spark, sf):
    return raw(spark, sf, "pages").select("page_id", page_text(F.col("html")).alias("text")).select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha"))


@register("S10_sniff", "SELECT page_id, CASE WHEN regexp_matches(url, '\\.[A-Za-z0-9]{1,5}$') THEN lower(regexp_extract(url, '\\.([A-Za-z0-9]{1,5})$', 1)) ELSE 'html' END AS kind FROM pages")
def s10(spark, sf):
    return raw(spark, sf, "pages").select("page_id", sniff(F.col("html").cast("binary"), F.col("url"), F.lit("text/html")).alias("kind"))


@register("S11_outcome", "SELECT doc_id, CASE WHEN length(text) > 20000 THEN 'too_large' WHEN length(text) < 20 OR length(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 10 THEN 'unreadable' ELSE 'ok' END AS state FROM documents")
def s11(spark, sf):
    return raw(spark, sf, "documents").select("doc_id", outcome(F.col("text"), F.lit("txt"), F.length("text"), most=20_000).alias("state"))


# --- S12-S14: catalogue files ---

#: Headings of catalogue columns.
HEADINGS = {"name": ["nomi", "name", "наименование", "товар"], "price": ["narx", "sotuv narxi", "price", "цена"], "stock": ["qoldiq", "stock", "остаток"], "unit": ["o'lchov birligi", "unit", "ед"], "category": ["kategoriya", "category", "категория"]}


def columns_of(cells: list[str]) -> dict[str, int]:
    """Which column each known heading names; the longest heading that a cell begins with wins."""
    found: dict[str, tuple[int, int]] = {}
    for i, cell in enumerate(cells):
        text = re.sub(r"\s+", " ", (cell or "").strip().lower())
        best = max(((len(h), k) for k, hs in HEADINGS.items() for h in hs if text.startswith(h)), default=None)
        if best and best[0] > found.get(best[1], (0, 0))[0]:
            found[best[1]] = (best[0], i)
    return {k: i for k, (_, i) in found.items()}


def header_row(rows: list[tuple[int, list[str]]], limit: int = 10) -> tuple[int, dict[str, int]] | None:
    """The place of the first of the leading rows that names two columns or more, and its columns."""
    for i, (_, cells) in enumerate(rows[:limit]):
        cols = columns_of(cells)
        if len(cols) >= 2:
            return i, cols
    return None


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> list[tuple[int, list[str]]]:
    """Row numbers and cells of a workbook's first sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_SHEET}t"))
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")] if "xl/sharedStrings.xml" in names else []
        sheet = min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        out = []
        for k, row in enumerate(ElementTree.fromstring(z.read(sheet)).iter(f"{_SHEET}row"), 1):
            cells: dict[int, str] = {}
            for c in row.iter(f"{_SHEET}c"):
                letters = re.match("[A-Z]+", c.get("r", ""))
                at = 0
                for x in letters[0] if letters else "":
                    at = at * 26 + ord(x) - 64
                value = c.find(f"{_SHEET}v")
                said = value.text or "" if value is not None else ""
                cells[at - 1 if at else len(cells)] = shared[int(said)] if c.get("t") == "s" else text(c) if c.get("t") == "inlineStr" else said
            out.append((int(row.get("r", k)), [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]))
        return out


def text_rows(content: bytes) -> list[tuple[int, list[str]]]:
    """Line numbers and cells of a delimited file: UTF-8, else Windows Cyrillic, else Latin 1; the commonest delimiter of its head."""
    for encoding in ("utf-8-sig", "cp1251", "latin-1"):
        try:
            text = content.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    head = text.split("\n", 10)[:10]
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=max(";,\t|", key=lambda s: sum(line.count(s) for line in head)))
    out, before = [], 0
    for cells in reader:
        out.append((before + 1, cells))  # a quoted cell may hold line ends: a row is where it begins
        before = reader.line_num
    return out


def catalogue_rows(files: DataFrame) -> DataFrame:
    """Rows of catalogue files (path, content) by their own headings: path, row (the file's own number), the known columns, and error where a file is none.

    A file is read whole by one task: catalogues are uploads of at most MEMBER_BYTES, larger ones are errors.
    """
    names = list(HEADINGS)

    def read(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                content, error, found, table = bytes(content or b""), None, None, []
                try:
                    table = [] if len(content) > MEMBER_BYTES else sheet_rows(content) if content[:4] == b"PK\x03\x04" else text_rows(content)
                    found = header_row(table)
                    error = "too_large" if len(content) > MEMBER_BYTES else None if found else "no_header"
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError, csv.Error):
                    error = "unreadable"
                if error:
                    rows.append((path, None, *[None] * len(names), error))
                    continue
                at, cols = found
                for number, cells in table[at + 1 :]:
                    if any(c.strip() for c in cells):
                        rows.append((path, number, *[(cells[cols[n]].strip() or None) if n in cols and cols[n] < len(cells) else None for n in names], None))
            yield pd.DataFrame(rows, columns=["path", "row", *names, "error"]).astype({"row": "Int64"})

    return files.select("path", "content").mapInPandas(read, "path string, row long, " + ", ".join(f"{n} string" for n in names) + ", error string")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the catalogue files at a path; ValueError where one has no header row in its first ten."""
    ship(spark)
    return catalogue_rows(spark.read.format("binaryFile").load(path))


@register("S12_catalogue_files", sql("product", """SELECT 'catalogue-' || (product_id // 1000) || '.csv' AS path, row_number() OVER (PARTITION BY product_id // 1000 ORDER BY product_id) + 2 AS "row", name, CAST(price AS VARCHAR) AS price, category FROM product"""))
def s12(spark, sf):
    """Products as the delimited files of a thousand rows that companies upload: a comment, a heading, and the rows."""
    ship(spark)
    line = F.concat_ws(";", F.concat(F.lit('"'), F.col("name"), F.lit('"')), F.col("price").cast("string"), "category")
    lines = product(spark, sf).select(F.floor(F.col("product_id") / 1000).alias("k"), F.struct("product_id", line.alias("line")).alias("x")).groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("x"))
    content = F.concat(F.lit("uploaded catalogue\nNomi;Sotuv narxi, so'm;Kategoriya\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n"))
    files = lines.select(F.concat(F.lit("catalogue-"), F.col("k").cast("string"), F.lit(".csv")).alias("path"), content.cast("binary").alias("content"))
    return catalogue_rows(files).select("path", "row", "name", "price", "category")


def validated(rows: DataFrame, categories: list[str]) -> DataFrame:
    """rows with errors and warnings: a missing name, a bad or negative price, an unknown category; repeated names warn."""
    from bidlake.functions.scalars import number_or_error

    price = number_or_error(F.col("price"))
    errors = F.array(F.when(F.col("name").isNull(), "name_missing"), F.when(price["error"].isNotNull(), F.concat(F.lit("price_"), price["error"])), F.when(price["value"] < 0, "price_negative"), F.when(F.col("category").isNotNull() & ~F.lower("category").isin(categories), "category_unknown"))
    again = F.when(F.col("name").isNotNull() & (F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("row")) > 1), "name_repeated")
    keep = lambda a: F.filter(a, lambda x: x.isNotNull())
    return rows.withColumn("errors", keep(errors)).withColumn("warnings", keep(F.array(again)))


@register("S13_row_validation", sql("product", "SELECT product_id AS row, CASE WHEN product_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN product_id % 5 = 0 THEN 1 ELSE 0 END AS n_errors, CASE WHEN product_id % 7 <> 0 AND row_number() OVER (PARTITION BY CASE WHEN product_id % 7 <> 0 THEN name END ORDER BY product_id) > 1 THEN 1 ELSE 0 END AS n_warnings FROM product"))
def s13(spark, sf):
    k = F.col("product_id")
    rows = product(spark, sf).select(k.alias("row"), F.when(k % 7 != 0, F.col("name")).alias("name"), F.when(k % 5 == 0, "10-15").otherwise(F.col("price").cast("string")).alias("price"), "category")
    return validated(rows, ["economy", "promo", "large", "standard", "medium", "small"]).select("row", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


def any_date(c: Column) -> Column:
    """A date in one of the usual spellings, or a spreadsheet's day number; words for perpetual give null."""
    serial = F.when(c.rlike(r"^\d{5}$"), F.date_add(F.lit("1899-12-30").cast("date"), c.try_cast("int")))
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "dd.MM.yyyy"), F.try_to_date(c, "dd/MM/yyyy"), serial)


@register("S14_document_dates", "SELECT o_orderkey, o_orderdate::DATE AS d FROM orders")
def s14(spark, sf):
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd.MM.yyyy")).otherwise(F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string"))
    return raw(spark, sf, "orders").select("o_orderkey", any_date(text).alias("d"))


# --- S15-S20: sinks ---


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All keys, new rows where there are any."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest(both, key, F.desc("__new")).drop("__new")


def with_children_replaced(old: DataFrame, new: DataFrame, parent: str, touched: DataFrame) -> DataFrame:
    """Children of touched parents are the new ones; others stay."""
    return old.join(touched, parent, "left_anti").unionByName(new)


def soft_deleted(old: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """States after a full read: gone rows are marked, returned ones queue again, new ones queue."""
    j = old.select(key, F.col("state").alias("was")).join(seen.select(key, F.lit(True).alias("here")), key, "full_outer")
    state = F.when(F.col("here").isNull(), "gone").when(F.col("was").isNull() | (F.col("was") == "gone"), "queued").otherwise(F.col("was"))
    return j.select(key, state.alias("state"))


def sanitized(df: DataFrame, column: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Unknown references become null; what was sent stays in <column>_raw."""
    d = dim.select(F.col(dim_key).alias("__k")).distinct()
    return df.join(d, F.col(column) == F.col("__k"), "left").withColumn(f"{column}_raw", F.col(column)).withColumn(column, F.col("__k")).drop("__k")


def write_swapped(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a table as one commit; with partitions, those that df holds only."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


@register("S15_upsert", sql("product", "SELECT product_id, CASE WHEN product_id % 4 = 0 THEN 'new' ELSE 'old' END AS v FROM product"))
def s15(spark, sf):
    p = product(spark, sf).select("product_id")
    return upserted(p.where("product_id % 8 <> 0").withColumn("v", F.lit("old")), p.where("product_id % 4 = 0").withColumn("v", F.lit("new")), ["product_id"])


@register("S16_replace_children", sql("good", "SELECT tender_id, good_no, part_id, CASE WHEN tender_id % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM good WHERE tender_id % 3 <> 0 OR good_no = 1"))
def s16(spark, sf):
    g = good(spark, sf).select("tender_id", "good_no", "part_id")
    touched = tender(spark, sf).where("id % 3 = 0").select(F.col("id").alias("tender_id"))
    return with_children_replaced(g.withColumn("v", F.lit("old")), g.where("tender_id % 3 = 0 AND good_no = 1").withColumn("v", F.lit("new")), "tender_id", touched)


@register("S17_soft_delete", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'gone' WHEN a.doc_id IS NULL OR a.state = 'gone' THEN 'queued' ELSE a.state END AS state FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'gone' ELSE 'ok' END AS state FROM documents WHERE doc_id % 2 = 0) a FULL OUTER JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) b ON a.doc_id = b.doc_id")
def s17(spark, sf):
    d = raw(spark, sf, "documents").select("doc_id")
    old = d.where("doc_id % 2 = 0").withColumn("state", F.when(F.col("doc_id") % 5 == 0, "gone").otherwise("ok"))
    return soft_deleted(old, d.where("doc_id % 3 <> 0"), "doc_id")


@register("S18_sanitize_reference", sql("tender area", "SELECT t.id, a.area_id AS area_path, t.area_path AS area_path_raw FROM tender t LEFT JOIN (SELECT area_id FROM area WHERE area_id NOT LIKE '33.4%') a ON t.area_path = a.area_id"))
def s18(spark, sf):
    from bidlake.sources.procurement import area

    dim = area(spark, sf).where("area_id NOT LIKE '33.4%'")
    return sanitized(tender(spark, sf).select("id", "area_path"), "area_path", dim, "area_id")


def ready(spark: SparkSession, table: str, columns: list[str]) -> bool:
    """Whether a table and its columns are there, so that a feature can be on."""
    return spark.catalog.tableExists(table) and set(columns) <= set(spark.table(table).columns)


#: The tables and columns that optional features of the query need.
FEATURES = {"stock": ("part", ["p_partkey", "p_size"]), "chat": ("conversations", ["conv_id", "turn", "text"]), "quality": ("labels", ["doc_id", "reviewer"]), "erp": ("erp_stock", ["product_id", "qty"])}


def readiness(spark: SparkSession, sf: str, features: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """feature, ready: whether the folder has each feature's table with its columns; schemas alone are read."""
    rows = []
    for feature, (table, columns) in features.items():
        try:
            have = set(raw(spark, sf, table).columns)
        except AnalysisException:
            have = set()
        rows.append((feature, set(columns) <= have))
    return spark.createDataFrame(rows, "feature string, ready boolean")


@register("S19_readiness", " UNION ALL ".join(f"SELECT '{f}' AS feature, (SELECT count(DISTINCT column_name) FROM information_schema.columns WHERE table_name = '{t}' AND column_name IN ({', '.join(repr(c) for c in cols)})) = {len(cols)} AS ready" for f, (t, cols) in FEATURES.items()))
def s19(spark, sf):
    return readiness(spark, sf, FEATURES)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def csv_lines(df: DataFrame) -> Column:
    """A row as a line of the export, quoted where it must be."""
    return F.to_csv(F.struct(*df.columns))


@register("S20_csv_lines", sql("product", "SELECT product_id, product_id || ',' || name || ',' || CASE WHEN product_id % 2 = 0 THEN '\"' || category || ', no. ' || product_id || '\"' ELSE category END || ',' || coalesce(CAST(stock_qty AS VARCHAR), '') || ',' || CAST(price AS VARCHAR) AS line FROM product"))
def s20(spark, sf):
    p = product(spark, sf).select("product_id", "name", F.when(F.col("product_id") % 2 == 0, F.concat("category", F.lit(", no. "), F.col("product_id").cast("string"))).otherwise(F.col("category")).alias("category"), "stock_qty", "price")
    return p.select("product_id", csv_lines(p).alias("line"))
