"""Scalar functions (X1-X34), all of Catalyst's own pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.catalog import register
from bidlake.functions.text import fold, jaccard, trigrams, word_starts
from bidlake.sources.procurement import product, raw, sql, tender

# --- transliteration ---

#: Cyrillic to Latin.
LATIN = {"щ": "sh", "ш": "sh", "ч": "ch", "ж": "j", "ц": "ts", "я": "ya", "ю": "yu", "ё": "yo", "ў": "o", "ғ": "g", "қ": "q", "ҳ": "h", "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "э": "e", "з": "z", "и": "i", "й": "y", "ы": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "x", "ь": "", "ъ": ""}
#: Latin spellings with their Cyrillic readings.
CYRILLIC = {"sch": "ш", "sh": "ш", "ch": "ч", "zh": "ж", "kh": "х", "ya": "я", "yu": "ю", "yo": "е", "o'": "у", "g'": "г", "o‘": "у", "g‘": "г", "oʻ": "у", "gʻ": "г", "a": "а", "b": "б", "v": "в", "g": "г", "d": "д", "e": "е", "j": "ж", "z": "з", "i": "и", "y": "и", "k": "к", "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "r": "р", "s": "с", "t": "т", "u": "у", "f": "ф", "x": "х", "h": "х", "q": "к", "w": "в"}
#: Spellings with several readings, and Cyrillic letters that look like Latin ones.
SEVERAL, LOOKALIKE = {"ts": ["ц", "тс"], "c": ["ц", "к"]}, ("аеорсух", "aeopcyx")
MOST_VARIANTS, MOST_READINGS = 6, 16


def to_latin(c: Column) -> Column:
    """Cyrillic letters as Latin ones; single letters in one translate, the rest by replacement."""
    c = F.lower(c)
    for k, v in LATIN.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    one = {k: v for k, v in LATIN.items() if len(v) == 1}
    gone = "".join(k for k, v in LATIN.items() if not v)
    return F.translate(c, "".join(one) + gone, "".join(one.values()))


def readings(c: Column) -> Column:
    """All Cyrillic readings of a Latin word, folded: each spelling's readings follow each of those so far, at most sixteen."""
    known = {**{k: [v] for k, v in CYRILLIC.items()}, **SEVERAL}
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    longest = "|".join(sorted((k for k in known if len(k) > 1), key=len, reverse=True))
    parts = F.transform(F.regexp_extract_all(c, F.lit(rf"({longest}|[\s\S])"), F.lit(1)), lambda t: F.coalesce(F.element_at(table, t), F.array(t)))
    grown = lambda acc, more: F.slice(F.flatten(F.transform(acc, lambda r: F.transform(more, lambda o: F.concat(r, o)))), 1, MOST_READINGS)
    return F.transform(F.aggregate(parts, F.array(F.lit("")), grown), fold)


def spellings(c: Column) -> Column:
    """The query itself and its other spellings, folded, at most six; derived ones of a single letter are left out."""
    q = F.lower(F.trim(c))
    latin, cyrillic = q.rlike("[a-z'‘ʻ]"), q.rlike("[\\u0400-\\u04FF]")
    none = F.array().cast("array<string>")
    lat = to_latin(q)
    derived = F.concat(F.when(cyrillic, F.concat(F.array(lat), readings(lat), F.array(F.translate(q, *LOOKALIKE)))).otherwise(none), F.when(latin, F.concat(readings(q), F.array(q))).otherwise(none))
    every = F.concat(F.array(fold(q)), F.filter(derived, lambda x: F.length(x) > 1))
    return F.when(F.coalesce(q, F.lit("")) == "", none).otherwise(F.slice(F.array_distinct(every), 1, MOST_VARIANTS))


#: Inflection endings taken off terms; a stem keeps four letters.
ENDINGS = ["laridan", "larida", "lariga", "larini", "lardagi", "lardan", "larga", "lari", "lar", "ning", "niki", "dagi", "dan", "ga", "ni", "ami", "yah", "ov", "om", "ax", "y", "i", "a", "e", "u"]
_STEM = f"^(.{{4,}}?)(?:{'|'.join(ENDINGS)})$"


def canonical(c: Column) -> Column:
    """A term in Latin letters and digits, endings taken off word by word, the longest first, until none is left to take."""
    words = F.filter(F.split(F.regexp_replace(to_latin(c), "[^0-9a-z]+", " "), " "), lambda w: w != "")
    stem = lambda w: F.aggregate(F.sequence(F.lit(1), F.length(w)), w, lambda acc, _: F.regexp_replace(acc, _STEM, "$1"))
    return F.array_join(F.transform(words, stem), " ")


def over_distinct(df: DataFrame, column: str, out: str, f) -> DataFrame:
    """f(column) computed once for each distinct value and joined back: a slow function over few values."""
    known = df.select(column).distinct().withColumn(out, f(F.col(column)))
    return df.join(known.withColumnRenamed(column, "__k"), F.col(column).eqNullSafe(F.col("__k")), "left").drop("__k")


# --- numbers ---


def amount(c: Column) -> Column:
    """The number of a text such as "3 000.00 t": blanks group thousands, a comma is a point; ranges and products give null."""
    t = F.regexp_replace(F.trim(c), "[  ]", "")
    bad = t.rlike(r"\d\s*[-–x×*]\s*\d")
    num = F.regexp_extract(t, r"^([+-]?\d+(?:[.,]\d+)?)\D*$", 1)
    return F.when(~bad & (num != ""), F.replace(num, F.lit(","), F.lit(".")).try_cast("decimal(18,3)"))


def number_or_error(c: Column) -> Column:
    """(value, error): empty, range, not_a_number."""
    t = F.regexp_replace(F.trim(c), "[  ']", "")
    t = F.when(t.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    value = t.try_cast("double")
    error = F.when(c.isNull() | (F.trim(c) == ""), "empty").when(t.rlike(r"^\d+(\.\d+)?[-–]\d+"), "range").when(value.isNull(), "not_a_number")
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def round2(c: Column) -> Column:
    """Half away from zero at two places, with a small allowance for binary fractions."""
    return F.signum(c) * F.floor(F.abs(c) * 100 + 1e-9 + 0.5) / 100


#: Unit spellings.
UNITS = {"dona": "dona", "шт": "dona", "шт.": "dona", "pcs": "dona", "kg": "kg", "кг": "kg", "litr": "litr", "л": "litr", "m2": "m²", "м2": "m²", "t": "t", "т": "t", "tonna": "t"}


def canonical_unit(c: Column) -> Column:
    pairs = [x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v))]
    key = F.lower(F.trim(c))
    return F.coalesce(F.element_at(F.create_map(*pairs), key), key)


#: Beginnings of period names in days.
PERIODS = {"year": 365, "год": 365, "лет": 365, "yil": 365, "month": 30, "мес": 30, "oy": 30, "week": 7, "нед": 7, "hafta": 7, "day": 1, "дн": 1, "ден": 1, "kun": 1}


def days_of(number: Column, name: Column) -> Column:
    out = F.lit(None).cast("int")
    for stem, n in reversed(PERIODS.items()):
        out = F.when(F.lower(F.trim(name)).startswith(stem), n).otherwise(out)
    return number * out


def percent_of(c: Column) -> Column:
    return F.replace(F.regexp_extract(c, r"(\d+(?:[.,]\d+)?)\s*%", 1), F.lit(","), F.lit(".")).try_cast("double")


def span_days(c: Column) -> Column:
    """'24 months' -> 720."""
    n = F.regexp_extract(c, r"(\d+)\s*\p{L}+", 1).try_cast("int")
    return days_of(n, F.regexp_extract(c, r"\d+\s*(\p{L}+)", 1))


# --- dates ---


def precise_close(day: Column, remain_s: Column, fetched: Column) -> Column:
    """A date-only deadline: fetch time plus the seconds left, else the day's last second."""
    return F.coalesce(fetched + F.make_dt_interval(secs=remain_s), day + F.expr("INTERVAL '0 23:59:59' DAY TO SECOND"))


def validity(until: Column, today: Column, soon: int = 30) -> Column:
    left = F.datediff(until, today)
    return F.when(until.isNull(), "perpetual").when(left < 0, "expired").when(left <= soon, "soon").otherwise("valid")


# --- text ---


def clean(c: Column) -> Column:
    """Without control characters; blanks and line ends in runs are one."""
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def script_guess(c: Column) -> Column:
    cyr, lat = F.length(F.regexp_replace(c, "[^а-яёА-ЯЁ]", "")), F.length(F.regexp_replace(c, "[^a-zA-Z]", ""))
    return F.when(cyr + lat == 0, "none").when(cyr > lat, "cyrillic").otherwise("latin")


def same_value(a: Column, b: Column) -> Column:
    """Equal as numbers if both are, else as texts; nulls are equal."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a.eqNullSafe(b))


def ids_in(c: Column) -> Column:
    """Numbers of 5 to 12 digits that are no part of a longer number, a decimal or a word."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<![\w.,])(\d{5,12})(?![\w]|[.,]\d)"), F.lit(1)))


CHUNK, OVERLAP, LOOK_BACK, LEAST = 1000, 150, 250, 80
#: What a piece ends behind, the best first: a paragraph, a sentence, a clause, a line, a word.
BLANK = r"[ \t\n\r\f\x0B\xA0]"
BREAKS = [rf"\n{BLANK}*\n", rf"[.!?…]{BLANK}", rf"[;:]{BLANK}", r"\n", BLANK]


def _reach(window: Column, mark: str) -> Column:
    """How far into the window its last mark ends; 0 without one."""
    return F.length(F.regexp_extract(window, rf"^[\s\S]*{mark}", 0))


def chunks(c: Column, size: int = CHUNK, overlap: int = OVERLAP, back: int = LOOK_BACK, least: int = LEAST) -> Column:
    """Overlapping pieces of a text as an array of (start, end, text): text[start:end] is the piece.

    A piece ends behind the best kind of mark that its last `back` characters hold, and behind the
    last of that kind, else after `size` characters; the next one begins `overlap` before its end. Texts up
    to `size` are one piece. Blank pieces, and those under `least` behind a longer one, are left out.
    """
    if size <= overlap + back or size <= least:
        raise ValueError("pieces must be longer than what they share and look back at")
    n = F.length(c)

    def cut(at: Column) -> Column:
        low = F.greatest(at + least, at + size - back)
        window = F.substring(c, low + 1, at + size - low)
        good = F.coalesce(*[F.nullif(_reach(window, m), F.lit(0)) for m in BREAKS])
        return F.when(at + size >= n, n).otherwise(F.coalesce(low + good, at + size))

    def step(acc: Column, _) -> Column:
        at = F.when(F.size(acc) == 0, 0).otherwise(F.element_at(acc, -1)["end"] - overlap)
        over = (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= n)
        return F.when(over, acc).otherwise(F.concat(acc, F.array(F.struct(at.alias("start"), cut(at).alias("end")))))

    most = F.ceil(n / (size - overlap - back)).cast("int") + 1
    spans = F.aggregate(F.sequence(F.lit(1), most), F.array().cast("array<struct<start:int,end:int>>"), step)
    pieces = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.substring(c, x["start"] + 1, x["end"] - x["start"]).alias("text")))
    kept = F.filter(pieces, lambda x: x["text"].rlike(r"[^ \t\n\r\f\x0B\xA0]") & ((F.length(x["text"]) >= least) | (n <= size)))
    return F.when(n > 0, kept).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def places(c: Column, terms: list[str]) -> Column:
    """Where any of the literal terms begins, in order."""

    def of(term: str) -> Column:
        parts = F.split(c, "".join("\\" + x if not x.isalnum() and not x.isspace() else x for x in term), -1)
        lengths = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), F.length)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(lengths, start, lambda acc, x: F.struct((acc["at"] + x + len(term)).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")))["out"]

    return F.array_sort(F.array_distinct(F.flatten(F.array(*map(of, terms)))))


def tidy(c: Column) -> Column:
    """Without runs of blanks and of empty lines, and blanks at either end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t\xA0]+", " "), r"\n{3,}", "\n\n"), rf"^{BLANK}+|{BLANK}+$", "")


def excerpts(c: Column, terms: list[str], pad: int = 70, budget: int = 600) -> Column:
    """(used, text): windows around the terms' places, merged where they touch, tidied, first ones first while the budget lasts.

    The last window is cut to what the budget has left; without a place the text's beginning counts.
    """
    n = F.length(c)

    def merge(acc: Column, at: Column) -> Column:
        low, high = F.greatest(at - pad, F.lit(0)), F.least(at + pad, n)
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], high).alias("end"))))
        return F.when((F.size(acc) > 0) & (low <= last["end"]), joined).otherwise(F.concat(acc, F.array(F.struct(low.alias("start"), high.alias("end")))))

    def take(acc: Column, x: Column) -> Column:
        piece = tidy(F.substring(c, x["start"] + 1, F.least(x["end"] - x["start"], budget - acc["used"])))
        shown = F.concat(F.when(x["start"] > 0, "…").otherwise(""), piece, F.when(x["end"] < n, "…").otherwise(""))
        more = F.struct((acc["used"] + F.length(piece)).alias("used"), F.concat(acc["parts"], F.array(shown)).alias("parts"))
        return F.when((acc["used"] >= budget) | (piece == ""), acc).otherwise(more)

    spans = F.aggregate(places(F.lower(c), terms), F.array().cast("array<struct<start:int,end:int>>"), merge)
    found = F.aggregate(spans, F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("parts")), take)
    head = tidy(F.substring(c, 1, budget))
    alone = F.struct(F.length(head).alias("used"), head.alias("text"))
    return F.when(n > 0, F.when(F.size(spans) > 0, F.struct(found["used"].alias("used"), F.array_join(found["parts"], "\n---\n").alias("text"))).otherwise(alone)).otherwise(F.struct(F.lit(0).alias("used"), F.lit("").alias("text")))


def source_url(platform: Column, ident: Column) -> Column:
    return F.when(platform == "portal_a", F.concat(F.lit("https://a.example/tender/"), ident)).when(platform == "portal_b", F.concat(F.lit("https://b.example/lot?id="), ident))


def normal_path(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\?.*$", ""), r"/\d+(?=/|$)", "/{id}")


SECRET = r"(?i)(token|secret|password|key)"


def masked(m: Column) -> Column:
    """A map with the values of secret-looking keys hidden."""
    return F.transform_values(m, lambda k, v: F.when(k.rlike(SECRET), F.lit("***")).otherwise(v))


def keyword_list(c: Column) -> Column:
    parts = F.transform(F.split(c, r"[,;|\n]"), lambda x: F.trim(F.lower(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def fingerprint(values: Column) -> Column:
    """One hash for a set of values, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), "\n"), 256)


# --- registered checks of the functions over whole tables ---


@register("X1_fold", sql("tender", "SELECT id, translate(lower(buyer_name || ' ЁЛЬ Эйфель'), 'эёыйщьъ', 'ееииш') AS folded FROM tender"))
def x1(spark, sf):
    return tender(spark, sf).select("id", fold(F.concat("buyer_name", F.lit(" ЁЛЬ Эйфель"))).alias("folded"))


def _word_texts(spark, sf) -> DataFrame:
    """The words of the tenders' files, in three spellings."""
    from bidlake.plans.requirements import request_texts

    return request_texts(tender(spark, sf))


def letters_sql() -> str:
    return "CASE c " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in LATIN.items()) + " ELSE c END"


def x2(spark, sf):
    """Every word of the tenders' files in Latin letters, and how many files it stands in."""
    rows = _word_texts(spark, sf).select(F.explode(F.array_distinct(F.split("text", r"[^\p{L}']+"))).alias("word")).where("word <> ''")
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", to_latin(F.col("word")).alias("latin"), "n")


def x16(spark, sf):
    """The first percentage and the first span of time in each tender's files."""
    t = F.col("text")
    return _word_texts(spark, sf).select("id", "part", percent_of(t).alias("pct"), span_days(F.regexp_extract(t, r"(\d+\s+\p{L}+)", 1)).alias("days"))


_OPTIONS = "CASE t " + " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN {v!r}" for k, v in {**{k: [v] for k, v in CYRILLIC.items()}, **SEVERAL}.items()) + " ELSE [t] END"
_SPELT = "regexp_extract_all({0}, '" + "|".join(sorted((k.replace("'", "''") for k in [*CYRILLIC, *SEVERAL] if len(k) > 1), key=len, reverse=True)) + "|.')"

def SPELLINGS_SQL(source: str, key: str) -> str:  # noqa: N802
    """The oracle's counterpart of spellings() for Latin words: key, s, for the rows (name) of a query."""
    readings_ = f"list_transform(list_reduce(list_transform({_SPELT.format('q')}, lambda t: {_OPTIONS}), lambda acc, o: flatten(list_transform(acc, lambda r: list_transform(o, lambda y: r || y)))[1:16], ['']), lambda y: translate(y, 'эёыйщьъ', 'ееииш'))"
    derived = f"CASE WHEN regexp_matches(q, '[a-z''‘ʻ]') THEN list_filter({readings_} || [q], lambda y: length(y) > 1) ELSE [] END"
    unique = "list_reduce(list_transform(x, lambda y: [y]), lambda acc, y: CASE WHEN list_contains(acc, y[1]) THEN acc ELSE acc || y END, []::VARCHAR[])"
    return f"SELECT name AS {key}, ({unique})[1:6] AS s FROM (SELECT name, [translate(q, 'эёыйщьъ', 'ееииш')] || {derived} AS x FROM (SELECT name, lower(trim(name)) AS q FROM ({source})))"


@register("X3_spellings", sql("product", f"""SELECT product_id, name, array_to_string(s, '|') AS spellings FROM product JOIN ({SPELLINGS_SQL("SELECT DISTINCT name FROM product", "k")}) ON k = name"""))
def x3(spark, sf):
    return over_distinct(product(spark, sf).select("product_id", "name"), "name", "spellings", lambda c: F.array_join(spellings(c), "|"))


@register("X4_norm_text", "SELECT doc_id, translate(lower(text), 'эёыйщьъ', 'ееииш') AS t FROM documents")
def x4(spark, sf):
    return raw(spark, sf, "documents").select("doc_id", fold("text").alias("t"))


@register("X4b_norm_text_whole", "SELECT doc_id, translate(lower(text), 'эёыйщьъ', 'ееииш') AS t FROM documents")
def x4b(spark, sf):
    """X4 under the name it had while X4 cut texts."""
    return x4(spark, sf)


def _stems(word: str, times: int) -> str:
    for _ in range(times):
        word = f"regexp_replace({word}, '{_STEM}', '\\1')"
    return word


def CANONICAL_SQL(name: str) -> str:  # noqa: N802
    """The oracle's counterpart of canonical() for Latin text."""
    return f"array_to_string(list_transform(list_filter(string_split(regexp_replace(lower({name}), '[^0-9a-z]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: {_stems('w', 12)}), ' ')"


@register("X5_canonical_terms", sql("product", f"""SELECT product_id, name, {CANONICAL_SQL("name")} AS term FROM product"""))
def x5(spark, sf):
    return over_distinct(product(spark, sf).select("product_id", "name"), "name", "term", canonical)


@register("X8_word_start", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])thre')")
def x8(spark, sf):
    return raw(spark, sf, "documents").where(word_starts(F.lower("text"), "thre")).select("doc_id")


@register("X9_trigram_jaccard", sql("product", "SELECT product_id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS sim FROM (SELECT product_id, list_distinct([substr(name, i, 3) for i in range(1, length(name) - 1)]) AS a, list_distinct([substr('red bolts', i, 3) for i in range(1, 8)]) AS b FROM product)"))
def x9(spark, sf):
    return product(spark, sf).select("product_id", F.round(jaccard(trigrams("name"), trigrams(F.lit("red bolts"))), 6).alias("sim"))


_WRITTEN = "CASE l_linenumber % 7 WHEN 1 THEN (c // 100)::VARCHAR || ',' || lpad((c % 100)::VARCHAR, 2, '0') WHEN 2 THEN (c // 100000)::VARCHAR || ' ' || lpad((c // 100 % 1000)::VARCHAR, 3, '0') || '.' || lpad((c % 100)::VARCHAR, 2, '0') WHEN 3 THEN (c // 100000)::VARCHAR || ',' || lpad((c // 100 % 1000)::VARCHAR, 3, '0') || '.' || lpad((c % 100)::VARCHAR, 2, '0') WHEN 4 THEN (c // 100)::VARCHAR || '-' || (c // 50)::VARCHAR WHEN 5 THEN 'about ' || (c // 100) WHEN 6 THEN ' ' END"


@register("X12_number_parser", f"SELECT l_orderkey, l_linenumber, l_partkey, t, CASE WHEN l_linenumber % 7 IN (1, 2, 3) THEN c / 100 END AS v, CASE l_linenumber % 7 WHEN 4 THEN 'range' WHEN 5 THEN 'not_a_number' WHEN 6 THEN 'empty' WHEN 0 THEN 'empty' END AS err FROM (SELECT *, {_WRITTEN} AS t FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem))")
def x12(spark, sf):
    """Every position's price, written in one of seven ways by its line number, read back: grouped by blanks or commas, a range, words, nothing."""
    c, k = F.col("c"), F.col("l_linenumber") % 7
    whole, cents, thousands, rest = (F.floor(c / 100)).cast("string"), F.lpad((c % 100).cast("string"), 2, "0"), F.floor(c / 100000).cast("string"), F.lpad((F.floor(c / 100) % 1000).cast("string"), 3, "0")
    t = F.when(k == 1, F.concat(whole, F.lit(","), cents)).when(k == 2, F.concat(thousands, F.lit(" "), rest, F.lit("."), cents)).when(k == 3, F.concat(thousands, F.lit(","), rest, F.lit("."), cents))
    t = t.when(k == 4, F.concat(whole, F.lit("-"), F.floor(c / 50).cast("string"))).when(k == 5, F.concat(F.lit("about "), whole)).when(k == 6, " ")
    n = number_or_error(F.col("t"))
    rows = raw(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("c")).withColumn("t", t)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "t", n["value"].alias("v"), n["error"].alias("err"))


@register("X13_amount_text", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DOUBLE) AS amount FROM lineitem")
def x13(spark, sf):
    text = F.concat(F.format_number("l_quantity", 2), F.lit(" kg"))
    return raw(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", amount(F.replace(text, F.lit(","), F.lit(" "))).cast("double").alias("amount"))


@register("X14_unit_canonical", sql("good", "SELECT unit, count(*) AS n FROM good GROUP BY unit"))
def x14(spark, sf):
    from bidlake.sources.procurement import good

    shout = F.concat(F.lit(" "), F.upper("unit"), F.lit(" "))
    return good(spark, sf).groupBy(canonical_unit(shout).alias("unit")).agg(F.count(F.lit(1)).alias("n"))


@register("X15_period_days", sql("tender", "SELECT id, CAST((id % 24 + 1) * CASE id % 3 WHEN 0 THEN 30 WHEN 1 THEN 1 ELSE 365 END AS INTEGER) AS days FROM tender"))
def x15(spark, sf):
    k = F.col("id")
    name = F.when(k % 3 == 0, "месяц").when(k % 3 == 1, "kun").otherwise("years")
    return tender(spark, sf).select("id", days_of((k % 24 + 1).cast("int"), name).alias("days"))


@register("X17_precise_deadline", sql("tender", "SELECT id, CASE WHEN id % 2 = 0 THEN published_at + to_seconds(id % 90000) ELSE date_trunc('day', published_at) + INTERVAL '23:59:59' END AS close_at FROM tender"))
def x17(spark, sf):
    remain = F.when(F.col("id") % 2 == 0, (F.col("id") % 90000).cast("decimal(18,6)"))
    return tender(spark, sf).select("id", precise_close(F.date_trunc("day", "published_at"), remain, F.col("published_at")).alias("close_at"))


@register("X18_document_validity", sql("tender", "SELECT CASE WHEN close_at IS NULL THEN 'perpetual' WHEN d < 0 THEN 'expired' WHEN d <= 30 THEN 'soon' ELSE 'valid' END AS state, count(*) AS n FROM (SELECT close_at, date_diff('day', DATE '1998-06-01', close_at::DATE) AS d FROM tender) GROUP BY 1"))
def x18(spark, sf):
    return tender(spark, sf).groupBy(validity(F.col("close_at").cast("date"), F.lit("1998-06-01").cast("date")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@register("X20_round2", "SELECT l_orderkey, l_linenumber, l_partkey, sign(x) * floor(abs(x) * 100 + 1e-9 + 0.5) / 100 AS v FROM (SELECT *, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS x FROM lineitem)")
def x20(spark, sf):
    x = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return raw(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", round2(x).alias("v"))


@register("X21_content_hash", "SELECT source, sha256(string_agg(h, chr(10) ORDER BY h)) AS print FROM (SELECT DISTINCT source, sha256(coalesce(text, '')) AS h FROM documents) GROUP BY source")
def x21(spark, sf):
    h = raw(spark, sf, "documents").select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return h.groupBy("source").agg(fingerprint(F.collect_set("h")).alias("print"))


@register("X22_script_guess", "SELECT CASE WHEN length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) = 0 THEN 'none' ELSE 'latin' END AS script, count(*) AS n FROM documents GROUP BY 1")
def x22(spark, sf):
    return raw(spark, sf, "documents").groupBy(script_guess(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


@register("X23_clean", "SELECT doc_id, length(trim(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))) AS n FROM documents")
def x23(spark, sf):
    return raw(spark, sf, "documents").select("doc_id", F.length(clean(F.col("text"))).cast("long").alias("n"))


def _reach_sql(mark: str) -> str:
    return f"length(regexp_extract(w, '^(?s:.*){mark}'))"


_MARKS = [m.replace("\\xA0", "\\x{A0}") for m in BREAKS]
_NOT_BLANK = r"[^ \t\n\r\f\x0B\x{A0}]"
_CUT = f"CASE WHEN pos + {CHUNK} >= n THEN n ELSE coalesce(" + ", ".join(f"pos + {CHUNK - LOOK_BACK} + nullif({_reach_sql(m)}, 0)" for m in _MARKS) + f", pos + {CHUNK}) END"


@register("X24_chunks", f"""WITH RECURSIVE c AS (SELECT doc_id, text, n, pos, {_CUT} AS "end" FROM (SELECT doc_id, text, length(text)::INTEGER AS n, 0 AS pos, substr(text, {CHUNK - LOOK_BACK + 1}, {LOOK_BACK}) AS w FROM documents WHERE length(text) > 0)
    UNION ALL SELECT doc_id, text, n, pos, {_CUT} FROM (SELECT doc_id, text, n, "end" - {OVERLAP} AS pos, substr(text, "end" - {OVERLAP} + {CHUNK - LOOK_BACK} + 1, {LOOK_BACK}) AS w FROM c WHERE "end" < n))
    SELECT doc_id, pos AS start, "end", sha256(t) AS sha FROM (SELECT *, substr(text, pos + 1, "end" - pos) AS t FROM c) WHERE regexp_matches(t, '{_NOT_BLANK}') AND ("end" - pos >= {LEAST} OR n <= {CHUNK})""")
def x24(spark, sf):
    d = raw(spark, sf, "documents").select("doc_id", F.explode(chunks(F.col("text"))).alias("c"))
    return d.select("doc_id", "c.start", "c.end", F.sha2("c.text", 256).alias("sha"))


_TERMS, _PAD, _BUDGET = ["licensed", "rights reserved"], 70, 600
_TIDY = r"regexp_replace(regexp_replace(regexp_replace({0}, '[ \t\x{{A0}}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \t\n\r\f\x0B\x{{A0}}]+|[ \t\n\r\f\x0B\x{{A0}}]+$', '', 'g')"
_PLACES = " UNION ".join(f"SELECT doc_id, text, sum(length(part) + {len(t)}) OVER (PARTITION BY doc_id ORDER BY k) - {len(t)} AS pos FROM (SELECT doc_id, text, unnest(string_split(lower(text), '{t}')[:-2]) AS part, generate_subscripts(string_split(lower(text), '{t}')[:-2], 1) AS k FROM documents WHERE contains(lower(text), '{t}'))" for t in _TERMS)


@register("X25_excerpts", f"""WITH RECURSIVE h AS ({_PLACES}), w AS (SELECT doc_id, text, pos, greatest(pos - {_PAD}, 0) AS lo, least(pos + {_PAD}, length(text)) AS hi FROM h), m AS (SELECT *, lo > coalesce(max(hi) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM w),
    g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM m), sp AS (SELECT doc_id, any_value(text) AS text, grp, min(lo)::INTEGER AS lo, max(hi)::INTEGER AS hi FROM g GROUP BY doc_id, grp),
    r AS (SELECT doc_id, 1::HUGEINT AS grp, 0::BIGINT AS used, []::VARCHAR[] AS parts FROM (SELECT DISTINCT doc_id FROM sp) UNION ALL
      SELECT doc_id, grp + 1, CASE WHEN used >= {_BUDGET} OR p = '' THEN used ELSE used + length(p) END, CASE WHEN used >= {_BUDGET} OR p = '' THEN parts ELSE parts || [CASE WHEN lo > 0 THEN '…' ELSE '' END || p || CASE WHEN hi < n THEN '…' ELSE '' END] END FROM
      (SELECT r.doc_id, r.grp, used, parts, lo, hi, length(text) AS n, {_TIDY.format(f"substr(text, lo + 1, least(hi - lo, {_BUDGET} - used)::BIGINT)")} AS p FROM r JOIN sp ON sp.doc_id = r.doc_id AND sp.grp = r.grp)),
    f AS (SELECT doc_id, max(grp) AS grp FROM r GROUP BY doc_id)
    SELECT d.doc_id, coalesce(r.used, length(head))::INTEGER AS used, sha256(coalesce(array_to_string(r.parts, chr(10) || '---' || chr(10)), head)) AS sha FROM (SELECT doc_id, {_TIDY.format(f"coalesce(left(text, {_BUDGET}), '')")} AS head FROM documents) d LEFT JOIN (SELECT r.* FROM r JOIN f ON f.doc_id = r.doc_id AND f.grp = r.grp) r ON r.doc_id = d.doc_id""")
def x25(spark, sf):
    x = raw(spark, sf, "documents").select("doc_id", excerpts(F.col("text"), _TERMS, _PAD, _BUDGET).alias("x"))
    return x.select("doc_id", "x.used", F.sha2("x.text", 256).alias("sha"))


@register("X26_same_value", sql("good", "SELECT count(*) FILTER (WHERE CAST(amount AS VARCHAR) <> CAST(CAST(amount AS INTEGER) AS VARCHAR)) AS texts_differ, 0::BIGINT AS values_differ FROM good"))
def x26(spark, sf):
    from bidlake.sources.procurement import good

    a, b = F.col("amount").cast("string"), F.col("amount").cast("int").cast("string")
    return good(spark, sf).agg(F.count_if(a != b).alias("texts_differ"), F.count_if(~same_value(a, b)).alias("values_differ"))


@register("X27_ids_in_text", "SELECT page_id, array_to_string(list_distinct(regexp_extract_all(url, '/(\\d{5,12})(?:\\D|$)', 1)), ',') AS ids FROM pages WHERE NOT regexp_matches(url, '\\d[.,]\\d|[A-Za-z_]\\d|\\d[A-Za-z_]')")
def x27(spark, sf):
    return raw(spark, sf, "pages").where(~F.col("url").rlike(r"\d[.,]\d|[A-Za-z_]\d|\d[A-Za-z_]")).select("page_id", F.array_join(ids_in(F.col("url")), ",").alias("ids"))


@register("X28_source_url", sql("tender", "SELECT id, CASE source_platform WHEN 'portal_a' THEN 'https://a.example/tender/' || id WHEN 'portal_b' THEN 'https://b.example/lot?id=' || id END AS url FROM tender"))
def x28(spark, sf):
    return tender(spark, sf).select("id", source_url(F.col("source_platform"), F.col("id").cast("string")).alias("url"))


@register("X29_normal_path", "SELECT p, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^#]*)', 1), '\\?.*$', ''), '/\\d+(/|$)', '/{id}\\1', 'g') AS p FROM pages) GROUP BY p")
def x29(spark, sf):
    return raw(spark, sf, "pages").groupBy(normal_path(F.regexp_extract("url", "^https?://[^/]+(/[^#]*)", 1)).alias("p")).agg(F.count(F.lit(1)).alias("n"))


@register("X29b_masking", "SELECT event_id, '***' AS token, json_extract_string(props, '$.k') AS k FROM events")
def x29b(spark, sf):
    m = masked(F.create_map(F.lit("api_token"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k")))
    return raw(spark, sf, "events").select("event_id", m["api_token"].alias("token"), F.get(F.map_values(m), 1).alias("k"))


@register("X30_keyword_split", sql("product", "SELECT product_id, len(list_distinct([category, lower(name)])) AS n FROM product"))
def x30(spark, sf):
    return product(spark, sf).select("product_id", F.size(keyword_list(F.concat_ws("; ", "category", F.upper("name"), "category"))).cast("long").alias("n"))


@register("X31_array_ops", sql("product", "SELECT product_id, len(keywords) AS n, keywords[1] AS first, list_contains(keywords, 'bolt') AS bolt FROM product"))
def x31(spark, sf):
    return product(spark, sf).select("product_id", F.size("keywords").cast("long").alias("n"), F.get("keywords", 0).alias("first"), F.array_contains("keywords", "bolt").alias("bolt"))


@register("X32_json_ops", "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")
def x32(spark, sf):
    return raw(spark, sf, "events").groupBy(F.variant_get(F.parse_json("props"), "$.k", "int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@register("X33_time_arithmetic", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, date_trunc('hour', ts) AS h, ts + INTERVAL '90 minutes' AS later FROM events")
def x33(spark, sf):
    return raw(spark, sf, "events").select("event_id", F.unix_timestamp("ts").alias("s"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"), (F.col("ts") + F.make_dt_interval(mins=F.lit(90))).alias("later"))


#: Goods divisions by category.
DIVISIONS = {"machines": range(1, 6), "services": range(5, 10), "materials": range(10, 18), "furniture": range(18, 26)}


def category_of(code: Column) -> Column:
    d = F.substring(code, 1, 2).try_cast("int")
    out = F.lit("other")
    for name, r in reversed(DIVISIONS.items()):
        out = F.when(d.between(r.start, r.stop - 1), name).otherwise(out)
    return out


@register("X34_division_category", sql("product", "SELECT CASE WHEN d BETWEEN 1 AND 5 THEN 'machines' WHEN d BETWEEN 5 AND 9 THEN 'services' WHEN d BETWEEN 10 AND 17 THEN 'materials' WHEN d BETWEEN 18 AND 25 THEN 'furniture' ELSE 'other' END AS category, count(*) AS n FROM (SELECT CAST(substr(code, 1, 2) AS INTEGER) AS d FROM product) GROUP BY 1"))
def x34(spark, sf):
    return product(spark, sf).groupBy(category_of(F.col("code")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
