"""Join rewrites that Catalyst can't know: prefixes, pattern sets and trigrams as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.functions.text import trigrams

def ancestors(path: Column, sep: str = ".") -> Column:
    """All prefixes of a dotted path that end at a separator or at its end: a.b.c -> [a, a.b, a.b.c]."""
    parts = F.split(path, "\\" + sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))


def prefix_join(left: DataFrame, path: str, right: DataFrame, code: str, how: str = "inner", sep: str = ".") -> DataFrame:
    """left.path = right.code OR left.path LIKE right.code || '.%' as an equi-join on the path's ancestors.

    For how="left", rows without a partner appear once with nulls.
    """
    hits = left.withColumn("__a", F.explode(ancestors(F.col(path), sep))).join(right, F.col("__a") == right[code]).drop("__a")
    if how == "inner":
        return hits
    known = left.select(path).distinct().withColumn("__a", F.explode(ancestors(F.col(path), sep))).join(right.select(F.col(code).alias("__a")), "__a", "left_semi").select(path).distinct()
    return hits.unionByName(left.join(known, path, "left_anti").select(*left.columns), allowMissingColumns=True)


def code_levels(code: Column, lengths=(2, 5, 8)) -> Column:
    """The code cut at each level it is long enough for."""
    return F.filter(F.array(*[F.when(F.length(code) >= n, F.substring(code, 1, n)) for n in lengths]), lambda x: x.isNotNull())


def code_prefix_join(left: DataFrame, code: str, right: DataFrame, prefix: str, lengths=(2, 5, 8)) -> DataFrame:
    """left.code LIKE right.prefix || '%' for prefixes of the given lengths, as an equi-join."""
    return left.withColumn("__p", F.explode(code_levels(F.col(code), lengths))).join(right, F.col("__p") == right[prefix]).drop("__p")


def similar(left: DataFrame, lid: str, ltext: str, right: DataFrame, rid: str, rtext: str, least: float) -> DataFrame:
    """Pairs whose trigram sets have at least the Jaccard similarity: (lid, rid, common, sim).

    Equal texts are joined once, then spread: texts, not rows, are compared. A set that shares
    `least` of all with another holds one of its rarest trigrams, as many as it can miss and one
    more; only these are joined, so common trigrams bring nobody together by themselves.
    """
    a = left.select(F.col(ltext).alias("t")).distinct().withColumn("g", trigrams("t"))
    b = right.select(F.col(rtext).alias("t")).distinct().withColumn("g", trigrams("t"))
    count = a.select(F.explode("g").alias("x")).unionAll(b.select(F.explode("g").alias("x"))).groupBy("x").agg(F.count(F.lit(1)).alias("df"))

    def prefix(texts: DataFrame, names: tuple[str, str, str]) -> DataFrame:
        rare = texts.select("t", "g", F.explode("g").alias("x")).join(count, "x").groupBy("t").agg(F.first("g").alias("g"), F.array_sort(F.collect_list(F.struct("df", "x"))).alias("by"))
        n = F.size("g")
        return rare.select("t", "g", F.explode(F.slice("by", F.lit(1), n - F.ceil(n * least).cast("int") + 1)).alias("y")).select("t", "g", "y.x").toDF(*names)

    la, rb = prefix(a, ("lt", "lg", "x")), prefix(b, ("rt", "rg", "x"))
    fits = F.least(F.size("lg"), F.size("rg")) >= least * F.greatest(F.size("lg"), F.size("rg"))
    met = la.join(rb, "x").where(fits).groupBy("lt", "rt").agg(F.first("lg").alias("lg"), F.first("rg").alias("rg"))
    pairs = met.withColumn("common", F.size(F.array_intersect("lg", "rg")).cast("long")).withColumn("sim", F.col("common") / (F.size("lg") + F.size("rg") - F.col("common"))).where(F.col("sim") >= least)
    out = pairs.join(left.select(F.col(lid).alias("lid"), F.col(ltext).alias("lt")), "lt").join(right.select(F.col(rid).alias("rid"), F.col(rtext).alias("rt")), "rt")
    return out.select("lid", "rid", "common", "sim")


def patterns_in(df: DataFrame, text: str, patterns: DataFrame, pattern: str, inside: bool = False) -> DataFrame:
    """Rows of df with each pattern their text contains; patterns are deduplicated first.

    A literal is a run of whole words, or with inside=True any run of characters. It is found by an
    equi-join on the text's runs of each length that a pattern has, so the cost is the texts' words
    (characters) for each such length and not texts times patterns.
    """
    p = patterns.select(F.col(pattern).alias("pattern")).where("pattern IS NOT NULL").distinct()
    length = (lambda c: F.length(c)) if inside else (lambda c: F.size(F.split(c, " ")))
    lengths = p.agg(F.collect_set(length(F.col("pattern"))).alias("n")).scalar()
    texts = df.select(F.col(text).alias("t")).where("t IS NOT NULL").distinct().withColumn("n", F.explode(lengths)).where(length(F.col("t")) >= F.col("n"))
    words = F.split("t", " ")
    run = (lambda i: F.substring(F.col("t"), i, F.col("n"))) if inside else (lambda i: F.array_join(F.slice(words, i, F.col("n")), " "))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(length(F.col("t")) - F.col("n") + 1, F.lit(1))), run)
    found = texts.select("t", F.explode(F.array_distinct(runs)).alias("pattern")).join(p, "pattern")
    return df.join(found, df[text] == found.t).drop("t")


def term_starts(text: str, terms: DataFrame, term: str) -> tuple[Column, dict[str, Column]]:
    """What begins at each word of a text, cut at each length that terms have, as an array without repeats; and the columns that it is made of, to be added first. Both of words joined by single blanks."""
    shape = terms.select(F.col(term).alias("__term")).where("__term <> ''").agg(F.collect_set(F.length("__term")).alias("n"), F.max(F.size(F.split("__term", " "))).alias("words"))
    made = {"__lengths": shape.select("n").scalar(), "__most": shape.select(F.coalesce("words", F.lit(1))).scalar()}
    words = F.split(F.col(text), " ")
    runs = F.array_distinct(F.transform(words, lambda _, i: F.array_join(F.slice(words, i + 1, F.col("__most")), " ")))
    starts = F.transform(runs, lambda r: F.transform(F.filter(F.col("__lengths"), lambda n: n <= F.length(r)), lambda n: F.substring(r, F.lit(1), n)))
    return F.array_distinct(F.flatten(starts)), made


def terms_in(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Distinct texts with each of the terms that stands at the beginning of a word in them: both of words joined by single blanks.

    A term is compared with what begins at each word of a text, cut at each length that terms have, so the join is by
    equality and costs the texts' words times the terms' different lengths. Repeats are dropped within a text's row.
    """
    p = terms.select(F.col(term).alias("__term")).where("__term <> ''").distinct()
    starts, made = term_starts("__t", terms, term)
    found = texts.select(F.col(text).alias("__t")).where("__t <> ''").distinct().withColumns(made).select("__t", F.explode(starts).alias("__term")).join(p, "__term")
    return found.select(F.col("__t").alias(text), F.col("__term").alias(term))
