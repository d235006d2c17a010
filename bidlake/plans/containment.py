"""Codes for products from the goods of past lots, by set containment and overlap of near words.

A product is its name's tokens, a good its name's words; equal sets are compared once. Two words are near if they are equal but for up
to two letters at the end of the longer one, and one that a stem of six letters or more may lose; that is an equi-join of
stems with words cut by one and two letters. Sets meet by prefix filters on near words: a set that must be
covered whole meets others by its rarest word only; one of which two must be met leaves out its commonest word. Pairs that meet are tested with
the whole sets. So no common word brings sets together by itself.

Rules: whether all tokens of the product stand in the good's name (`product_in_good`), all words of the good among the tokens
(`good_in_product`, the standard), all of the shorter side in the other (`shorter_side`), or two of the tokens in the name (`two_tokens`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.catalog import register
from bidlake.functions.scalars import CANONICAL_SQL, SPELLINGS_SQL, canonical, spellings
from bidlake.functions.text import FOLD_FROM, FOLD_TO, fold
from bidlake.operators.filters import is_open
from bidlake.operators.ordering import top_per
from bidlake.plans.domain import OPEN_SQL
from bidlake.plans.rewrites import patterns_in
from bidlake.session import cut
from bidlake.sources.procurement import good, product, sql, tender

#: Words that say nothing about goods.
STOP = ["uchun", "bilan", "hamda", "yoki", "va", "the", "for", "with", "dlya", "and", "product", "mahsulot", "tovar", "xizmat", "usluga"]
TOKENS, EVIDENCE, SHARE, WEAK_SHARE, WEAK_EVIDENCE, RIVAL_GOODS, RIVAL_COVER = 4, 2, 0.75, 0.80, 4, 2, 0.5
RULES = ["good_in_product", "product_in_good", "shorter_side", "two_tokens"]
#: Policies: evidence, share, lead over the second code, and whether one family, the category and the head noun are looked at.
POLICIES = {"none": (2, 0.75, 0.00, False, False, False), "soft": (3, 0.85, 0.30, False, True, True), "middle": (4, 0.90, 0.50, True, True, True), "strict": (6, 1.00, 0.75, True, True, True)}
STANDARD = "middle"


def _said(words: Column) -> Column:
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP)))


def tokens(name: Column) -> Column:
    """A product's tokens: letters only, the longest four, in this order."""
    by = F.array_sort(F.transform(_said(F.regexp_extract_all(canonical(name), F.lit("([a-z]+)"), F.lit(1))), lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.slice(F.transform(by, lambda x: x["w"]), 1, TOKENS)


def all_words(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(canonical(name), " "), lambda w: w != "")))


def head_noun(name: Column) -> Column:
    """The last word that says something, without brackets, what stands before "for", and Cyrillic; empty if there is none."""
    t = F.regexp_extract(F.regexp_replace(name, r"\([^)]*\)", " "), r"^[^Ѐ-ӿ]*", 0)
    said = _said(F.regexp_extract_all(canonical(F.regexp_replace(t, r"(?is)^.* uchun", "")), F.lit("([a-z]+)"), F.lit(1)))
    return F.coalesce(F.try_element_at(said, F.lit(-1)), F.lit(""))


def is_near(probe: Column, word: Column) -> Column:
    """Whether a probe, or its stem, is the word or begins it with at most two letters missing."""
    fits = lambda b: (b == word) | ((F.length(b) >= 4) & F.startswith(word, b) & (F.length(word) - F.length(b) <= 2))
    return fits(probe) | ((F.length(probe) >= 6) & fits(F.substring(probe, F.lit(1), F.length(probe) - 1)))


def near_words(probes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """p, w for each probe (p) and word (w) that are near, by an equi-join."""
    cut = lambda c, n: F.substring(c, F.lit(1), F.length(c) - n)
    p, w = F.col("p"), F.col("w")
    left = probes.select("p").distinct().withColumn("b", F.explode(F.when(F.length(p) >= 6, F.array(p, cut(p, 1))).otherwise(F.array(p))))
    shorter = F.filter(F.array(cut(w, 1), cut(w, 2)), lambda b: F.length(b) >= 4)
    right = vocabulary.select("w").distinct().withColumn("b", F.explode(F.concat(F.array(w), shorter)))
    return left.join(right, "b").select("p", "w").distinct()


def _near_sets(sets: DataFrame, key: str, words: str, near: DataFrame, weight: DataFrame) -> DataFrame:
    """Each set with its words' near words on the other side: key, met: (how many of the other side's sets a word meets, the word, what is near it), the rarest first; only words with anything near."""
    rows = sets.select(key, F.explode(words).alias("p")).join(near, "p").join(weight, "w")
    by = rows.groupBy(key, "p").agg(F.sum("df").alias("df"), F.collect_set("w").alias("near"))
    return by.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("df", "p", "near"))).alias("met"))


def matched_sets(products: DataFrame, goods: DataFrame, rules: list[str] = RULES) -> DataFrame:
    """rule, pk, gk: the sets that each of the rules brings together. products: pk, tokens; goods: gk, words (all of a name's), said (those that say something)."""
    df = lambda sets, words: sets.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    by_rules = lambda pairs, held: pairs.select(F.explode(F.filter(F.array(*[F.when(ok, r) for r, ok in held.items() if r in rules]), lambda r: r.isNotNull())).alias("rule"), "pk", "gk")
    in_products = df(products, "tokens")
    of_goods = _near_sets(goods, "gk", "said", near_words(goods.select(F.explode("said").alias("p")), in_products), in_products)
    g = goods.join(of_goods, "gk").withColumn("size", F.size("said"))
    covered = lambda met, words: F.size(F.filter(met, lambda x: F.arrays_overlap(x["near"], words)))
    # all of the good's words: by its rarest one
    rare = g.where(F.size("met") == F.col("size")).select("gk", "met", F.col("size").alias("g_size"), F.explode(F.get("met", F.lit(0))["near"]).alias("t"))
    of = products.select("pk", "tokens", F.size("tokens").alias("p_size"), F.explode("tokens").alias("t"))
    inside = rare.join(of, "t").where(covered(F.col("met"), F.col("tokens")) == F.col("g_size")).select("gk", "pk", "g_size", "p_size").distinct()
    inside = by_rules(inside, {"good_in_product": F.lit(True), "shorter_side": F.col("g_size") <= F.col("p_size")})
    if set(rules) <= {"good_in_product"}:
        return inside
    # two of the product's tokens, or its only one: by as many of the rarest as one of them must be met; all of its tokens are met by some of these pairs
    in_goods = df(goods, "words")
    of_products = _near_sets(products, "pk", "tokens", near_words(products.select(F.explode("tokens").alias("p")), in_goods), in_goods)
    p = products.join(of_products, "pk").withColumn("size", F.size("tokens")).withColumn("need", F.least(F.lit(2), "size")).where(F.size("met") >= F.col("need"))
    first = F.slice("met", F.lit(1), F.size("met") - F.col("need") + 1)
    holds = goods.select("gk", "words", F.size("said").alias("g_size"), F.explode("words").alias("w"))
    keys = p.select("pk", "met", "need", "size", F.explode(F.array_distinct(F.flatten(F.transform(first, lambda x: x["near"])))).alias("w"))
    two = keys.join(holds, "w").withColumn("k", covered(F.col("met"), F.col("words"))).where("k >= need").select("gk", "pk", "g_size", "size", "k").distinct()
    whole = F.col("k") == F.col("size")
    return inside.unionByName(by_rules(two, {"two_tokens": F.lit(True), "product_in_good": whole, "shorter_side": whole & (F.col("g_size") > F.col("size")) & (F.col("g_size") > 0)}))


def _product_sets(products: DataFrame, divisions: DataFrame) -> DataFrame:
    """name, category, pk, tokens, known (the category's divisions) of distinct products, as a table."""
    names = products.select("name").distinct().withColumn("tokens", tokens(F.col("name")))
    known = divisions.groupBy("category").agg(F.sort_array(F.collect_set("division")).alias("known"))
    return cut(products.select("name", "category").distinct().join(names, "name").join(known, "category", "left").withColumn("pk", F.array_join("tokens", " ")), "products")


def good_sets(goods: DataFrame) -> DataFrame:
    """good, gk, words, said, code, n: names of goods (name, good_code) with their codes of eight characters and how many there are, as a table."""
    seen = goods.where("name IS NOT NULL AND length(good_code) >= 8").groupBy(F.col("name").alias("good"), F.substring("good_code", 1, 8).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    names = seen.select("good").distinct().withColumn("words", all_words(F.col("good"))).withColumn("said", F.array_sort(_said(F.col("words"))))
    return cut(seen.join(names, "good").withColumn("gk", F.array_join("words", " ")), "goods")


def evidence(products: DataFrame, goods: DataFrame, divisions: DataFrame, rules: list[str] = RULES) -> DataFrame:
    """What past lots say about each product by each of the rules: rule, name, category, pk, reason, code, evidence, total, share, weak, top (the three best codes: n, code), known (divisions).

    products: name, category; goods: from good_sets(); divisions: category, division (categories without any take all codes).
    Reasons: code; no_tokens; no_candidates (no good's name holds a token); words_differ (none passes the rule); little_evidence; ambiguous.
    """
    p, g = _product_sets(products, divisions), goods
    kinds = p.select("pk", "tokens", "category", "known").distinct()
    free = lambda code: F.col("known").isNull() | F.array_contains("known", F.substring(code, 1, 2))
    codes = g.groupBy("gk", "code").agg(F.sum("n").alias("n"))
    pairs = matched_sets(p.select("pk", "tokens").distinct().where(F.size("tokens") > 0), g.select("gk", "words", "said").distinct(), rules)
    counts = pairs.join(codes, "gk").groupBy("rule", "pk", "code").agg(F.sum("n").alias("n")).join(kinds.select("pk", "category", "known"), "pk").where(free("code"))
    of = Window.partitionBy("rule", "pk", "category")
    ranked = counts.withColumn("rn", F.row_number().over(of.orderBy(F.desc("n"), "code"))).withColumn("total", F.sum("n").over(of)).where("rn <= 3")
    top = ranked.groupBy("rule", "pk", "category").agg(F.first("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("rn", "n", "code"))), lambda x: F.struct(x["n"].alias("n"), x["code"].alias("code"))).alias("top"))
    # candidates: goods whose name holds a token, or its stem, in any spelling
    words = kinds.select("pk", F.explode("tokens").alias("t")).distinct()
    t = F.col("t")
    spelt = words.select("t").distinct().withColumn("b", F.explode(F.when(F.length(t) >= 6, F.array(t, F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(F.array(t)))).select("t", F.explode(spellings(F.col("b"))).alias("pattern")).where(F.length("pattern") >= 3)
    folded = g.select("good", fold("good").alias("f")).distinct()
    holding = patterns_in(folded, "f", spelt.select("pattern").distinct(), "pattern", inside=True).select("good", "pattern").join(spelt, "pattern").join(words, "t").select("pk", "good").distinct()
    candidates = holding.join(g.select("good", "code", "n"), "good").join(kinds.select("pk", "category", "known"), "pk").where(free("code")).select("pk", "category").distinct().withColumn("some", F.lit(True))
    every = p.withColumn("rule", F.explode(F.array(*map(F.lit, rules)))).join(candidates, ["pk", "category"], "left").join(top, ["rule", "pk", "category"], "left")
    best = F.get("top", F.lit(0))
    share = F.col("evidence") / F.col("total")
    every = every.withColumn("evidence", F.coalesce(best["n"], F.lit(0))).withColumn("total", F.coalesce("total", F.lit(0)))
    reason = F.when(F.size("tokens") == 0, "no_tokens").when(F.col("some").isNull(), "no_candidates").when(F.col("total") == 0, "words_differ").when(F.col("evidence") < EVIDENCE, "little_evidence").when(share < SHARE, "ambiguous").otherwise("code")
    weak = (F.col("reason") == "code") & (share < WEAK_SHARE) & (F.col("evidence") <= WEAK_EVIDENCE)
    every = every.withColumn("reason", reason)
    out = every.select("rule", "name", "category", "pk", "reason", best["code"].alias("code"), "evidence", "total", F.when(F.col("total") > 0, F.round(share, 3)).alias("share"), F.coalesce(weak, F.lit(False)).alias("weak"), "top", "known")
    return cut(out, "evidence")


def rivals(found: DataFrame, goods: DataFrame) -> DataFrame:
    """Families that compete for a product's head noun: rule, name, category, rival (the least division), of those with any.

    found: rows of evidence(); goods: from good_sets(). A family is a rival if two goods or more share words with the product, one of them half its words, none of
    the winner's tokens is among the family's, and the head noun, if there is one, is near one of those.
    """
    g = goods
    p = found.where("code IS NOT NULL").select("rule", "name", "category", "pk", "code", "known").withColumn("tokens", F.split("pk", " "))
    sets = g.select("gk", "said").distinct().where(F.size("said") > 0)
    near = near_words(sets.select(F.explode("said").alias("p")), p.select(F.explode("tokens").alias("w")))
    held = p.select("pk", F.explode("tokens").alias("w")).distinct()
    met = sets.select("gk", F.size("said").alias("size"), F.explode("said").alias("p")).join(near, "p").join(held, "w").groupBy("pk", "gk", "size").agg(F.countDistinct("p").alias("k"), F.collect_set("w").alias("by"))
    codes = g.groupBy("gk", "code").agg(F.sum("n").alias("n"))
    rows = met.join(codes, "gk").withColumn("cover", F.col("k") / F.col("size"))
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    families = rows.groupBy("pk", F.substring("code", 1, 2).alias("division")).agg(F.sum("n").alias("goods"), F.max("cover").alias("cover"), union("by").alias("by"))
    exact = rows.where("cover >= 1").groupBy("pk", "code").agg(union("by").alias("exact"))
    own = families.select("pk", F.col("division").alias("own"), F.col("by").alias("family"))
    w = p.withColumn("own", F.substring("code", 1, 2)).join(exact, ["pk", "code"], "left").join(own, ["pk", "own"], "left").withColumn("winner", F.coalesce("exact", "family")).where("winner IS NOT NULL").withColumn("head", head_noun(F.col("name")))
    j = w.join(families, "pk").where((F.col("division") != F.col("own")) & (F.col("goods") >= RIVAL_GOODS) & (F.col("cover") >= RIVAL_COVER) & ~F.arrays_overlap("by", "winner"))
    j = j.where(F.col("known").isNull() | F.array_contains("known", F.col("division")))
    j = j.where((F.col("head") == "") | F.exists("by", lambda t: is_near(F.col("head"), t) | is_near(t, F.col("head"))))
    return j.groupBy("rule", "name", "category").agg(F.min("division").alias("rival"))


def decided(found: DataFrame, rival: DataFrame) -> DataFrame:
    """Each product's fate under each policy: the columns of found, policy, decision (auto, queue, none), why.

    auto needs every check of the policy; the head noun's is made only if all others pass.
    """
    fields = ["evidence", "share", "lead", "family", "category", "head"]
    table = F.array(*[F.struct(F.lit(n).alias("policy"), *[F.lit(v).alias(f) for f, v in zip(fields, values, strict=True)]) for n, values in POLICIES.items()])
    rows = found.join(rival, ["rule", "name", "category"], "left").withColumn("pol", F.explode(table))
    sum_ = F.aggregate("top", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    lead = (F.get("top", F.lit(0))["n"] - F.coalesce(F.get("top", F.lit(1))["n"], F.lit(0))) / sum_
    families = F.size(F.array_distinct(F.transform("top", lambda x: F.substring(x["code"], 1, 2))))
    checks = {
        "evidence": F.col("evidence") >= F.col("pol.evidence"), "share": F.col("share") >= F.col("pol.share"), "lead": lead >= F.col("pol.lead"), "family": ~F.col("pol.family") | (families <= 1),
        "category": ~F.col("pol.category") | F.col("known").isNull() | F.array_contains("known", F.substring("code", 1, 2)),
    }
    plain = F.filter(F.array(*[F.when(~ok, n) for n, ok in checks.items()]), lambda x: x.isNotNull())
    failed = F.when((F.size(plain) == 0) & F.col("pol.head") & F.col("rival").isNotNull(), F.array(F.lit("head"))).otherwise(plain)
    is_code = F.col("reason") == "code"
    decision = F.when(is_code & (F.size(failed) == 0), "auto").when(is_code | F.col("reason").isin("little_evidence", "ambiguous"), "queue").otherwise("none")
    why = F.when(is_code & (F.size(failed) > 0), F.concat(F.lit("policy:"), F.array_join(failed, ","))).otherwise(F.col("reason"))
    return rows.select(*found.columns, F.col("pol.policy").alias("policy"), decision.alias("decision"), why.alias("why"), "rival")


# --- the queries ------------------------------------------------------------------------------------


def known_divisions(spark, sf) -> DataFrame:
    """A category's divisions are those of its products' confirmed codes."""
    return product(spark, sf).where("code IS NOT NULL").select("category", F.substring("code", 1, 2).alias("division")).distinct()


def _found(spark, sf, goods: DataFrame, confirmed: bool = False, rules: list[str] = RULES) -> DataFrame:
    p = product(spark, sf).where("code IS NOT NULL" if confirmed else "code IS NULL").select("name", "category").distinct()
    return evidence(p, goods, known_divisions(spark, sf), rules)


_NEAR = lambda p, w: f"(({p} = {w} OR (length({p}) >= 4 AND starts_with({w}, {p}) AND length({w}) - length({p}) <= 2)) OR (length({p}) >= 6 AND (left({p}, length({p}) - 1) = {w} OR (starts_with({w}, left({p}, length({p}) - 1)) AND length({w}) - length({p}) + 1 <= 2))))"
_HAS = lambda p, words, v: f"coalesce(list_bool_or(list_transform({words}, lambda {v}: {_NEAR(p, v)})), false)"
_SAID_SQL = lambda x: f"list_filter({x}, lambda w: length(w) >= 3 AND NOT list_contains({STOP!r}, w))"
_FIRSTS = lambda x: f"list_reduce(list_transform({x}, lambda y: [y]), lambda acc, y: CASE WHEN list_contains(acc, y[1]) THEN acc ELSE acc || y END, []::VARCHAR[])"
_LETTERS = lambda name: f"regexp_extract_all({CANONICAL_SQL(name)}, '[a-z]+')"


def _evidence_sql(where: str, prefix: str = "") -> str:
    """The oracle's evidence by trying every rule on every pair of distinct names: CTEs that end in {prefix}ev (rule, name, category, reason, code, evidence, total, share, weak, top, known)."""
    x = prefix
    return f"""{x}p0 AS (SELECT name, {_FIRSTS(_SAID_SQL(_LETTERS("name")))} AS tk FROM (SELECT DISTINCT name FROM product WHERE {where})), {x}p1 AS (SELECT name, list_transform(list_sort(list_transform(range(1, len(tk) + 1), lambda i: {{'n': -length(tk[i]), 'i': i, 'w': tk[i]}})), lambda s: s.w)[1:{TOKENS}] AS tokens FROM {x}p0),
    {x}dv AS (SELECT category, list(DISTINCT substr(code, 1, 2)) AS known FROM product WHERE code IS NOT NULL GROUP BY category), {x}pc AS (SELECT DISTINCT p.name, p.category, tokens, known FROM product p JOIN {x}p1 USING (name) LEFT JOIN {x}dv ON {x}dv.category = p.category WHERE {where}),
    {x}g0 AS (SELECT name AS good, substr(good_code, 1, 8) AS code, count(*) AS n FROM good WHERE length(good_code) >= 8 GROUP BY ALL), {x}g1 AS (SELECT good, words, {_SAID_SQL("words")} AS said FROM (SELECT good, list_distinct(list_filter(string_split({CANONICAL_SQL("good")}, ' '), lambda w: w <> '')) AS words FROM (SELECT DISTINCT good FROM {x}g0))),
    {x}rl AS (SELECT name, good, unnest(['good_in_product', 'product_in_good', 'shorter_side', 'two_tokens']) AS rule, unnest([gp, pg, CASE WHEN len(said) = 0 THEN false WHEN len(said) <= len(tokens) THEN gp ELSE pg END, two]) AS hit FROM
        (SELECT name, good, said, tokens, len(said) > 0 AND len(list_filter(said, lambda a: {_HAS("a", "tokens", "b")})) = len(said) AS gp, len(list_filter(tokens, lambda a: {_HAS("a", "words", "b")})) = len(tokens) AS pg, len(list_filter(tokens, lambda a: {_HAS("a", "words", "b")})) >= least(2, len(tokens)) AS two FROM {x}p1 JOIN {x}g1 ON len(tokens) > 0)),
    {x}ct AS (SELECT rule, pc.name, pc.category, code, sum(n) AS n FROM {x}rl r JOIN {x}g0 g USING (good) JOIN {x}pc pc ON pc.name = r.name WHERE hit AND (known IS NULL OR list_contains(known, substr(code, 1, 2))) GROUP BY ALL),
    {x}tp AS (SELECT rule, name, category, sum(n) AS total, list({{'n': n, 'code': code}} ORDER BY n DESC, code)[1:3] AS top FROM {x}ct GROUP BY ALL),
    {x}sp AS (SELECT name, b AS k, unnest(s) AS pat FROM (SELECT name, b FROM (SELECT name, unnest(tokens) AS t FROM {x}p1), unnest(CASE WHEN length(t) >= 6 THEN [t, left(t, length(t) - 1)] ELSE [t] END) AS u(b)) JOIN ({SPELLINGS_SQL(f"SELECT DISTINCT b AS name FROM (SELECT unnest(tokens) AS t FROM {x}p1), unnest(CASE WHEN length(t) >= 6 THEN [t, left(t, length(t) - 1)] ELSE [t] END) AS u(b)", "b2")}) ON b2 = b),
    {x}cd AS (SELECT DISTINCT pc.name, pc.category FROM {x}pc pc JOIN {x}sp sp ON sp.name = pc.name AND length(pat) >= 3 JOIN {x}g0 g ON contains(translate(lower(g.good), '{FOLD_FROM}', '{FOLD_TO}'), pat) AND (known IS NULL OR list_contains(known, substr(g.code, 1, 2)))),
    {x}al AS (SELECT r.rule, pc.*, cd.name IS NOT NULL AS met, coalesce(tp.total, 0) AS total, top, coalesce(top[1].n, 0) AS evidence, top[1].code AS code FROM {x}pc pc CROSS JOIN (SELECT unnest({RULES!r}) AS rule) r LEFT JOIN {x}cd cd ON cd.name = pc.name AND cd.category = pc.category LEFT JOIN {x}tp tp ON tp.rule = r.rule AND tp.name = pc.name AND tp.category = pc.category),
    {x}ev AS (SELECT *, CASE WHEN total > 0 THEN round(evidence / total, 3) END AS share, reason = 'code' AND evidence / total < {WEAK_SHARE} AND evidence <= {WEAK_EVIDENCE} AS weak FROM (SELECT *, CASE WHEN len(tokens) = 0 THEN 'no_tokens' WHEN NOT met THEN 'no_candidates' WHEN total = 0 THEN 'words_differ' WHEN evidence < {EVIDENCE} THEN 'little_evidence' WHEN evidence / total < {SHARE} THEN 'ambiguous' ELSE 'code' END AS reason FROM {x}al))"""


def _rival_sql(prefix: str = "") -> str:
    x = prefix
    head = f"coalesce(list_filter({_LETTERS('h')}, lambda w: length(w) >= 3 AND NOT list_contains({STOP!r}, w))[-1], '')"
    return f"""{x}wn AS (SELECT rule, name, category, tokens, code, known, {head} AS head FROM (SELECT *, regexp_replace(regexp_extract(regexp_replace(name, '\\([^)]*\\)', ' ', 'g'), '^[^\\x{{0400}}-\\x{{04FF}}]*'), '(?is)^.* uchun', '') AS h FROM {x}ev WHERE code IS NOT NULL)),
    {x}cv AS (SELECT w.name, g1.good, len(list_filter(said, lambda a: {_HAS("a", "tokens", "b")}))::DOUBLE / len(said) AS cover, list_filter(tokens, lambda t: coalesce(list_bool_or(list_transform(said, lambda a: {_NEAR("a", "t")})), false)) AS bys FROM (SELECT DISTINCT name, tokens FROM {x}wn) w JOIN {x}g1 g1 ON len(said) > 0),
    {x}cg AS (SELECT c.*, g.code, g.n FROM {x}cv c JOIN {x}g0 g USING (good) WHERE cover > 0), {x}fm AS (SELECT name, substr(code, 1, 2) AS division, sum(n) AS goods, max(cover) AS cover, list_distinct(flatten(list(bys))) AS bys FROM {x}cg GROUP BY ALL), {x}ex AS (SELECT name, code, list_distinct(flatten(list(bys))) AS bys FROM {x}cg WHERE cover >= 1 GROUP BY ALL),
    {x}rv AS (SELECT w.rule, w.name, w.category, min(f.division) AS rival FROM {x}wn w LEFT JOIN {x}ex e ON e.name = w.name AND e.code = w.code LEFT JOIN {x}fm o ON o.name = w.name AND o.division = substr(w.code, 1, 2) JOIN {x}fm f ON f.name = w.name AND f.division <> substr(w.code, 1, 2) AND f.goods >= {RIVAL_GOODS} AND f.cover >= {RIVAL_COVER} AND coalesce(e.bys, o.bys) IS NOT NULL AND NOT list_has_any(f.bys, coalesce(e.bys, o.bys)) AND (w.known IS NULL OR list_contains(w.known, f.division)) AND (w.head = '' OR coalesce(list_bool_or(list_transform(f.bys, lambda t: {_NEAR("w.head", "t")} OR {_NEAR("t", "w.head")})), false)) GROUP BY ALL)"""


_POLICY_VALUES = "pol AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {e}, {s}, {lead}, {f}, {c}, {h})" for n, (e, s, lead, f, c, h) in POLICIES.items()) + ") v(policy, p_evidence, p_share, p_lead, p_family, p_category, p_head))"


def _decided_sql(prefix: str = "") -> str:
    x = prefix
    return f"""{_POLICY_VALUES if not x else f"{x}po AS (SELECT * FROM pol)"}, {x}pl AS (SELECT e.*, rival, policy, p_head, list_filter([CASE WHEN evidence < p_evidence THEN 'evidence' END, CASE WHEN share < p_share THEN 'share' END, CASE WHEN (top[1].n - coalesce(top[2].n, 0))::DOUBLE / list_sum(list_transform(top, lambda t: t.n)) < p_lead THEN 'lead' END, CASE WHEN p_family AND len(list_distinct(list_transform(top, lambda t: substr(t.code, 1, 2)))) > 1 THEN 'family' END, CASE WHEN p_category AND known IS NOT NULL AND NOT list_contains(known, substr(code, 1, 2)) THEN 'category' END], lambda c: c IS NOT NULL) AS plain FROM {x}ev e CROSS JOIN pol LEFT JOIN {x}rv r ON r.rule = e.rule AND r.name = e.name AND r.category = e.category),
    {x}de AS (SELECT *, CASE WHEN reason = 'code' AND len(failed) = 0 THEN 'auto' WHEN reason IN ('code', 'little_evidence', 'ambiguous') THEN 'queue' ELSE 'none' END AS decision, CASE WHEN reason = 'code' AND len(failed) > 0 THEN 'policy:' || array_to_string(failed, ',') ELSE reason END AS why FROM (SELECT *, CASE WHEN len(plain) = 0 AND p_head AND rival IS NOT NULL THEN ['head'] ELSE plain END AS failed FROM {x}pl))"""


@register("D28_evidence_classifier", sql("product good", f", {_evidence_sql('code IS NULL')} SELECT rule, name, category, reason, code, evidence::BIGINT AS evidence, total::BIGINT AS total, share, weak FROM ev"))
def d28(spark, sf):
    return _found(spark, sf, good_sets(good(spark, sf))).select("rule", "name", "category", "reason", "code", "evidence", "total", "share", "weak")


@register("D29_policy_gate", sql("product good", f", {_evidence_sql('code IS NULL')}, {_rival_sql()}, {_decided_sql()} SELECT policy, name, category, decision, why FROM de WHERE rule = '{RULES[0]}'"))
def d29(spark, sf):
    """The standard rule's findings under every policy."""
    g = good_sets(good(spark, sf))
    found = _found(spark, sf, g, rules=RULES[:1])
    return decided(found, rivals(found, g)).select("policy", "name", "category", "decision", "why")


@register("D30_head_noun_conflict", sql("product good", f", {_evidence_sql('code IS NULL')}, {_rival_sql()} SELECT w.name, w.category, w.head, rival FROM wn w LEFT JOIN rv USING (rule, name, category) WHERE w.rule = '{RULES[0]}'"))
def d30(spark, sf):
    g = good_sets(good(spark, sf))
    found = _found(spark, sf, g, rules=RULES[:1])
    return found.where("code IS NOT NULL").select("name", "category", head_noun(F.col("name")).alias("head")).join(rivals(found, g).drop("rule"), ["name", "category"], "left")


@register("D54_reevaluate_codes", sql("product good", f""", {_evidence_sql('code IS NULL')}, {_evidence_sql('code IS NOT NULL', 'k_')}, {_rival_sql('k_')}, {_POLICY_VALUES}, {_decided_sql('k_')}
    SELECT product_id, CASE WHEN reason = 'code' AND NOT weak THEN 'apply' ELSE 'leave' END AS action, CASE WHEN reason = 'code' AND NOT weak THEN ev.code END AS code FROM product p JOIN ev ON ev.name = p.name AND ev.category = p.category AND rule = '{RULES[0]}' WHERE p.code IS NULL
    UNION ALL SELECT product_id, CASE WHEN decision = 'auto' AND d.code = p.code THEN 'keep' ELSE 'look_again' END, d.code FROM product p JOIN k_de d ON d.name = p.name AND d.category = p.category AND d.rule = '{RULES[0]}' AND policy = '{STANDARD}' WHERE p.code IS NOT NULL"""))
def d54(spark, sf):
    """Codes in batch: sure ones are applied to products without; confirmed ones that the standard policy wouldn't give today are marked, none is taken away."""
    p, g = product(spark, sf), good_sets(good(spark, sf))
    new = p.where("code IS NULL").select("product_id", "name", "category").join(_found(spark, sf, g, rules=RULES[:1]), ["name", "category"])
    sure = (F.col("reason") == "code") & ~F.col("weak")
    new = new.select("product_id", F.when(sure, "apply").otherwise("leave").alias("action"), F.when(sure, F.col("code")).alias("code"))
    again = _found(spark, sf, g, confirmed=True, rules=RULES[:1])
    again = decided(again, rivals(again, g)).where(F.col("policy") == STANDARD).select("name", "category", "decision", F.col("code").alias("found"))
    old = p.where("code IS NOT NULL").join(again, ["name", "category"])
    same = (F.col("decision") == "auto") & F.coalesce(F.col("found") == F.col("code"), F.lit(False))
    return new.unionByName(old.select("product_id", F.when(same, "keep").otherwise("look_again").alias("action"), F.col("found").alias("code")))


@register("D55_what_if", sql("product good tender", f""", {_evidence_sql('code IS NULL')}, {_rival_sql()}, {_decided_sql()}, ov AS (SELECT substr(good_code, 1, 8) AS code, CAST(sum(totalcost_item) AS DOUBLE) AS value FROM good JOIN tender t ON tender_id = t.id WHERE {OPEN_SQL} GROUP BY 1),
    vl AS (SELECT rule, policy, decision, sum(value) AS value FROM (SELECT DISTINCT rule, policy, decision, code FROM de WHERE code IS NOT NULL) JOIN ov USING (code) GROUP BY ALL), sm AS (SELECT rule, policy, decision, string_agg(name, ';' ORDER BY rn) AS sample FROM (SELECT rule, policy, decision, name, row_number() OVER (PARTITION BY rule, policy, decision ORDER BY md5('20260912' || name), name) AS rn FROM (SELECT DISTINCT rule, policy, decision, name FROM de)) WHERE rn <= 3 GROUP BY ALL)
    SELECT rule, policy, decision, n, round(coalesce(value, 0), 2) AS value, sample FROM (SELECT rule, policy, decision, count(*) AS n FROM de GROUP BY ALL) LEFT JOIN vl USING (rule, policy, decision) LEFT JOIN sm USING (rule, policy, decision)"""))
def d55(spark, sf):
    """All rules and policies side by side: how many products each decides how, what open tenders ask for of those codes, and three names by a fixed seed."""
    g = good(spark, sf)
    sets = good_sets(g)
    found = _found(spark, sf, sets)
    parts = cut(decided(found, rivals(found, sets)), "decided")
    key = ["rule", "policy", "decision"]
    asked = g.join(tender(spark, sf).where(is_open()).select("id"), F.col("tender_id") == F.col("id")).groupBy(F.substring("good_code", 1, 8).alias("code")).agg(F.sum("totalcost_item").cast("double").alias("value"))
    n = parts.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    value = parts.where("code IS NOT NULL").select(*key, "code").distinct().join(asked, "code").groupBy(*key).agg(F.sum("value").alias("value"))
    names = parts.select(*key, "name").distinct().withColumn("h", F.md5(F.concat(F.lit("20260912"), F.col("name")).cast("binary")))
    sample = top_per(names, key, 3, "h", "name").groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]), ";").alias("sample"))
    return n.join(value, key, "left").join(sample, key, "left").select(*key, "n", F.round(F.coalesce("value", F.lit(0.0)), 2).alias("value"), "sample")


@register("D56_why_no_suggestion", sql("product good", f", {_evidence_sql('code IS NULL')} SELECT product_id, reason AS why, evidence::BIGINT AS evidence, total::BIGINT AS total FROM product p JOIN ev ON ev.name = p.name AND ev.category = p.category AND rule = '{RULES[0]}' WHERE p.code IS NULL"))
def d56(spark, sf):
    """For each product without a code, how far the standard rule came with it."""
    found = _found(spark, sf, good_sets(good(spark, sf)), rules=RULES[:1]).select("name", "category", F.col("reason").alias("why"), "evidence", "total")
    return product(spark, sf).where("code IS NULL").select("product_id", "name", "category").join(found, ["name", "category"]).drop("name", "category")
