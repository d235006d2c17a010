"""Queries and functions that take whole inputs, where a cut would show."""

from pyspark.sql import functions as F

from bidlake import catalog
from bidlake.sources.procurement import good, product, raw

SF = "/root/testdata/sf0.001"


def test_whole_texts_are_normalised(spark):
    got = catalog.queries()["X4b_norm_text_whole"](spark, SF).join(raw(spark, SF, "documents"), "doc_id")
    assert got.where(F.length("text") > 80).where(F.length("t") > 80).count() == got.where(F.length("text") > 80).count() > 0


def test_all_documents_count(spark):
    q, docs, labels = catalog.queries(), raw(spark, SF, "documents").select("doc_id"), raw(spark, SF, "labels").select("doc_id")
    ids = docs.union(labels).distinct().count()
    assert q["J7b_full_outer_all"](spark, SF).count() == ids
    assert q["V2c_document_coverage_all"](spark, SF).agg(F.sum("total")).first()[0] == ids
    assert q["V2d_orphans_all"](spark, SF).count() == labels.subtract(docs).count()


def test_every_equal_text_has_the_first_as_donor(spark):
    ids = {}
    for r in sorted(raw(spark, SF, "documents").select("doc_id", "text").collect()):
        ids.setdefault(r.text or "", []).append(r.doc_id)
    want = {(i, v[0]) for v in ids.values() for i in v[1:]}
    assert {tuple(r) for r in catalog.queries()["D38b_reuse_by_hash_all"](spark, SF).collect()} == want


def test_terms_of_all_products_are_matched(spark):
    terms = {w for r in product(spark, SF).where("company_id = 0 AND code IS NULL").collect() for w in r.keywords}
    want = {r.tender_id for r in good(spark, SF).select("tender_id", "name").collect() if terms & set(r.name.split(" "))}
    assert {r.id for r in catalog.queries()["D5b_text_match_all"](spark, SF).collect()} == want


def test_trigram_pairs_from_three_tenths_on(spark):
    got = catalog.queries()["J11b_trigram_names_words"](spark, SF).groupBy("kind").agg(F.min("sim").alias("least"), F.count(F.lit(1)).alias("n")).collect()
    assert {r.kind for r in got} >= {"name"} and all(0.3 <= r.least < 0.5 for r in got)


def test_patterns_of_any_length_and_inside_words(spark):
    from bidlake.plans.rewrites import patterns_in

    texts = ["big red steel bolts five", "bolts", "a", "", "x big red steel bolts five y"]
    pats = ["big red steel bolts five", "bolt", "red steel bolts five", "five", "bolts", "l", "", "big red steel bolts five y z"]
    t, p = spark.createDataFrame([(x,) for x in texts], "name string"), spark.createDataFrame([(x,) for x in [*pats, None]], "pattern string")
    got = lambda **k: {tuple(r) for r in patterns_in(t, "name", p, "pattern", **k).select("name", "pattern").collect()}
    assert got() == {(x, y) for x in texts for y in pats if f" {y} " in f" {x} "}
    assert got(inside=True) == {(x, y) for x in texts for y in pats if y in x}
