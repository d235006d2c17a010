"""Saved searches as rows, and notification runs, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from bidlake.plans import percolate
from bidlake.plans.domain import score

WORDS = ["red", "redder", "bolt", "bolts", "plate", "gear", "old", "x1"]
TENDERS = "id long, title string, goods string, area_path string, totalcost double, currency string, close_at timestamp"


def some(seed, n=80, m=60):
    rnd = random.Random(seed)
    tenders = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(0, 3))), rnd.choice([None, " ".join(rnd.choices(WORDS, k=4))]), rnd.choice(["33.1.2", "33.1", "33.10.1", None]), rnd.choice([None, 50.0, 150.0, 500.0]), rnd.choice(["USD", "EUR", None]), None) for i in range(n)]
    keywords = lambda: rnd.choice([[], None]) if rnd.random() < 0.2 else [" ".join(rnd.choices(["red", "bolt", "gear", "pla", "old"], k=rnd.randint(1, 2))) for _ in range(rnd.randint(1, 3))]
    searches = [(i, keywords(), rnd.choice([None, [], ["33.1"], ["33.2", "33.10"]]), rnd.choice([None, 100.0]), rnd.choice([None, 200.0]), rnd.choice([None, "USD"])) for i in range(m)]
    return tenders, searches


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_score_as_the_profile_does(spark, seed):
    tenders, searches = some(seed)
    t = spark.createDataFrame(tenders, TENDERS).withColumn("blob", F.concat_ws(" ", "title", "goods"))
    s = spark.createDataFrame(searches, "sid long, keywords array<string>, regions array<string>, low double, high double, wants string")
    got = {(r.id, r.sid): r.score for r in percolate.percolated(t, s).collect()}
    want = {}
    each = t.select("id", *[score(k, regions or [], low, high, cur)["score"].alias(f"s{sid}") for sid, k, regions, low, high, cur in searches if k and len(set(k)) == len(k)])
    for r in each.collect():
        for sid, k, *_ in searches:
            if k and len(set(k)) == len(k) and r[f"s{sid}"] >= percolate.LEAST:
                want[r.id, sid] = r[f"s{sid}"]
    simple = {sid for sid, k, *_ in searches if k and len(set(k)) == len(k)}
    assert {k: v for k, v in got.items() if k[1] in simple} == want and want
    assert not any(not k for sid, k, *_ in searches for _, other in got if other == sid)


def test_a_low_threshold_is_refused(spark):
    tenders, searches = some(1)
    with pytest.raises(ValueError):
        percolate.percolated(None, None, 40)


def test_the_plan_does_not_grow_with_the_searches(spark):
    tenders, _ = some(1)
    t = spark.createDataFrame(tenders, TENDERS).withColumn("blob", F.concat_ws(" ", "title", "goods"))
    schema = "sid long, keywords array<string>, regions array<string>, low double, high double, wants string"
    sizes = []
    for n in (1, 10_000):
        s = spark.createDataFrame([(i, [WORDS[i % 8]], None, None, None, None) for i in range(n)], schema)
        plan = percolate.percolated(t, s)._jdf.queryExecution().optimizedPlan()
        sizes.append(len(str(plan.treeString()).splitlines()))
    assert sizes[0] == sizes[1]
    assert percolate.percolated(t, s).select("sid").distinct().count() > 5000


def test_notification_runs_against_plain_lists(spark):
    rnd = random.Random(4)
    cands = [(c, i, rnd.choice([60, 100, 80]), None) for c in range(2) for i in range(c, 60, 2)]
    subs = [(k, k % 3) for k in range(20)]
    sent = sorted({(rnd.randrange(20), rnd.randrange(80)) for _ in range(300)})
    f = percolate.notified(spark.createDataFrame(cands, "company_id long, id long, score int, close_at timestamp"), spark.createDataFrame(subs, "sub long, company_id long"), spark.createDataFrame(sent, "sub long, id long"), 7)
    got = {}
    for r in f.collect():
        got.setdefault(r.sub, {})[r.rn] = r.id
    for sub, company in subs:
        own = sorted((-s, i) for c, i, s, _ in cands if c == company)
        want = [i for _, i in own if (sub, i) not in sent][:7]
        assert [got.get(sub, {}).get(k + 1) for k in range(len(want))] == want and len(got.get(sub, {})) == len(want)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_best_searches_are_the_best_pairs(spark, seed):
    """Without the pairs: by classes of searches, over shared keywords, open bounds, equal bounds and ties."""
    rnd = random.Random(seed)
    tenders, searches = some(seed, m=250)
    searches = [(sid, rnd.choice([["red"], ["bolt", "gear"], ["old", "red"], [], None]), r, rnd.choice([None, 60.0, 100.0]), rnd.choice([None, 50.0, 150.0, 200.0, 400.0, 600.0]), w, sid % 3) for sid, _, r, _, _, w in searches]
    t = spark.createDataFrame(tenders, TENDERS).withColumn("blob", F.concat_ws(" ", "title", "goods"))
    s = spark.createDataFrame(searches, "sid long, keywords array<string>, regions array<string>, low double, high double, wants string, company_id long")
    want, alone = {}, {}
    for r in percolate.percolated(t, s).collect():
        for best, k in ((want, (r.id, r.sid % 3)), (alone, r.id)):
            best[k] = max(best.get(k, (0, 0)), (r.score, -r.sid))
    got = {(r.id, r.company_id): (r.score, -r.sid) for r in percolate.best_searches(t, s, ("company_id",)).collect()}
    assert got == want and len(want) > 50
    assert {r.id: (r.score, -r.sid) for r in percolate.best_searches(t, s).collect()} == alone


@pytest.mark.parametrize("name", ["D7_notification_score", "D9_saved_search_counts", "D58_notification_run"])
def test_tenders_meet_lists_of_keywords_not_searches(spark, monkeypatch, tmp_path, name):
    """Four times the searches, with the same lists of keywords: no more pairs."""
    from bidlake import catalog

    seen, hits = [], percolate.keyword_hits
    monkeypatch.setattr(percolate, "keyword_hits", lambda t, s: seen.append(hits(t, s)) or seen[-1])
    catalog.queries()
    source = "/root/testdata/sf0.001"
    real = percolate.raw
    for n in (1, 4):

        def more(spark, sf, table, n=n):
            df = real(spark, sf, table)
            return df.crossJoin(spark.range(n).withColumnRenamed("id", "__i")).withColumn("s_suppkey", F.col("s_suppkey") + F.col("__i") * 300).drop("__i") if table == "supplier" else df

        monkeypatch.setattr(percolate, "raw", more)
        catalog.queries()[name](spark, source)
    few, many = (f.count() for f in seen)
    assert few == many > 0


SEARCHES = "sid long, keywords array<string>, regions array<string>, low double, high double, wants string, company_id long"


def shuffles(df):
    """Exchanges of rows in a plan, broadcasts aside."""
    return sum("Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x for x in str(df._jdf.queryExecution().executedPlan()).split("== Initial Plan ==")[-1].splitlines())


def test_words_and_pairs_stay_where_their_tender_is(spark):
    """What texts are cut into, and tenders' pairs with searches, are never shuffled where the searches are few."""
    tenders, searches = some(1)
    t = spark.createDataFrame(tenders, TENDERS).withColumn("blob", F.concat_ws(" ", "title", "goods")).repartition(4, "id")
    s = spark.createDataFrame([(*x, x[0] % 3) for x in searches], SEARCHES)
    own = shuffles(t)
    assert own == 1 and shuffles(percolate.keyword_hits(t, s)) == own and shuffles(percolate.best_scores(t, s, ("company_id",))) == own


@pytest.mark.parametrize("seed", [1, 2])
def test_best_scores_are_those_of_the_best_searches(spark, seed):
    tenders, searches = some(seed, m=250)
    t = spark.createDataFrame(tenders, TENDERS).withColumn("blob", F.concat_ws(" ", "title", "goods"))
    s = spark.createDataFrame([(*x, x[0] % 3) for x in searches], SEARCHES)
    want = {(r.id, r.company_id): r.score for r in percolate.best_searches(t, s, ("company_id",)).collect()}
    assert {(r.id, r.company_id): r.score for r in percolate.best_scores(t, s, ("company_id",)).collect()} == want and want


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 3), (3, 12), (4, 60)])
def test_no_tender_is_left_out_that_can_come_first(spark, seed, k):
    """Company 0 has many coded tenders, company 1 fewer than 60; then nothing may be left out. Deadlines are few, some are missing."""
    rnd = random.Random(seed)
    ends = {i: rnd.choice([None, *(f"1998-0{m}-01 00:00:00" for m in (6, 7, 8))]) for i in range(200)}
    rows = [(c, i, 100) for c in (0, 1) for i in rnd.sample(range(200), (90, 40)[c])]
    found = [(c, i, rnd.choice([100, 100, 90, 60])) for c in (0, 1) for i in rnd.sample(range(200), 120)]
    t = spark.createDataFrame(list(ends.items()), "id long, close_at string").withColumn("close_at", F.col("close_at").cast("timestamp"))
    pairs = lambda x: spark.createDataFrame(x, "company_id long, id long, score int").join(t, "id")
    coded = percolate.foremost(pairs(rows), k)
    left = {r.id for r in percolate.unsettled(t, spark.createDataFrame([(0,), (1,)], "company_id long"), coded, k).collect()}
    best = {}
    for c, i, s in rows + found:
        best[c, i] = max(best.get((c, i), 0), s)
    key = lambda c, i, s: (-s, ends[i] is None, ends[i] or "", i)
    for c in (0, 1):
        first = sorted((key(c, i, s), i) for (d, i), s in best.items() if d == c)[:k]
        assert {i for _, i in first} <= left | {i for d, i, _ in rows if d == c}
        own = sorted((key(c, i, s), i) for d, i, s in rows if d == c)[:k]
        assert [r.id for r in coded.where(F.col("company_id") == c).orderBy("place").collect()] == [i for _, i in own]
    assert len(left) < 200 if k < 40 else len(left) == 200


def test_runs_over_long_and_repeated_histories(spark):
    """Subscribers that were sent nearly all, all, or nothing, in rows that repeat, beside what others were sent."""
    rnd = random.Random(6)
    cands = [(c, i, rnd.choice([60, 100]), None) for c in range(2) for i in range(c, 90, 2)]
    ranks = {c: [i for _, i in sorted((-s, i) for d, i, s, _ in cands if d == c)] for c in range(2)}
    subs = [(k, k % 2) for k in range(8)]
    sent = [(0, i) for i in ranks[0]] + [(1, i) for i in ranks[1][:-3]] + [(2, i) for i in ranks[0][5:]] * 2 + [(3, i) for i in ranks[0]] + [(4, i) for i in ranks[0][1::2]] + [(99, 1)]
    f = percolate.notified(spark.createDataFrame(cands, "company_id long, id long, score int, close_at timestamp"), spark.createDataFrame(subs, "sub long, company_id long"), spark.createDataFrame(sent, "sub long, id long"), 7)
    got = {(r.sub, r.rn): r.id for r in f.collect()}
    assert got == {(s, k + 1): i for s, c in subs for k, i in enumerate([i for i in ranks[c] if (s, i) not in sent][:7])}
