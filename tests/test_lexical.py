"""The lexical index, its queries as rows and cover density against plain versions."""

import random
import re

import pytest

from bidlake.plans import lexical


def plain_rank(groups_at: dict[int, set], need: int) -> float:
    """Shortest stretches that hold all groups, tried one by one."""
    places = sorted(groups_at)
    best = []
    for i in range(len(places)):
        for j in range(i, len(places)):
            if len(set().union(*(groups_at[p] for p in places[i : j + 1]))) == need:
                best.append((i, j))
                break
    shortest = [(i, j) for i, j in best if not any((a, b) != (i, j) and i <= a and b <= j for a, b in best)]
    return sum(0.1 / (1 + (places[j] - places[i]) - (j - i)) for i, j in shortest)


def plain_search(texts, queries):
    out = {}
    for qid, groups in queries.items():
        every = len(groups) <= 2
        for key, text in texts.items():
            words = [w for w in re.split(r"[^\w]+", text.lower()) if w] if text else []
            at = {}
            for pos, w in enumerate(words):
                hit = {g if every else 0 for g, alternatives in enumerate(groups) if any(w.startswith(t) if prefix else w == t for t, prefix in alternatives)}
                if hit:
                    at[pos] = hit
            need = len(groups) if every else 1
            if need and len(set().union(*at.values()) if at else ()) == need:
                out[qid, key] = round(plain_rank(at, need), 6)
    return out


def rows_of(queries):
    return [(qid, g, t, p, len(groups) if len(groups) <= 2 else 1) for qid, groups in queries.items() for g, alternatives in enumerate(groups) for t, p in alternatives]


@pytest.mark.parametrize("seed", [1, 2])
def test_search_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = ["a1", "a12", "b", "bb", "bbc", "c", "d_d", "e", "é", "срок", "сроки"]
    texts = {i: " ".join(rnd.choice(vocabulary) + rnd.choice(["", ",", "."]) for _ in range(rnd.randint(0, 40))) for i in range(60)} | {100: None, 101: "", 102: "... !", 103: "b " * 500, 104: "B c " * 100}
    queries = {1: [[("b", False)]], 2: [[("b", False)], [("c", False)]], 3: [[("a1", True)], [("bb", True), ("e", False)]], 4: [[("b", False)], [("c", False)], [("e", False)]], 5: [[("a1", True), ("a12", False)], [("a1", False)]], 6: [[("zz", False)], [("b", False)]], 7: [[("срок", True)]]}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    terms = spark.createDataFrame(rows_of(queries), "qid int, grp int, term string, prefix boolean, need int")
    got = {(r.qid, r.id): r["rank"] for r in lexical.search(lexical.postings(df, ["id"], "text"), terms, ["id"]).collect()}
    assert got == pytest.approx(plain_search(texts, queries))


@pytest.mark.parametrize("rows", [4000, 7])
def test_a_scan_finds_what_the_index_finds(spark, monkeypatch, rows):
    rnd = random.Random(rows)
    monkeypatch.setattr(lexical, "ROWS", rows)
    vocabulary = ["a1", "a12", "b", "bb", "bbc", "c", "d_d", "e", "é", "срок", "сроки"]
    texts = {i: " ".join(rnd.choice(vocabulary) + rnd.choice(["", ",", "."]) for _ in range(rnd.randint(0, 40))) for i in range(60)} | {100: None, 101: "", 102: "... !", 103: "b " * 500, 104: "B c " * 100}
    queries = {1: [[("b", False)]], 2: [[("b", False)], [("c", False)]], 3: [[("a1", True)], [("bb", True), ("e", False)]], 4: [[("b", False)], [("c", False)], [("e", False)]], 5: [[("a1", True), ("a12", False)], [("a1", False)]], 6: [[("zz", False)], [("b", False)]], 7: [[("срок", True)]]}
    df = spark.createDataFrame([(i, x, i % 3 if i % 5 else None) for i, x in texts.items()], "id long, text string, own long").repartition(3)
    terms = spark.createDataFrame(rows_of(queries), "qid int, grp int, term string, prefix boolean, need int")
    want = plain_search(texts, queries)
    found = lexical.scan(df, terms, ["id"])
    assert {(r.qid, r.id): r["rank"] for r in found.collect()} == pytest.approx(want)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    cut = {}
    for r in lexical.scan(df, terms, ["id"], k=4, within={q: q % 3 for q in queries}, column="own").collect():
        cut.setdefault(r.qid, []).append((-r["rank"], r.id))
    for q in queries:
        may = sorted((-v, i) for (p, i), v in want.items() if p == q and i % 5 and i % 3 == q % 3)[:4]
        assert [i for _, i in sorted(cut.get(q, []))[:4]] == [i for _, i in may]


def test_stretches_and_their_noise(spark):
    df = spark.createDataFrame([(1, "a x c a"), (2, "a c"), (3, "a a a"), (4, "c x x x x a")], "id long, text string")
    terms = spark.createDataFrame(rows_of({1: [[("a", False)], [("c", False)]]}), "qid int, grp int, term string, prefix boolean, need int")
    got = {r.id: r["rank"] for r in lexical.search(lexical.postings(df, ["id"], "text"), terms, ["id"]).collect()}
    assert got == {1: 0.15, 2: 0.1, 4: 0.02}


def test_queries_as_rows(spark):
    q = spark.createDataFrame([(1, "Kafolat muddati"), (2, "nasos"), (3, "what is the term x of the PAYMENT"), (4, ""), (5, None), (6, "a b")], "qid int, text string")
    rows = {}
    for r in lexical.term_rows(q).collect():
        rows.setdefault(r.qid, []).append((r.grp, r.term, r.prefix, r.groups, r.need))
    assert set(rows) == {1, 2, 3}
    assert {(g, t) for g, t, p, *_ in rows[1] if p} == {(0, "kafolat"), (0, "кафолат"), (0, "гарант"), (1, "muddat"), (1, "муддат"), (1, "срок")}
    assert (0, "kafolat", False, 2, 2) in rows[1] and (1, "муддати", False, 2, 2) in rows[1]
    assert {t for _, t, *_ in rows[2]} == {"nasos", "насос"}
    assert {n for *_, n in rows[3]} == {1} and {g for *_, g, _ in rows[3]} == {6}


def test_an_index_in_buckets(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i % 7} text{i}") for i in range(50)], "id long, text string")
    index = lexical.postings(df, ["id"], "text")
    path = str(tmp_path / "index")
    lexical.write_index(index, path, 8)
    exact = spark.createDataFrame(rows_of({1: [[("word3", False)]]}), "qid int, grp int, term string, prefix boolean, need int")
    begin = spark.createDataFrame(rows_of({1: [[("text4", True)]]}), "qid int, grp int, term string, prefix boolean, need int")
    for terms in (exact, begin):
        want = sorted(map(tuple, lexical.search(index, terms, ["id"]).collect()))
        assert want and sorted(map(tuple, lexical.search(lexical.read_index(spark, path, terms, 8), terms, ["id"]).collect())) == want
    assert lexical.read_index(spark, path, exact, 8).select("term").distinct().count() < index.select("term").distinct().count()


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "id long, text string")
    terms = spark.createDataFrame(rows_of({1: [[("word3", False)], [("x", True)]]}), "qid int, grp int, term string, prefix boolean, need int")
    assert lexical.search(lexical.postings(none, ["id"], "text"), terms, ["id"]).count() == 0


def test_nearest_to_is_exact(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)], i % 3) for i in range(200)] + [(300, None, 1), (301, [0.0] * 8, 2), (302, [1.0] * 8, None)]
    v = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(5)
    q = spark.createDataFrame([(7, [1.0] * 8, 1), (8, [1.0, -1.0] * 4, 2)], "qid long, q array<double>, label int")

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    for within in (None, "label"):
        got = {(r.qid, r.rn): r.id for r in lexical.nearest_to(v, q, 5, within).collect()}
        for qid, vec, label in ((7, [1.0] * 8, 1), (8, [1.0, -1.0] * 4, 2)):
            want = sorted(((-round(cosine(x, vec), 7), i) for i, x, lab in rows if x and any(x) and (within is None or lab == label)))[:5]
            assert [got[qid, k + 1] for k in range(5)] == [i for _, i in want]
