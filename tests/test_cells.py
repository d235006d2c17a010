"""Vector search by cells against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.plans import cells
from bidlake.sources.procurement import raw

DATA = "/root/testdata/sf0.1"


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5


def vectors(seed, n=150, d=6):
    rnd = random.Random(seed)
    base = [[rnd.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    rows = [(i, rnd.choice(["a", "b", None]), [x + rnd.gauss(0, 0.3) for x in rnd.choice(base)]) for i in range(n)]
    rows += [(1000 + i, "a", [1.0] * d) for i in range(40)]  # a crowd of copies
    return rows + [(2000, "a", None), (2001, "b", [0.0] * d), (2002, "c", [1.0] + [0.0] * (d - 1)), (None, "a", [1.0] * d)]


@pytest.mark.parametrize("seed, block", [(1, 512), (2, 7)])
def test_exact_neighbours_against_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(cells, "BLOCK", block)
    rows = vectors(seed)
    df = spark.createDataFrame(rows, "id long, label string, v array<double>").repartition(4)
    got = {}
    for r in cells.nearest_neighbours(df.where("label IS NOT NULL"), "id", "v", 5, group="label", probes=1, cells=9).collect():
        got.setdefault(r.id, []).append((round(-r.s, 9), r.other))
    usable = [(i, g, v) for i, g, v in rows if i is not None and g is not None and v is not None and any(v)]
    for i, g, v in usable:
        want = sorted((round(-cosine(v, w), 9), j) for j, h, w in usable if h == g and j != i)[:5]
        assert [s for s, _ in sorted(got.get(i, []))] == pytest.approx([s for s, _ in want], abs=1e-8)
        if i >= 1000 and g == "a":
            assert sorted(j for _, j in got[i]) == [j for j in range(1000, 1040) if j != i][:5]


def test_the_second_step_leaves_cells_out(spark):
    """Well separated groups: cells far away aren't looked into, and the answer is still exact."""
    rng = np.random.default_rng(1)
    base = np.eye(8)
    rows = [(i, (base[i % 8] + rng.normal(0, 0.02, 8)).tolist()) for i in range(400)]
    u = cells.unit_rows(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    centroids = cells.fit(u, 8)
    indexed = cells.index(u, centroids)
    asks = u.where("id < 16").select(F.col("id").alias("qid"), "g", "v")
    radius = {r.cell: r.far for r in indexed.groupBy("cell").agg(F.max("far").alias("far")).collect()}
    found = cells.search(indexed, asks, centroids, 3, 2)
    wide = asks.join(found.groupBy("qid").agg(F.min("s").alias("s")), "qid").withColumn("reach", F.sqrt(2 - 2 * F.col("s")))
    assert cells._asked(wide.drop("s"), centroids, 2, radius).count() < 16 * (len(centroids) - 2) / 2


def test_recall_of_the_approximate_search(spark):
    """At ten, against exact, on the tables: every row is indexed."""
    from bidlake import catalog

    found = catalog.queries()["D27c_cell_search"](spark, DATA).cache()
    rows = cells.unit_rows(raw(spark, DATA, "embeddings"), "vec_id", "embedding")
    v = {r.id: r.v for r in rows.collect()}
    ids = np.array(sorted(v))
    m = np.array([v[i] for i in ids])
    truth = []
    for q in ids[ids % cells.ASKED == 0]:
        s = m @ np.array(v[q])
        s[ids == q] = -2
        truth += [(int(q), int(ids[j])) for j in np.lexsort((ids, -s))[:10]]
    assert cells.recall(found, spark.createDataFrame(truth, "qid long, id long"), ["qid", "id"]) >= 0.9
    centroids = cells.fit(rows)
    assert cells.index(rows, centroids).count() == len(ids)


def test_an_index_as_a_table(spark, tmp_path):
    rows = cells.unit_rows(spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(50)], "id long, v array<double>"), "id", "v")
    centroids = cells.fit(rows)
    cells.write_index(cells.index(rows, centroids), str(tmp_path / "cells"), 4)
    kept = cells.read_index(spark, str(tmp_path / "cells"))
    asks = rows.where("id < 3").select(F.col("id").alias("qid"), "g", "v")
    run = lambda i: sorted((r.qid, r.id, r.rn) for r in cells.search(i, asks, centroids, 4, 2).collect())
    assert run(kept) == run(cells.index(rows, centroids))


def test_cells_of_nothing(spark):
    none = spark.createDataFrame([], "id long, label string, v array<double>")
    assert cells.nearest_neighbours(none, "id", "v", 3, group="label").count() == 0


@pytest.mark.parametrize("exact", [False, True])
def test_a_query_is_sent_once_a_block_not_once_a_cell(spark, monkeypatch, exact):
    """Noise, where nearly all cells are looked into: the rows that meet don't grow with the cells."""
    rng = np.random.default_rng(2)
    u = cells.unit_rows(spark.createDataFrame([(i, rng.normal(0, 1, 16).tolist()) for i in range(300)], "id long, v array<double>"), "id", "v")
    centroids = cells.fit(u, 30)
    sent = []
    deal = type(u.groupBy("id")).cogroup
    monkeypatch.setattr(type(u.groupBy("id")), "cogroup", lambda a, b: sent.append((a._df, b._df)) or deal(a, b))
    found = cells.search(cells.index(u, centroids), u.select(F.col("id").alias("qid"), "g", "v"), centroids, 5, 25, exact)
    m = np.array([r.v for r in u.orderBy("id").collect()])
    s = m @ m.T
    got = {}
    for r in found.collect():
        got.setdefault(r.qid, []).append((r.rn, r.id))
    if exact:
        assert all([j for _, j in sorted(got[i])] == [int(j) for j in np.lexsort((np.arange(300), -s[i]))[:5]] for i in range(300))
    assert sent and all(a.count() <= 300 and b.count() <= 300 for a, b in sent)
