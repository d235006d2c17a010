"""Exact quantiles against sorted lists: hot groups, ties, nulls, single values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.operators.quantiles import quantiles, with_quantiles


def plain(values, q, how):
    v = sorted(x for x in values if x is not None and not math.isnan(x))
    if not v:
        return None
    return float(np.quantile(v, q)) if how == "linear" else v[max(math.ceil(q * len(v)) - 1, 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_against_sorted_lists(spark, seed):
    rnd = random.Random(seed)
    draw = {"hot": lambda: rnd.gauss(0, 1), "ties": lambda: rnd.choice([1.0, 1.0, 2.0]), "few": lambda: rnd.random() * 1e9, None: lambda: rnd.choice([None, 3.0, float("nan")]), "none": lambda: None, "one": lambda: 7.0}
    size = {"hot": 6000, "ties": 500, "few": 3, None: 40, "none": 5, "one": 1}
    rows = [(g, draw[g](), k % 2) for g, n in size.items() for k in range(n)]
    df = spark.createDataFrame(rows, "g string, v double, odd int").repartition(5)
    wanted = {"a": (F.col("v"), 0.5, "linear"), "b": (F.col("v"), 0.95, "linear"), "c": (F.col("v"), 0.95, "nearest"), "d": (F.when(F.col("odd") == 1, F.col("v")), 0.1, "linear"), "e": (F.col("v"), 0.0, "nearest"), "f": (F.col("v"), 1.0, "linear")}
    got = {r.g: r for r in quantiles(df, ["g"], wanted).collect()}
    assert set(got) == set(size)
    for g in size:
        values = [v for h, v, _ in rows if h == g]
        odd = [v for h, v, o in rows if h == g and o == 1]
        for name, (_, q, how) in wanted.items():
            want = plain(odd if name == "d" else values, q, how)
            assert got[g][name] is None if want is None else got[g][name] == pytest.approx(want, rel=1e-12), (g, name)


def test_quantiles_beside_aggregates(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", 2.0)], "g string, v double")
    got = with_quantiles(df.groupBy("g").agg(F.count(F.lit(1)).alias("n")), df, ["g"], {"m": (F.col("v"), 0.5, "linear")})
    assert sorted(((r.g, r.n, r.m) for r in got.collect()), key=repr) == [("x", 1, 2.0), (None, 2, 2.0)]
    assert quantiles(df.where("false"), ["g"], {"m": (F.col("v"), 0.5, "linear")}).count() == 0


def test_no_task_gets_a_group(spark):
    """What is looked at again is a part of the values, though one group holds all rows."""
    df = spark.range(200_000).select(F.lit("all").alias("g"), F.rand(3).alias("v"))
    from bidlake.operators import quantiles as module

    assert module.SPLITS > 100
    r = quantiles(df, ["g"], {"m": (F.col("v"), 0.5, "linear")}).first()
    assert abs(r.m - float(np.median([x.v for x in df.collect()]))) < 1e-12
