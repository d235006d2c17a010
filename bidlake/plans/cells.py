"""Nearest vectors by an inverted file: cells around centroids, stored as a table, probed by queries that are rows.

Centroids are fitted on a bounded sample (SAMPLE rows, by a hash of the id); every vector is indexed under its nearest one. A
query looks into the cells whose centroids are nearest to it, within its own group if there is one: the filter comes before the
cut, so a small group loses nothing. With `exact` a second step looks into each further cell that
could hold something nearer than what was found, by the triangle inequality on the cell's radius; without it the answer is approximate,
and `recall` measures how much is found.

Work is dealt as pairs of blocks: a group's vectors and its queries, in the order of their cells, are cut into blocks of BLOCK, and a task holds one of each; how
many cells a query looks into doesn't change how often it is sent. Equal vectors
are compared once: of a crowd of copies only the k + 1 smallest ids can be among anybody's k nearest, and all ask the same question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidlake.catalog import register
from bidlake.operators.ordering import top_per
from bidlake.session import ship
from bidlake.sources.procurement import raw

BLOCK, CHUNK, SAMPLE, MOST_CELLS, ROUNDS = 8192, 256, 20_000, 1024, 8


def unit_rows(df: DataFrame, key: str, vec: str, group: str | None = None) -> DataFrame:
    """id, g, v (unit length, doubles); null and zero vectors have no direction and go."""
    v = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = df.select(F.col(key).alias("id"), (F.col(group) if group else F.lit(0)).alias("g"), v.alias("v")).where(F.col("id").isNotNull()).withColumn("norm", norm)
    return rows.where("norm > 0").select("id", "g", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def fit(rows: DataFrame, cells: int | None = None):
    """Centroids from at most SAMPLE rows: Lloyd rounds on the driver over that sample; about as many cells as the root of the number of rows."""
    import numpy as np

    n = rows.count()
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not sample:
        return np.zeros((0, 0))
    x = np.array([r.v for r in sample])
    k = min(cells or max(1, int(n**0.5)), MOST_CELLS, len(x))
    centroids = x[np.unique(np.linspace(0, len(x) - 1, k).astype(int))]
    for _ in range(ROUNDS):
        owner = np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)
        counts = np.bincount(owner, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, x)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def _distances(v, centroids):
    import numpy as np

    return np.sqrt(np.maximum((v**2).sum(1)[:, None] - 2 * v @ centroids.T + (centroids**2).sum(1), 0))


def index(rows: DataFrame, centroids) -> DataFrame:
    """id, g, v, cell, far (distance to the cell's centroid): every row."""

    def assign(batches):
        import numpy as np

        for pdf in batches:
            if len(pdf) and not len(centroids):
                yield pdf.assign(cell=np.int32(0), far=0.0)
            elif len(pdf):
                d = _distances(np.stack(pdf["v"]), centroids)
                yield pdf.assign(cell=d.argmin(1).astype("int32"), far=d.min(1))

    return rows.mapInPandas(assign, f"{_schema(rows)}, cell int, far double")


def write_index(indexed: DataFrame, path: str, buckets: int = 64) -> None:
    """Keep an index as a table of buckets of cells."""
    indexed.withColumn("bucket", F.pmod("cell", F.lit(buckets))).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _near(v, centroids, probes: int):
    """For each row of v, whether each cell is one of the `probes` nearest."""
    import numpy as np

    take = np.zeros((len(v), len(centroids)), bool)
    np.put_along_axis(take, np.argsort(_distances(v, centroids), axis=1, kind="stable")[:, :probes], True, axis=1)
    return take


def _asked(queries: DataFrame, centroids, probes: int, radius: dict[int, float] | None) -> DataFrame:
    """Queries with the cells they look into (qid, g, cell): the `probes` nearest; or, given the cells' radii, the others that could hold something as near as `reach`."""

    def ask(batches):
        import numpy as np
        import pandas as pd

        far = None if radius is None else np.array([radius.get(c, -1.0) for c in range(len(centroids))])
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.stack(pdf["v"])
            take = _near(v, centroids, probes)
            if far is not None:
                take = ~take & (far >= 0) & (_distances(v, centroids) - far <= pdf["reach"].to_numpy()[:, None] + 1e-9)
            row, cell = np.nonzero(take)
            for k in range(0, len(row), 20_000):
                yield pd.DataFrame({"qid": pdf["qid"].to_numpy()[row[k : k + 20_000]], "g": pdf["g"].to_numpy()[row[k : k + 20_000]], "cell": cell[k : k + 20_000].astype("int32")})

    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    return queries.mapInPandas(ask, f"qid {kinds['qid']}, g {kinds['g']}, cell int")


def _best(s, ids, k: int):
    """Columns of the k greatest of each row of s, ties by id; at most k of them, in no order. Only what reaches a row's k-th value is sorted."""
    import numpy as np

    if s.shape[1] <= k:
        return np.nonzero(s > -np.inf)
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    row, col = np.nonzero((s >= least[:, None]) & (s > -np.inf))
    order = np.lexsort((ids[col], -s[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], col[keep]


def _compared(queries: DataFrame, indexed: DataFrame, k: int, centroids, probes: int, radius: dict[int, float] | None = None) -> DataFrame:
    """qid, id, s: the k best of each query in each pair of blocks, of the cells that it looks into.

    A vector goes to a task once for each block of queries, and a query once for each block of vectors, however many cells it looks into:
    the blocks are of BLOCK rows, and the task finds out the cells again from the centroids. Blocks of vectors follow the cells, so that with
    `radius` (the second step) pairs of blocks without a cell that is asked for are left out.
    """
    def number(df: DataFrame, key: str, at: str) -> DataFrame:
        """Blocks along the cells: a cell's rows, by a hash of their id, take up the places behind those of the cells before it."""
        before = F.sum("rows").over(Window.partitionBy("g").orderBy("cell")) - F.col("rows")
        places = df.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("rows")).withColumn("before", before)  # a row for each cell
        return df.join(places, ["g", "cell"]).withColumn(at, F.floor((F.col("before") + F.pmod(F.xxhash64(key), F.col("rows"))) / BLOCK).cast("int")).drop("rows", "before")

    sizes = lambda df, at: df.groupBy("g").agg((F.max(at) + 1).alias(f"{at}s"))
    q, x = number(queries, "qid", "qblock"), number(indexed, "id", "vblock")
    fresh = lambda c: (F.col(c) + 0).alias(c)  # noqa: E731  the tables are joined with what is made of them
    if radius is None:
        pairs = sizes(q, "qblock").join(sizes(x, "vblock"), "g").select("g", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)).alias("qblock"), "vblocks").select(F.col("g").alias("g_"), "qblock", F.explode(F.sequence(F.lit(0), F.col("vblocks") - 1)).alias("vblock"))
    else:
        wanted = _asked(q.select("qid", "v", "reach", F.struct("g", "qblock").alias("g")), centroids, probes, radius).select(F.col("g.g").alias("g_"), F.col("g.qblock").alias("qblock"), F.col("cell").alias("cell_")).distinct()
        pairs = wanted.join(x.select("g", "cell", fresh("vblock")).distinct(), (F.col("g") == F.col("g_")) & (F.col("cell") == F.col("cell_"))).select("g_", "qblock", "vblock").distinct()
    pairs = pairs.select("g_", fresh("qblock"), fresh("vblock")).toDF("g_", "qblock_", "vblock_")
    kinds = queries.schema["qid"].dataType.simpleString(), indexed.schema["id"].dataType.simpleString()

    def best(_, a, b):
        import numpy as np
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"qid": [], "id": [], "s": []})
        qids, ids, v, cell, out = a["qid"].to_numpy(), b["id"].to_numpy(), np.stack(b["v"]), b["cell"].to_numpy(), []
        for i in range(0, len(a), CHUNK):
            w = np.stack(a["v"].iloc[i : i + CHUNK])
            take = _near(w, centroids, probes)
            if radius is not None:
                far = np.array([radius.get(c, -1.0) for c in range(len(centroids))])
                take = ~take & (far >= 0) & (_distances(w, centroids) - far <= a["reach"].to_numpy()[i : i + CHUNK, None] + 1e-9)
            s = np.where(take[:, cell], w @ v.T, -np.inf)
            row, col = _best(s, ids, k)
            out.append(pd.DataFrame({"qid": qids[i : i + CHUNK][row], "id": ids[col], "s": s[row, col]}))
        return pd.concat(out)

    q = q.join(pairs, (F.col("g") == F.col("g_")) & (F.col("qblock") == F.col("qblock_"))).select("g", "qblock", F.col("vblock_").alias("vblock"), "qid", "v", *(["reach"] if radius is not None else []))
    x = x.join(pairs, (F.col("g") == F.col("g_")) & (F.col("vblock") == F.col("vblock_"))).select("g", F.col("qblock_").alias("qblock"), "vblock", "id", "cell", "v")
    keys = ["g", "qblock", "vblock"]
    tasks = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as few bytes are much work here and must not be put into one task
    q, x = q.repartition(tasks, *keys), x.repartition(tasks, *keys)
    return q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInPandas(best, f"qid {kinds[0]}, id {kinds[1]}, s double")


def search(indexed: DataFrame, queries: DataFrame, centroids, k: int, probes: int = 4, exact: bool = False) -> DataFrame:
    """The k rows of greatest cosine to each query (qid, g, v), of its group, ties by id: qid, id, s, rn."""
    queries = index(queries, centroids).select("qid", "g", "v", "cell")  # near queries share blocks
    found = top_per(_compared(queries, indexed, k, centroids, probes), ["qid"], k, F.desc("s"), "id")
    if not exact or not len(centroids) or probes >= len(centroids):
        return found
    radius = {r.cell: r.far for r in indexed.groupBy("cell").agg(F.max("far").alias("far")).collect()}  # a row for each cell
    last = found.groupBy("qid").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("n"))
    reach = F.when(F.col("n") >= k, F.sqrt(F.greatest(2 - 2 * F.col("s"), F.lit(0.0)))).otherwise(float("inf"))
    wider = queries.join(last, "qid", "left").withColumn("reach", F.coalesce(reach, F.lit(float("inf")))).drop("s", "n")
    more = _compared(wider, indexed, k, centroids, probes, radius)
    return top_per(found.select("qid", "id", "s").unionByName(more), ["qid"], k, F.desc("s"), "id")


def nearest_neighbours(df: DataFrame, key: str, vec: str, k: int, group: str | None = None, probes: int = 4, exact: bool = True, cells: int | None = None) -> DataFrame:
    """The k nearest other rows of each row, in its group: id, other, s."""
    ship(df.sparkSession)
    rows = unit_rows(df, key, vec, group)
    centroids = fit(rows, cells)
    copies = F.xxhash64("g", "v")
    first = top_per(rows.withColumn("h", copies), ["g", "h", "v"], k + 1, "id")
    indexed = index(first.select("id", "g", "v"), centroids)
    asks = first.where("rn = 1").select(F.col("id").alias("qid"), "g", "v")
    found = search(indexed, asks, centroids, k + 1, probes, exact)
    # each copy asks what the first one asked, and isn't its own neighbour
    speaker = rows.join(first.where("rn = 1").select(F.col("id").alias("qid"), "g", "v"), ["g", "v"]).select("id", "qid")
    pairs = speaker.join(found.select("qid", F.col("id").alias("other"), "s"), "qid").where("id <> other")
    return top_per(pairs.select("id", "other", "s"), ["id"], k, F.desc("s"), "other").select("id", "other", "s")


def recall(found: DataFrame, truth: DataFrame, key: list[str]) -> float:
    """The share of the true pairs that were found."""
    hit = truth.select(*key).join(found.select(*key).distinct(), key, "left_semi").count()
    return hit / max(truth.count(), 1)


@register("D27b_hub_bias", """WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id, list_cosine_similarity(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id) AS k FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT vec_id, round(avg(s), 6) AS hub FROM s WHERE k <= 10 GROUP BY vec_id""")
def d27b(spark, sf):
    """Mean similarity to the ten nearest vectors of the same label, exact: cells that can hold no nearer one are left out."""
    near = nearest_neighbours(raw(spark, sf, "embeddings"), "vec_id", "embedding", 10, group="label")
    return near.groupBy(F.col("id").alias("vec_id")).agg(F.round(F.avg("s"), 6).alias("hub"))


PROBES, ASKED = 12, 20


@register("D27c_cell_search")
def d27c(spark, sf):
    """The ten nearest of every twentieth vector, approximate: all vectors are indexed. These vectors are noise in 64 dimensions, so three quarters of the cells must be looked into for nine of ten."""
    ship(spark)
    rows = unit_rows(raw(spark, sf, "embeddings"), "vec_id", "embedding")
    centroids = fit(rows)
    asks = rows.where(F.col("id") % ASKED == 0).select(F.col("id").alias("qid"), "g", "v")
    found = search(index(rows, centroids), asks, centroids, 11, max(PROBES, len(centroids) * 3 // 4)).where("qid <> id")
    return top_per(found.select("qid", "id", "s"), ["qid"], 10, F.desc("s"), "id").select("qid", "id", F.round("s", 6).alias("s"), "rn")
