"""Lloyd clustering of integer vectors that does again only what a round has changed.

The first round compares every vector with every centroid and sums up each cluster. What a round
finds is persisted: the vectors with owner and distance as a table, the clusters' sums and counts
with the driver (k x d integers). Each further round then

1. moves the centroids to floor(sum / count); those that stay where they were are unchanged;
2. compares a vector whose owner moved with all centroids, and any other one only with the centroids
   that moved, against its persisted distance: no other centroid can have come nearer;
3. adds to the sums, for each vector that changes its owner, plus its components for the new one and
   minus them for the old, and leaves all others out. A task adds up what it reads before anything
   is shuffled, so at most 2k rows a batch leave it.

All arithmetic is in 64-bit integers, so signed transfers give exactly the sums that a new pass would.
Ties go to the smaller number. A round where no centroid moves ends the loop: all later ones are equal.
Clusters of any size, a third of all vectors in one among them, are sums of bounded size.

Defined cases. Vectors that are null, of other lengths, or hold null or non-finite components are not
kept and have no row. Components beyond 2**27 units either way (two million for scale 64) count as
2**27, so that distances fit into 64 bits. Rows without an id are kept but start no centroid; repeated rows are
vectors each, and of rows with the same id the smaller vectors start first. With fewer than k vectors there are as many
centroids as vectors. All columns but id and vector are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.llm.common import Workspace

MOST, ROWS = 1 << 27, 4096
STATE = "id {id}, vec array<int>, owner int, was int, distance long"


def kept(vectors: DataFrame, scale: int, dims: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Id and vec (array of integers floor(scale * x)) of the rows with `dims` finite components."""
    x = F.col(vec_col).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    unit = F.transform(x, lambda c: F.floor(F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), c * F.lit(float(scale))))).cast("int"))
    return vectors.select(F.col(id_col).alias("id"), x.alias(vec_col)).where((F.size(x) == dims) & F.coalesce(whole, F.lit(False))).select("id", unit.alias("vec"))


def first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest digests under the seed: k rows, whatever the table's size."""
    rows = points.where("id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "vec").limit(k).collect()
    if not rows:  # ids are null throughout, or there is no vector
        rows = points.orderBy("vec").limit(k).collect()
    return np.array([r.vec for r in rows], np.int64)


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as rows of integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exact."""
    small = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * small * small * x.shape[1] < 1 << 53:  # every sum below is an exact double, and doubles are multiplied by fast routines
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        gap = x - c
        out[:, j] = (gap * gap).sum(1)
    return out


def reassign(x: np.ndarray, owner: np.ndarray, known: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances; `moved` marks the centroids that changed, owner -1 a vector that has none yet."""
    owner, known = owner.copy(), known.copy()
    stale = owner < 0
    stale[~stale] = moved[owner[~stale]]
    if stale.any():
        d = distances(x[stale], centroids)
        owner[stale] = d.argmin(1)  # the first of equals
        known[stale] = d[np.arange(len(d)), owner[stale]]
    some = np.flatnonzero(moved)
    if len(some) and not stale.all():
        rest = np.flatnonzero(~stale)
        d = distances(x[rest], centroids[some])
        best = d.argmin(1)
        at, near = some[best], d[np.arange(len(d)), best]
        nearer = (near < known[rest]) | ((near == known[rest]) & (at < owner[rest]))
        owner[rest[nearer]], known[rest[nearer]] = at[nearer], near[nearer]
    return owner, known


def _assigner(centroids: np.ndarray, moved: np.ndarray):
    def assign(batches):
        import pyarrow as pa

        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                x, was = matrix(batch.column(1)), batch.column(2).to_numpy()
                owner, known = reassign(x, was, batch.column(4).to_numpy(), centroids, moved)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(owner.astype(np.int32)), batch.column(2), pa.array(known)], batch.schema.names)

    return assign


def _transfers(k: int):
    def add(batches):
        import pyarrow as pa

        for batch in batches:
            x, owner, was = matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            count, sums = np.zeros(k, np.int64), np.zeros((k, x.shape[1]), np.int64)
            np.add.at(count, owner, 1)
            np.add.at(sums, owner, x)
            left = was >= 0
            np.add.at(count, was[left], -1)
            np.add.at(sums, was[left], -x[left])
            some = np.flatnonzero((count != 0) | (sums != 0).any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["owner", "n", "sums"])

    return add


def transfers(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What the changes of owner add to each cluster's count and sums."""
    part = state.where("owner <> was").select("vec", "owner", "was").mapInArrow(_transfers(k), "owner int, n long, sums array<long>")
    rows = part.groupBy("owner").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims))).collect()
    count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for r in rows:
        count[r.owner], sums[r.owner] = r.n, [r[f"s{i}"] for i in range(dims)]
    return count, sums


def clustered(spark: SparkSession, vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of each kept vector under the final centroids, and those."""
    ws = Workspace(spark, "delta-lloyd")
    points = ws.cut(kept(vectors, scale, dims, id_col, vec_col), "points")
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        return points.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dims), np.int64)
    k, moved = len(centroids), np.ones(len(centroids), bool)
    count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    schema = STATE.format(id=points.schema["id"].dataType.simpleString())
    state, name = points.select("id", "vec", F.lit(-1).alias("owner"), F.lit(-1).alias("was"), F.lit(0).cast("long").alias("distance")), "points"
    for r in range(rounds + 1):
        if not moved.any():
            break
        state = ws.cut(state.mapInArrow(_assigner(centroids, moved), schema), f"state{r}")
        ws.drop(name)
        name = f"state{r}"
        if r == rounds:
            break
        n, s = transfers(state, k, dims)
        count, sums = count + n, sums + s
        new = np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], centroids)
        moved, centroids = (new != centroids).any(1), new
    return state.select(F.col("id").alias(id_col), F.col("owner").alias("cluster"), "distance"), centroids


def with_inertia(spark: SparkSession, rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds each cluster's and the whole inertia, and the digest of each cluster's centroid; k rows are joined on."""
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    by = {r.cluster: r.total for r in rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    small = spark.createDataFrame([(j, by.get(j, 0), sum(by.values()), d) for j, d in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(small), "cluster")  # as many rows as there are centroids
