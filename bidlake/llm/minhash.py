"""MinHash near-dedup with min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its
maximum, so `bands * rows / 2` permutations fill all bands; half the bands are cut from
minima and half from maxima, and no band holds both values of one permutation.

1. Rows with the same shingle set collapse to one representative (a groupBy, so large
   groups of copies are summed up before the shuffle).
2. Representatives that agree in a band share a bucket. Every member is paired with one
   member only, a star around the bucket's most central one (that whose buckets hold most
   members: the text that a group's copies vary), and confirmed on the full sets.
3. Components of the confirmed links are found by large-star/small-star rounds.
4. Stars and bands lose links. What they lose is found exactly, between texts of different
   components only: a shingle of one component alone can't be part of such a link. A text whose
   shingles of several components are too few for any partner is done (first by the smallest
   hashes of each set, of which enough must be shared, then by all). The rest meet by a prefix
   filter: a text's dead shingles stand first in its order, then live ones from rare to common,
   and two texts are compared if they share a shingle at places that leave enough after it. As
   dead shingles fill the prefixes of a crowd's stragglers, few pairs are left to confirm.

In steps 1 to 3 a bucket gives at most as many pairs as it has members, so crowds of any size
stay linear. Step 4 looks at the places of a shingle in pairs, which is quadratic in the texts
that share it, lie in different components and are that near to the threshold; groups beyond
SALTED such texts are dealt over several tasks. The links are all that exist.

Full sets are wanted of a part of the texts only. Texts pass a filter of bits of those ids before they are
shuffled (`_sieved`); it is of fixed size, so with hundreds of millions of wanted ids more texts pass in vain.

With 48 bands of 7 values, two documents of similarity 0.8 share no bucket with
probability 1.2e-5, and have ten in common on average; a passage that makes up two fifths
of many texts fills a bucket with 0.2 % of them, where bands of 5 values would hold 1 %.

Defined cases. Null and wordless texts have an empty set, are linked with nothing and are
kept. A text of fewer words than a shingle is one shingle. Rows that share a doc_id are
nodes of one name. Null ids form no links and keep a null component. Empty tables give an
empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidlake.llm.common import Workspace, find_words, hash_words, mix, shingle_hashes, text_slices

SHINGLE, BANDS, ROWS = 5, 48, 7
SALTED = 5000
#: Bits of the filter that texts pass before they are shuffled, and bits of one row of it: 4 MB at most, whatever the input.
SIEVE, SIEVE_ROW = 1 << 25, 1 << 15
SIGNED = "id {id}, n_shingles long, set_a long, set_b long, bands array<long>, first array<long>"


def shingle_sets(column, width: int):
    """For each row of an Arrow column, its sorted distinct shingle hashes."""
    for _, bounds, data in text_slices(column):
        starts, ends, first = find_words(data, bounds)
        words = hash_words(data, starts, ends, fold=True)
        for i in range(len(bounds) - 1):
            w = words[first[i] : first[i + 1]]
            yield np.unique(shingle_hashes(w, min(width, len(w)))) if len(w) else w


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.Generator(np.random.PCG64(7))
    return g.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), g.integers(0, 2**63, n, dtype=np.uint64)


def min_max(hashes: np.ndarray, mul: np.ndarray, add: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the hashes under each permutation."""
    low, high = np.full(len(mul), 2**64 - 1, np.uint64), np.zeros(len(mul), np.uint64)
    for k in range(0, len(hashes), block):
        x = hashes[None, k : k + block] * mul[:, None] + add[:, None]
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.concatenate([low.reshape(bands // 2, rows), high.reshape(bands // 2, rows)])
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + keys[:, k])
    return out.view(np.int64)


def _least(n: int, percent: int) -> int:
    """The least overlap of a set of n with any linked one; also the least size of such a one."""
    return -(-percent * n // 100)


def _more(n):
    """How many shared hashes are asked of the first ones of a set of n, beyond the one that a prefix filter asks."""
    return n // 10


def first_hashes(hashes: np.ndarray, percent: int) -> np.ndarray:
    """So many of the smallest hashes that two linked sets of sizes n and m share 1 + min(_more(n), _more(m)) of them."""
    n = len(hashes)
    return hashes[: n - _least(n, percent) + 1 + _more(n)]


def _signer(width: int, bands: int, rows: int, percent: int):
    def sign(batches):
        import pyarrow as pa

        def lists(arrays):
            offsets = np.zeros(len(arrays) + 1, np.int32)
            np.cumsum([len(x) for x in arrays], out=offsets[1:])
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))

        mul, add = _permutations(bands * rows // 2)
        for batch in batches:
            n, a, b, keys, first = [], [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                a.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                b.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(1))).view(np.int64)) if len(s) else 0)
                keys.append(band_keys(*min_max(s, mul, add), bands, rows) if len(s) else np.zeros(0, np.int64))
                first.append(first_hashes(s, percent).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists(keys), lists(first)], ["id", "n_shingles", "set_a", "set_b", "bands", "first"])

    return sign


def _set_writer(width: int):
    def sets(batches):
        import pyarrow as pa

        for batch in batches:
            rows = list(shingle_sets(batch.column(1), width))
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(x) for x in rows], out=offsets[1:])
            values = pa.array((np.concatenate(rows) if rows else np.zeros(0, np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["id", "shingles"])

    return sets


def components(spark: SparkSession, edges: DataFrame, ws: Workspace, label: str) -> DataFrame:
    """Connected components of (u, v): rows (id, component), component the smallest id; large-star/small-star."""
    cur = ws.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{label}0")
    turn, seen = 0, None
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), f"{label}low{turn}")
        large = ws.cut(both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"{label}large{turn}")
        small_low = ws.cut(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), f"{label}small{turn}")
        joined = large.join(small_low, large.u == small_low.k)
        nxt = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        cur = ws.cut(nxt, f"{label}{turn + 1}")
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        ws.drop(f"{label}{turn}", f"{label}low{turn}", f"{label}large{turn}", f"{label}small{turn}")
        seen, turn = state, turn + 1
    return cur.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets.
    """
    ws = Workspace(spark, "minhash")
    pairs_of = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pairs_of.schema["id"].dataType.simpleString()
    signed = ws.cut(pairs_of.mapInArrow(_signer(width, bands, rows, percent), SIGNED.format(id=kind)), "signed")
    key = ["n_shingles", "set_a", "set_b"]
    usable = signed.where("n_shingles > 0 AND id IS NOT NULL")
    reps = ws.cut(usable.groupBy(*key).agg(F.min("id").alias("rep")), "reps")
    # the representatives' own rows; repeated rows of one id and set count once (before their bands are dealt: the join's partitions serve)
    own = reps.withColumnsRenamed({k: k + "_" for k in key}).select("rep", *(k + "_" for k in key))
    rep_rows = usable.join(own, [F.col("id") == F.col("rep"), *(F.col(k) == F.col(k + "_") for k in key)]).groupBy("id", *key).agg(F.first("bands").alias("bands"))
    buckets = rep_rows.select(F.col("id").alias("rep"), "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = ws.cut(buckets.select("rep", F.col("n_shingles").alias("n"), F.xxhash64("band", "key").alias("bucket")), "buckets")
    shared = ws.cut(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    crowd = ws.cut(buckets.join(shared, "bucket"), "crowd")
    ws.drop("buckets", "shared")
    central = ws.cut(crowd.groupBy(F.col("rep").alias("rep_")).agg(F.sum("size").alias("score")), "central")
    scored = ws.cut(crowd.join(central, F.col("rep") == F.col("rep_")).select("bucket", "rep", "n", "score"), "scored")
    ws.drop("crowd", "central")
    middle = ws.cut(scored.groupBy("bucket").agg(F.max(F.struct("score", "rep", "n")).alias("star")), "middle")
    star = scored.join(middle, "bucket").where(F.col("rep") != F.col("star.rep")).where(_near_sizes(F.col("n"), F.col("star.n"), percent))
    star = ws.cut(star.select(F.least("star.rep", "rep").alias("u"), F.greatest("star.rep", "rep").alias("v")).distinct(), "star")
    ws.drop("scored", "middle")
    candidates = star.select(F.explode(F.array("u", "v")).alias("id_")).distinct()
    sets = ws.cut(_sets(pairs_of, candidates, width), "sets")
    found = components(spark, ws.cut(_confirm(star, sets, percent), "links"), ws, "first")
    ws.drop("star", "sets")
    found = ws.cut(found, "linked")
    named = ws.cut(reps.groupBy("rep").agg(F.min("n_shingles").alias("n")).join(found, F.col("rep") == F.col("id"), "left").select("rep", "n", F.coalesce("component", "rep").alias("c")), "named")
    links = _missed(pairs_of, usable.select("id", "first"), named, width, percent, ws)
    if not links.isEmpty():
        merged = ws.cut(components(spark, links, ws, "more").toDF("old", "new"), "merged")
        found = ws.cut(named.join(merged.hint("merge"), F.col("c") == F.col("old"), "left").select(F.col("rep").alias("id"), F.coalesce("new", "c").alias("component")), "found")
    classes = reps.join(found, F.col("rep") == F.col("id"), "left").select(*(F.col(k).alias(k + "_") for k in key), F.coalesce("component", "rep").alias("component"))
    # ids with several sets join the components of all of them
    classes = ws.cut(classes, "classes")
    out = signed.select("id", *key).join(classes, [F.col(k) == F.col(k + "_") for k in key], "left")
    comp = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))


def _near_sizes(a, b, percent: int):
    """Sets of too different sizes can't be links."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """The distinct sets (id, shingles) of the documents whose id is in ids (id_)."""
    kind = docs.schema["id"].dataType.simpleString()
    # no semi join, which would be moved before the sieve
    sets = _sieved(docs, ids).join(ids.select("id_").distinct(), F.col("id") == F.col("id_")).select("id", "text").mapInArrow(_set_writer(width), f"id {kind}, shingles array<long>")
    return sets.where(F.size("shingles") > 0).dropDuplicates(["id", "shingles"])


def _sieved(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """All rows of docs whose id is in ids (id_) and few others: a bit for each hash of an id, so that a join needn't shuffle every text."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE))
    bit = ids.select(F.floor(place("id_") / SIEVE_ROW).alias("line"), (place("id_") % SIEVE_ROW).alias("bit")).repartition("line")
    lines = bit.groupBy("line").agg(F.bitmap_construct_agg("bit").alias("bits"))
    at = place("id") % SIEVE_ROW
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return docs.join(F.broadcast(lines), F.floor(place("id") / SIEVE_ROW) == F.col("line")).where(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0).select(docs.columns)


def _missed(docs: DataFrame, first: DataFrame, named: DataFrame, width: int, percent: int, ws: Workspace) -> DataFrame:
    """The links between different components, as pairs (u, v) of components; none is left out.

    docs: id, text; first: id, first (hashes by first_hashes); named: rep, n (its smallest set), c (component).
    """
    by_token, by_set = Window.partitionBy("token"), Window.partitionBy("id", "s")
    live = F.min("c").over(by_token) != F.max("c").over(by_token)
    several = first.select("id", F.explode("first").alias("token")).select("id", "token", F.count(F.lit(1)).over(by_token).alias("df")).where("df > 1")
    several = ws.cut(several.select("id", "token"), "several")  # before components are joined: most hashes occur once
    several = several.join(named, F.col("id") == F.col("rep")).select("rep", "n", "c", "token", live.alias("live")).where("live")
    least = F.expr(f"(n * {percent} + 99) div 100")  # _least
    near = several.groupBy("rep", "n", "c").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") > F.floor(least / 10))
    near = ws.cut(near.select(F.col("rep").alias("id_"), "c"), "near")
    ws.drop("several")
    sets = ws.cut(_sets(docs, near.select("id_"), width), "full")
    placed = sets.join(near, F.col("id") == F.col("id_")).withColumn("s", F.dense_rank().over(Window.partitionBy("id").orderBy("shingles")))
    placed = placed.select("id", "s", F.size("shingles").cast("long").alias("n"), "c", F.explode("shingles").alias("token"))
    placed = placed.select("*", live.alias("live"), F.count(F.lit(1)).over(by_token).alias("df")).where("live")
    placed = placed.select("token", "id", "n", "c", "df", F.count(F.lit(1)).over(by_set).alias("k"), F.row_number().over(by_set.orderBy("df", "token")).alias("i"))
    # after a live shingle's place in its text, its dead ones first, so many are left, itself included
    placed = placed.select("token", "id", "n", "c", (F.col("k") - F.col("i") + 1).alias("left"), (1 + F.floor(F.col("df") / SALTED)).cast("int").alias("salts"))
    placed = ws.cut(placed.where(F.col("left") >= least), "placed")
    larger = placed.select("token", F.pmod(F.hash("id"), "salts").alias("salt"), *(F.col(x).alias(f"{x}u") for x in ("id", "n", "c", "left")))
    smaller = placed.where(f"{100 + percent} * left >= {2 * percent} * n").select(F.col("token").alias("token_"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt_"), *(F.col(x).alias(f"{x}v") for x in ("id", "n", "c", "left")))
    fits = f"nu >= nv AND 100 * nv >= {percent} * nu AND cu <> cv AND {100 + percent} * least(leftu, leftv) >= {percent} * (nu + nv)"
    pairs = larger.join(smaller.hint("merge"), (F.col("token") == F.col("token_")) & (F.col("salt") == F.col("salt_")) & F.expr(fits))
    pairs = pairs.select(F.least("idu", "idv").alias("u"), F.greatest("idu", "idv").alias("v"), F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv")).distinct()
    pairs = ws.cut(pairs, "pairs")
    links = _confirm(pairs.select("u", "v"), sets, percent).join(pairs, ["u", "v"]).select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    return ws.cut(links.distinct(), "missed")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose full sets reach the similarity."""
    v = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv"))
    u = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su"))
    both = pairs.join(v, "v").join(u, "u")
    shared = F.size(F.array_intersect("su", "sv"))
    return both.select("u", "v", shared.alias("i"), (F.size("su") + F.size("sv")).alias("t")).where(F.expr(f"100L * i >= {percent}L * (t - i)")).select("u", "v")
