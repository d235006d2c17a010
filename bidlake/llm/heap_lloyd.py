"""Compression of vectors to codes: a codebook for each part of the vectors, learned by Lloyd rounds on heaps.

Vectors are cut into equal parts; each part position has entries of its own. A block of up to BLOCK
vectors is a row of the state table: their parts, and for each position and entry a heap of the
parts that the entry owns. A heap's key is the part's slack, the lower bound of its distance to any
other entry minus the upper bound of that to its owner, plus the drift that the entry's heap had
gathered when the part went in. After a round moves the entries, a heap's drift grows by how far its
entry moved and by how far any other of that position moved at most. A part whose key is still beyond
the drift can't have changed its owner: it is not looked at, nor is anything below it in the heap. The
others are popped, compared exactly with all entries, and go into the heap of their owner with a new key.
Heaps are ascending arrays (each element is no greater than those below it), so popping is a prefix
and entering a merge, both on arrays.

Bounds are doubles, distances and sums integers: a part is popped unless its slack is beyond the drift
by more than MARGIN, so that rounding and ties can only pop too many; popped parts decide by exact
distances, ties to the lower index. Sums of an entry change by signed transfers of the parts that
changed their owner; the driver holds (positions x entries x part length) integers. Blocks are written anew each
round in the shared folder; a lost executor costs the blocks it was at.

Defined cases. Vectors that are null, hold null or non-finite components, or have another number of
components than `dims` have no code and no row. Components beyond 2**27 units either way count as 2**27. Rows
without an id start no entry; of rows with the same id the smaller vectors start first. With fewer
vectors than entries there are as many entries as vectors. Null labels are a group of their own. All columns but id, vector and label are
ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake.llm.common import Workspace
from bidlake.llm.delta_lloyd import distances, kept, matrix

BLOCK, MARGIN, SALTS, FEW_LABELS = 2048, 1e-5, 32, 100_000


class Heaps:
    """For each entry of one part position: keys in ascending order and the rows they belong to."""

    def __init__(self, sizes: np.ndarray, keys: np.ndarray, rows: np.ndarray):
        self.sizes, self.keys, self.rows = sizes, keys, rows

    @classmethod
    def of(cls, owner: np.ndarray, keys: np.ndarray, rows: np.ndarray, entries: int) -> Heaps:
        order = np.lexsort((rows, keys, owner))
        return cls(np.bincount(owner, minlength=entries), keys[order], rows[order])

    def pop(self, drift: np.ndarray) -> tuple[np.ndarray, Heaps]:
        """The rows whose keys the drift of their entry has reached, and the heaps without them."""
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        gone = np.array([np.searchsorted(self.keys[a:b], d, "right") for a, b, d in zip(starts, ends, drift, strict=True)], np.int64)
        edge = np.zeros(len(self.keys) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + gone, -1)
        out = np.cumsum(edge[:-1]) > 0
        return self.rows[out], Heaps(self.sizes - gone, self.keys[~out], self.rows[~out])

    def push(self, owner: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> Heaps:
        entries = len(self.sizes)
        return Heaps.of(np.concatenate([np.repeat(np.arange(entries), self.sizes), owner]), np.concatenate([self.keys, keys]), np.concatenate([self.rows, rows]), entries)

    def owners(self) -> np.ndarray:
        out = np.empty(len(self.rows), np.int64)
        out[self.rows] = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties: lower index), its squared distance, and the slack up to any other."""
    d = distances(x, entries)
    owner = d.argmin(1)
    own = d[np.arange(len(d)), owner]
    if len(entries) == 1:
        return owner, own, np.full(len(x), np.inf)
    d[np.arange(len(d)), owner] = np.iinfo(np.int64).max
    return owner, own, np.sqrt(d.min(1).astype(np.float64)) - np.sqrt(own.astype(np.float64))


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By position and entry: how far the entry moved plus how far any other moved at most."""
    far = np.sqrt(((new - old) ** 2).sum(2).astype(np.float64))
    if far.shape[1] < 2:
        return far
    order = np.sort(far, axis=1)
    others = np.repeat(order[:, -1:], far.shape[1], axis=1)
    others[np.arange(len(far)), far.argmax(1)] = order[:, -2]
    return far + others


#: A block: its vectors' ids and labels, integers of the parts, and for each position sizes, keys and rows of the heaps; what the last round transferred.
BLOCK_COLUMNS = "ids array<{id}>, labels array<{label}>, vectors binary, sizes binary, keys binary, rows binary, counts binary, sums binary, popped long"


def _pack(batch_columns: list, x: np.ndarray, heaps: list[Heaps], counts: np.ndarray, sums: np.ndarray, popped: int, names: list[str], kinds: list):
    import pyarrow as pa

    join = lambda parts, kind: pa.array([np.concatenate(parts).astype(kind).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays(
        [*(pa.array([c.to_pylist()], pa.list_(t)) for c, t in zip(batch_columns, kinds, strict=True)), pa.array([x.astype(np.int32).tobytes()], pa.binary()), join([h.sizes for h in heaps], np.int32), join([h.keys for h in heaps], np.float64), join([h.rows for h in heaps], np.int32),
         pa.array([counts.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary()), pa.array([popped], pa.int64())], names)


def _first(books: np.ndarray, names: list[str]):
    def build(batches):
        import pyarrow as pa

        positions, entries, size = books.shape

        def block(held):
            t = pa.Table.from_batches(held)
            x = matrix(t["vec"].combine_chunks()).reshape(-1, positions, size)
            heaps, counts, sums = [], np.zeros((positions, entries), np.int64), np.zeros((positions, entries, size), np.int64)
            for p in range(positions):
                owner, _, slack = nearest(x[:, p], books[p])
                heaps.append(Heaps.of(owner, slack, np.arange(len(x)), entries))
                counts[p] = np.bincount(owner, minlength=entries)
                np.add.at(sums[p], owner, x[:, p])
            return _pack([t["id"], t["label"]], x, heaps, counts, sums, positions * len(x), names, [t.schema.field("id").type, t.schema.field("label").type])

        held, n = [], 0
        for whole in batches:
            for k in range(0, whole.num_rows, BLOCK):
                at = k
                while at < min(k + BLOCK, whole.num_rows):
                    part = whole.slice(at, min(BLOCK - n, k + BLOCK - at))
                    held.append(part)
                    n += part.num_rows
                    at += part.num_rows
                    if n == BLOCK:
                        yield block(held)
                        held, n = [], 0
        if held:
            yield block(held)

    return build


class Block:
    """A row of the state table, read back."""

    def __init__(self, batch, row: int, shape: tuple[int, int, int]):
        positions, entries, size = shape
        get = lambda name, kind: np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_py(), kind)
        self.x = get("vectors", np.int32).astype(np.int64).reshape(-1, positions, size)
        n = len(self.x)
        sizes, keys, rows = get("sizes", np.int32).reshape(positions, entries), get("keys", np.float64), get("rows", np.int32)
        self.heaps = [Heaps(sizes[p].astype(np.int64), keys[p * n : (p + 1) * n], rows[p * n : (p + 1) * n]) for p in range(positions)]


def _round(books: np.ndarray, drift: np.ndarray):
    """A round over blocks: `drift` is what each heap has gathered since the start."""

    def go(batches):
        positions, entries, size = books.shape
        for batch in batches:
            for row in range(batch.num_rows):
                b = Block(batch, row, books.shape)
                heaps, counts, sums, popped = [], np.zeros((positions, entries), np.int64), np.zeros((positions, entries, size), np.int64), 0
                for p, heap in enumerate(b.heaps):
                    rows, rest = heap.pop(drift[p] + MARGIN)
                    if len(rows):
                        before, part = heap.owners()[rows], b.x[rows, p]
                        owner, _, slack = nearest(part, books[p])
                        rest = rest.push(owner, slack + drift[p][owner], rows)
                        gone = owner != before
                        for who, sign in ((owner[gone], 1), (before[gone], -1)):
                            np.add.at(counts[p], who, sign)
                            np.add.at(sums[p], who, sign * part[gone])
                        popped += len(rows)
                    heaps.append(rest)
                first = [batch.column(k).slice(row, 1).flatten() for k in (0, 1)]
                yield _pack(first, b.x, heaps, counts, sums, popped, batch.schema.names, [c.type for c in first])

    return go


def _coded(books: np.ndarray, kind: str):
    def code(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                b = Block(batch, row, books.shape)
                owner = np.stack([h.owners() for h in b.heaps], 1)
                gap = b.x - books[np.arange(books.shape[0])[None, :], owner]
                codes = [bytes(o).hex() for o in owner.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1).flatten(), batch.column(1).slice(row, 1).flatten(), pa.array(codes), pa.array((gap * gap).sum((1, 2)))], ["id", "label", "code", "error"])

    return code


def _sums(shape: tuple[int, int, int]):
    def add(batches):
        import pyarrow as pa

        counts, sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            for n, s in zip(batch.column(0), batch.column(1), strict=True):
                counts += np.frombuffer(n.as_py(), np.int64).reshape(shape[:2])
                sums += np.frombuffer(s.as_py(), np.int64).reshape(shape)
        p, e = np.nonzero((counts != 0) | (sums != 0).any(2))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return add


def transfers(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """What the last round adds to counts and sums: each task adds its blocks up, then (positions x entries) rows meet."""
    part = state.select("counts", "sums").mapInArrow(_sums(shape), "part int, entry int, n long, sums array<long>")
    rows = part.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(shape[2]))).collect()
    counts, sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
    for r in rows:
        counts[r.part, r.entry], sums[r.part, r.entry] = r.n, [r[f"s{i}"] for i in range(shape[2])]
    return counts, sums


def compressed(spark: SparkSession, vectors: DataFrame, positions: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray, list[int]]:
    """(id, label, code, error) of each kept vector, the codebooks, and how many parts each round looked at."""
    if dims % positions or not 0 < entries <= 256:
        raise ValueError("dims must be a multiple of positions, entries from 1 to 256")
    ws = Workspace(spark, "heap-lloyd")
    points = kept(vectors.withColumn("__both", F.struct(F.col(id_col).alias("id"), F.col(label_col).alias("label"))), scale, dims, "__both", vec_col).select("id.id", "id.label", "vec")
    start = points.where("id IS NOT NULL").orderBy("id", "vec").limit(entries).collect() or points.orderBy("vec").limit(entries).collect()
    kind = {n: points.schema[n].dataType for n in ("id", "label")}
    if not start:
        empty = T.StructType([T.StructField(id_col, kind["id"]), T.StructField(label_col, kind["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        return spark.createDataFrame([], empty), np.zeros((positions, 0, dims // positions), np.int64), []
    books = np.array([r.vec for r in start], np.int64).reshape(len(start), positions, -1).transpose(1, 0, 2).copy()
    schema = BLOCK_COLUMNS.format(id=kind["id"].simpleString(), label=kind["label"].simpleString())
    names = [c.split()[0] for c in schema.split(", ")]
    state, last = ws.cut(points.mapInArrow(_first(books, names), schema), "state0"), "state0"
    counts, sums, drift, looked = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64), np.zeros(books.shape[:2]), []
    for r in range(rounds + 1):
        looked.append(state.agg(F.sum("popped")).first()[0])
        if r == rounds:
            break
        n, s = transfers(state, books.shape)
        counts, sums = counts + n, sums + s
        new = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
        if (new == books).all():
            break
        drift, books = drift + drifts(books, new), new
        state = ws.cut(state.mapInArrow(_round(books, drift), schema), f"state{r + 1}")
        ws.drop(last)
        last = f"state{r + 1}"
    flat = f"id {kind['id'].simpleString()}, label {kind['label'].simpleString()}, code string, error long"
    rows = state.select("ids", "labels", "vectors", "sizes", "keys", "rows").mapInArrow(_coded(books, flat), flat)
    rows = ws.cut(rows, "codes").toDF(id_col, label_col, "code", "error")
    ws.drop(last)
    return rows, books, looked


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(spark: SparkSession, rows: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds the error summed over equal labels, nulls together.

    Sums are made before the shuffle. Up to FEW_LABELS of them are broadcast; beyond that both sides meet by label and a salt,
    each sum once for each salt, so a label of a third of all rows is spread over SALTS tasks.
    """
    sums = rows.groupBy(F.col(label_col).alias("__label")).agg(F.sum("error").alias("label_error"))
    same = F.col(label_col).eqNullSafe(F.col("__label"))
    if sums.count() <= FEW_LABELS:
        return rows.join(F.broadcast(sums), same).drop("__label")
    sums = sums.withColumn("__sum_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("code", "error", *rows.columns[:1]), F.lit(SALTS)).cast("int"))
    return rows.join(sums, same & (F.col("__salt") == F.col("__sum_salt"))).drop("__label", "__salt", "__sum_salt")
