"""Language ID with language-bitmask n-gram filters.

Fit. For each language, character n-grams are counted over a sample of at most
SAMPLE_DOCS labelled texts (whole, chosen by hash; copies only where distinct texts are too
few, and no text more than LEAST_COUNT times). N-grams that are much more
frequent in a language than over all languages are put into that language's Bloom filter,
at most TOP_GRAMS for a language; they must stand LEAST_COUNT times in a sample of FULL_SAMPLE n-grams or more, in a smaller one
as many times fewer, so a label with one short text is learned too. The filters share their hash functions and are stored
bit-sliced: slot i is a word whose bit l says whether slot i of language l's filter is set,
so HASHES look-ups and an AND give all languages that contain an n-gram. A word has at most
WORD_BITS bits; there is a table for each WORD_BITS languages.

Decide. A text's n-grams are looked up at once; per language the bits are counted. Each
count is corrected for the filter's false positives (share of its slots set, to the power
of HASHES): (hits - rate * n) / (1 - rate). The largest corrected count wins, ties go to
the language first by name; score is its share of all positive corrected counts.

The sample, the counted n-grams that reach the driver and the filters grow with the number
of labels only, not with the documents.

Defined cases. Null text or a text without a letter gives `und` with score 0. A text none of
whose n-grams is known gives the language with most labelled documents in the sample, score 0.
Without any labelled row every text gives `und`. Repeated rows are each predicted; columns
other than the text are no input. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE_DOCS, TOP_GRAMS, GRAMS, HASHES, SLOT_BITS, WORD_BITS = 2000, 20_000, (2, 3, 4), 3, 20, 64
LEAST_RATIO, LEAST_COUNT, LEAST_COVER, FULL_SAMPLE = 1.5, 5, 0.2, 10_000
_points: dict[str, np.ndarray] = {}


def _fold_table() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else 0."""
    if "fold" not in _points:
        fold = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                fold[c] = ord(low) if len(low) == 1 else c
        _points["fold"] = fold
    return _points["fold"]


def letters(text: str) -> np.ndarray:
    """Lower-cased letters, each run of anything else a single 0, a 0 at either end; empty without letters."""
    p = _fold_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not p.any():
        return p[:0]
    p = np.concatenate([[0], p, [0]]).astype(np.uint32)
    return p[(p != 0) | np.concatenate([[True], p[:-1] != 0])]


def gram_hashes(points: np.ndarray, sizes=GRAMS) -> np.ndarray:
    """A 64-bit hash of every n-gram that has at most its first and last character outside a word."""
    out = []
    gap = points == 0
    for n in sizes:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h, inner = np.full(m, n, np.uint64), np.zeros(m, bool)
        for k in range(n):
            h = (h ^ points[k : k + m].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < k < n - 1:
                inner |= gap[k : k + m]
        if n == 2:
            inner = gap[:m] & gap[1:]
        out.append(h[~inner])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def slots(h: np.ndarray, bits: int = SLOT_BITS, hashes: int = HASHES):
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    step = (h >> np.uint64(40)) | np.uint64(1)
    mask = np.uint64((1 << bits) - 1)
    for k in range(hashes):
        yield ((h + step * np.uint64(k)) & mask).astype(np.int64)


def _count_grams(batches):
    import pyarrow as pa

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h, n = np.unique(gram_hashes(letters(text or "")), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class Model:
    """Languages, the bit-sliced table and each filter's rate of false positives."""

    def __init__(self, langs: list[str], grams: dict[str, np.ndarray], bits: int = SLOT_BITS):
        self.langs, self.bits = langs, bits
        self.tables, fill = [], []
        for first in range(0, len(langs), WORD_BITS):
            some = langs[first : first + WORD_BITS]
            word = next(t for t, w in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(some) <= w)
            table = np.zeros(1 << bits, word)
            for l, name in enumerate(some):
                for s in slots(grams.get(name, np.zeros(0, np.uint64)), bits):
                    table[s] |= word(1 << l)
            fill += [((table >> word(l)) & word(1)).mean() for l in range(len(some))]
            self.tables.append(table)
        self.rate = np.array(fill) ** HASHES

    def predict(self, text: str | None, fallback: str) -> tuple[str, float, float]:
        """The language, its share of all counts, and the share of the text's n-grams that it holds."""
        points = letters(text or "")
        if not len(points) or not self.langs:
            return "und", 0.0, 0.0
        h = gram_hashes(points)
        at, hits = list(slots(h, self.bits)), []
        for k, table in enumerate(self.tables):
            found = table[at[0]]
            for s in at[1:]:
                found = found & table[s]
            hits += [np.count_nonzero(found & found.dtype.type(1 << l)) for l in range(min(WORD_BITS, len(self.langs) - k * WORD_BITS))]
        hits = np.array(hits, float)
        true = np.maximum((hits - self.rate * len(h)) / np.maximum(1 - self.rate, 1e-9), 0)
        if true.sum() <= 0:
            return fallback, 0.0, 0.0
        return self.langs[int(true.argmax())], float(true.max() / true.sum()), float(true.max() / len(h))


def fit(spark: SparkSession, rows: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, top_grams: int = TOP_GRAMS) -> tuple[Model, str]:
    """Model from labelled rows, and the language with most rows in the sample."""
    labelled = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # distinct texts are thinned out by hash before any is moved: about twice the sample, of which the window takes the first
    labelled = labelled.withColumn("h", F.xxhash64("text"))
    rows_of = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    shares = {r.lang: min(1.0, 2 * sample_docs / max(r.n, 1)) for r in rows_of}
    share_of = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang")), F.lit(0.0)) if shares else F.lit(0.0)
    thin = labelled.where(F.col("h").cast("double") / 2.0**64 + 0.5 <= share_of).groupBy("lang", "h").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    # each text once; where that doesn't fill the sample, copies follow, but no text counts more than LEAST_COUNT times
    times = thin.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(LEAST_COUNT)).cast("int"))))
    order = Window.partitionBy("lang").orderBy("copy", "h")
    sample = times.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_docs).select("text", "lang")
    counts = sample.repartition(max(2, spark.sparkContext.defaultParallelism)).mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("of"))
    share = counts.join(F.broadcast(total), "lang").withColumn("share", F.col("n") / F.col("of"))
    mean = share.withColumn("mean", F.sum("share").over(Window.partitionBy("gram")))
    langs = [r.lang for r in total.orderBy(F.desc("of"), "lang").collect()]
    apart = F.lit(len(langs) == 1) | (F.col("share") * len(langs) >= LEAST_RATIO * F.col("mean"))  # a single language is told from none
    need = F.least(F.lit(float(LEAST_COUNT)), F.greatest(F.lit(1.0), F.col("of") / FULL_SAMPLE * LEAST_COUNT))
    telling = mean.where((F.col("n") >= need) & apart)
    best = telling.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("share"), "gram"))).where(F.col("k") <= top_grams)
    rows_ = best.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()  # a row a language, of at most top_grams numbers
    return Model(sorted(langs), {r.lang: np.array(r.grams, np.int64).view(np.uint64) for r in rows_}), (langs[0] if langs else "und")


def _predictor(model, fallback: str, at: int, names: list[str]):
    def predict(batches):
        import pyarrow as pa

        m = model.value
        for batch in batches:
            got = [m.predict(t, fallback) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())], [*names, "lang_pred", "score", "cover"])

    return predict


def predict(spark: SparkSession, docs: DataFrame, model: Model, fallback: str, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and cover in further columns; the model is a broadcast of fixed size."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    shared = spark.sparkContext.broadcast(model)
    out = docs.toDF(*names).mapInArrow(_predictor(shared, fallback, docs.columns.index(text_col), names), f"{schema}, lang_pred string, score double, cover double")
    return out.toDF(*docs.columns, "lang_pred", "score", "cover")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def keep_known(spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least_cover: float = LEAST_COVER) -> DataFrame:
    """The rows of docs whose language can be told; a null language becomes the predicted one, all else stays as it was.

    A text goes where it has no letter or where its language holds less than least_cover of its
    n-grams: it is in none of the languages learned. Where no row has a label, nothing is learned and every row stays.
    """
    model, fallback = fit(spark, docs, text_col, lang_col)
    if not model.langs:
        return docs
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    got = predict(spark, docs, model, fallback, text_col).toDF(*plain, "p", "s", "v").where((F.col("p") != "und") & (F.col("s") > 0) & (F.col("v") >= least_cover))
    kind = docs.schema[lang_col].dataType
    return got.select(*(F.coalesce(F.col(c), F.col("p").cast(kind)).alias(c) if n == lang_col else F.col(c) for c, n in zip(plain, names, strict=True))).toDF(*names)
