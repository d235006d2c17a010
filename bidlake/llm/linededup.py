"""Line dedup by winnowing over line hashes, with DataFrame functions only.

Lines without a word are passed over. For each remaining line, its window is the shortest
run of lines from it on that has NOISE_WORDS words; a window that the document's end cuts
short counts for nothing. The line with the smallest hash in a window is a fingerprint, and
its mark is the hash of the fingerprint's own window. A run of lines that two places share
and that has 2 * NOISE_WORDS words or more has a fingerprint with the same mark in both:
its first window ends before half of it, and so the window of that window's minimum is
still inside.

Each mark is joined with its earliest place (by id, then line) and the lines around that,
never with all others, and the match is extended line by line in both directions, by up to
REACH lines (a longer common run holds further fingerprints). Where that place's surroundings
end to agree, other earlier places of the mark may share more: the further lines are hashed at
every width, and a width whose first place (again a groupBy min and an equi-join) is an earlier
one is shared too. So the longest match with any earlier place counts, without pairs, and every
run of 2 * NOISE_WORDS words that stands in an earlier place goes. The later run's lines are
deleted. A deleted line always equals an earlier one, and the first of all equal lines is never
deleted. What is joined grows with the input, so all joins are sort-merge joins, at every size.

Defined cases. Null text stays null. Empty texts and lines stay. Lines are compared by
64-bit hashes of their exact bytes. Rows with a null id are left as they are; rows that
share an id are told apart by their text and repeated rows count as one document, which is
edited alike. Empty tables give an empty result. Other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidlake.llm.common import Workspace

NOISE_WORDS = 25
REACH = 2 * NOISE_WORDS
_WORD = r"[^\x20\x09-\x0D]+"


def deduplicated(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE_WORDS, reach: int = REACH) -> DataFrame:
    """docs with later repeated runs of lines deleted from the text, and two further columns: __lines, __deleted."""
    ws = Workspace(spark, "lines")
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    rows = rows.withColumn("spot", F.xxhash64(text)).withColumn("lines", F.split(text, "\n", -1))
    # per document the lines that have words: number, hash, words
    words = lambda x: F.regexp_count(x, F.lit(_WORD))
    raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    kept_lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), words(x).alias("w"))), lambda x: x["w"] > 0)
    table = raw.select("id", F.xxhash64("text").alias("spot"), kept_lines.alias("l"))
    table = ws.cut(table.where(F.size("l") > 0).dropDuplicates(["id", "spot"]), "table")
    # where windows begin and end: words before each line, strictly growing
    doc = Window.partitionBy("id", "spot")
    line = table.select("id", "spot", F.posexplode("l").alias("p", "x")).select("id", "spot", "p", F.col("x.h").alias("h"), F.col("x.w").alias("w"))
    line = line.withColumn("s", F.sum(F.col("w").cast("long")).over(doc.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w"))
    ahead, behind = doc.orderBy("s").rangeBetween(0, noise - 1), doc.orderBy("s").rangeBetween(1 - noise, 0)
    line = line.select(
        "id", "spot", "p", F.sum("w").over(ahead).alias("have"), F.count(F.lit(1)).over(ahead).alias("len"),
        F.min(F.struct("h", "p")).over(ahead)["p"].alias("at"), F.xxhash64(F.collect_list("h").over(ahead)).alias("mark"), "s",
    )
    line = line.withColumn("at", F.when(F.col("have") >= noise, F.col("at")))
    line = line.withColumn("chosen", F.array_contains(F.collect_set("at").over(behind), F.col("p")))
    prints = ws.cut(line.where((F.col("have") >= noise) & F.col("chosen")).select("mark", "id", "spot", "p", F.col("len").cast("int").alias("len")), "prints")
    first = prints.groupBy("mark").agg(F.min(F.struct("id", "spot", "p", "len")).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("mark", F.col("o.id").alias("id0"), F.col("o.spot").alias("spot0"), F.col("o.p").alias("p0"), F.col("o.len").alias("len0"))
    # the hashes around a place: those before it, nearest first, and those after its window
    around = lambda p, n: (
        F.reverse(F.slice(F.col("l.h"), F.greatest(p - reach, F.lit(0)) + 1, F.least(p, F.lit(reach)))),
        F.slice(F.col("l.h"), p + n + 1, F.lit(reach)),
    )
    before, after = around(F.col("p0"), F.col("len0"))
    near = first.hint("merge").join(table.select(F.col("id").alias("id0"), F.col("spot").alias("spot0"), "l"), ["id0", "spot0"])
    near = ws.cut(near.select("mark", "id0", "spot0", "p0", before.alias("b0"), after.alias("a0")), "near")
    match = prints.join(near.hint("merge"), "mark").where(~((F.col("id") == F.col("id0")) & (F.col("spot") == F.col("spot0")) & (F.col("p") == F.col("p0"))))
    before, after = around(F.col("p"), F.col("len"))
    own = match.select("mark", "id", "spot", "p", "len", "b0", "a0").hint("merge").join(table, ["id", "spot"]).select("mark", "id", "spot", "p", "len", before.alias("b"), after.alias("a"), "b0", "a0")
    ext = own.select("mark", "id", "spot", "p", "len", "b", "a", _common("b", F.col("b0")).alias("back"), _common("a", F.col("a0")).alias("ahead"))
    rest = lambda c, n: F.slice(c, F.col(n) + 1, F.lit(reach))
    ext = ws.cut(ext.select("mark", "id", "spot", "p", "len", "back", "ahead", rest("b", "back").alias("b"), rest("a", "ahead").alias("a")), "ext")
    ws.drop("prints", "near")
    gone = ext.select("id", "spot", F.explode(F.sequence(F.col("p") - F.col("back"), F.col("p") + F.col("len") + F.col("ahead") - 1)).alias("p"))
    gone = gone.unionByName(_further(ws, ext)).distinct()
    # back from numbers among the lines with words to numbers of lines; what stays of each document that changes
    gone = gone.groupBy("id", "spot").agg(F.array_sort(F.collect_list("p")).alias("gone"))
    edits = gone.hint("merge").join(table, ["id", "spot"]).select(F.col("id").alias("id_"), F.col("spot").alias("spot_"), F.transform("gone", lambda p: F.col("l.i")[p]).alias("gone"))
    edits = ws.cut(edits, "edits")
    out = rows.join(edits.hint("merge"), (id_ == F.col("id_")) & (F.col("spot") == F.col("spot_")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    new = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    cols = [new.alias(f"c{i}") if n == text_col else F.col(f"c{i}") for i, n in enumerate(names)]
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    return out.select(*cols, count("lines").alias("n"), count("gone").alias("d")).toDF(*names, "__lines", "__deleted")


def _further(ws: Workspace, ext: DataFrame) -> DataFrame:
    """The lines beyond each match that another earlier place of the mark shares: (id, spot, p)."""
    sides = F.array(F.struct(F.lit(-1).alias("way"), (F.col("p") - F.col("back")).alias("edge"), F.col("back").alias("base"), F.col("b").alias("l")), F.struct(F.lit(1).alias("way"), (F.col("p") + F.col("len") + F.col("ahead") - 1).alias("edge"), F.col("ahead").alias("base"), F.col("a").alias("l")))
    side = ext.select("mark", "id", "spot", "p", F.explode(sides).alias("x")).select("mark", "id", "spot", "p", "x.*").where(F.size("l") > 0)
    # most matches share not even the next line with another
    side = side.withColumn("k", F.xxhash64("way", "mark", "base", F.col("l")[0]))
    twins = side.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    alive = ws.cut(side.join(twins.hint("merge"), "k").drop("k"), "alive")
    widths = F.transform(F.sequence(F.lit(1), F.size("l")), lambda w: F.struct(w.alias("w"), F.xxhash64("way", "mark", "base", F.slice("l", F.lit(1), w)).alias("k")))
    deep = alive.select("id", "spot", "p", "way", "edge", F.explode(widths).alias("x")).select("id", "spot", "p", "x.k", (F.col("edge") + F.col("way") * F.col("x.w")).alias("line"))
    lead = deep.groupBy("k").agg(F.min(F.struct("id", "spot", "p")).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "o")
    found = deep.join(lead.hint("merge"), "k").where(F.struct("id", "spot", "p") != F.col("o"))
    return found.select("id", "spot", F.col("line").cast("int").alias("p"))


def _common(mine: str, theirs):
    """How many elements two arrays share from the start on."""
    same = F.zip_with(F.col(mine), theirs, lambda x, y: x.eqNullSafe(y))
    stop = F.array_position(same, F.lit(False))
    least = F.least(F.size(mine), F.size(theirs)).cast("long")
    return F.when(stop == 0, least).otherwise(F.least(stop - 1, least)).cast("int")
