"""Places of literals in texts, found in a canonical form and mapped back to the text that was given.

Canonical: lower case, one spelling for letters that sources write in several ways, no apostrophes, soft
and hard signs. Letters vanish, so each place is carried back through a map from canonical to raw
characters, and excerpts are cut from the raw text. All literals are looked for at once by an automaton in one pass
over a text (Arrow batches, a text at a time); what a rule makes of the places, nearness, order and what speaks against
it, is windows over them, so a text with many places costs their number and not its square.

Nulls and empty texts have no places. The capital I with a dot counts as i.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.functions.scalars import CYRILLIC, LATIN, LOOKALIKE, MOST_READINGS, MOST_VARIANTS, SEVERAL
from bidlake.functions.text import FOLD_FROM, FOLD_TO
from bidlake.session import ship

#: Apostrophes, and Uzbek Cyrillic letters with the nearest Russian ones.
APOSTROPHES, UZBEK = "'‘’ʻ`´", {"ҳ": "х", "қ": "к", "ў": "у", "ғ": "г", "ҷ": "ж", "ө": "о"}
NEAR, BESIDE, AROUND = 80, 40, 70
#: Translation of a lower-case text into its canonical form; what has no counterpart vanishes.
CANON_FROM = FOLD_FROM[: len(FOLD_TO)] + "".join(UZBEK) + FOLD_FROM[len(FOLD_TO) :] + APOSTROPHES
CANON_TO = FOLD_TO + "".join(UZBEK.values())
_CANON = str.maketrans(CANON_FROM[: len(CANON_TO)], CANON_TO, CANON_FROM[len(CANON_TO) :])
PLACES = "literal string, said string, start int, end int, raw_start int, raw_end int, pad_start int, pad_end int, sentence int, word_end int, next_at int, whole boolean"
#: Characters looked at together.
TOGETHER = 1 << 20
_tables: dict = {}


def KINDS(pa) -> list:  # noqa: N802
    return [pa.string(), pa.string(), *[pa.int32()] * 9, pa.bool_()]


def canon(text: str) -> str:
    return text.replace("İ", "i").lower().translate(_CANON)


def _readings(word: str) -> list[str]:
    known = {**{k: [v] for k, v in CYRILLIC.items()}, **SEVERAL}
    longest = "|".join(sorted((re.escape(k) for k in known if len(k) > 1), key=len, reverse=True))
    out = [""]
    for piece in re.findall(rf"{longest}|[\s\S]", word):
        out = [a + b for a in out for b in known.get(piece, [piece])][:MOST_READINGS]
    return [canon_fold(x) for x in out]


def canon_fold(text: str) -> str:
    return text.lower().translate(str.maketrans(FOLD_FROM[: len(FOLD_TO)], FOLD_TO, FOLD_FROM[len(FOLD_TO) :]))


def stem_variants(stem: str) -> list[str]:
    """A stem in all its spellings, canonical; a spelling that shrank below four letters would hit too much and is left out."""
    q = stem.strip().lower()
    derived = []
    if re.search("[Ѐ-ӿ]", q):
        latin = "".join(LATIN.get(c, c) for c in q)
        derived += [latin, *_readings(latin), q.translate(str.maketrans(*LOOKALIKE))]
    if re.search("[a-z'‘ʻ]", q):
        derived += [*_readings(q), q]
    every = list(dict.fromkeys([canon_fold(q), *(x for x in derived if len(x) > 1)]))[:MOST_VARIANTS]
    base = len(canon(stem))
    return list(dict.fromkeys(c for c in map(canon, every) if c and (len(c) >= 4 or len(c) >= base)))


class Letters:
    """For each code point its canonical one (or lower-case one; 0: none) and whether it belongs to words, filled in as texts need them."""

    def __init__(self, canonical: bool):
        import numpy as np

        self.canonical = canonical
        self.known, self.word, self.point = np.zeros(0x110000, bool), np.zeros(0x110000, bool), np.zeros(0x110000, np.uint32)

    def look_up(self, points):
        """The canonical code points, 0 for those that vanish."""
        import numpy as np

        for p in np.unique(points[~self.known[points]]).tolist():
            c = chr(p)
            low = canon(c) if self.canonical else c.lower()
            self.point[p] = ord(low) if len(low) == 1 else 0 if not low else p
            self.known[p] = True
            self.word[self.point[p]] = chr(self.point[p]).isalnum() or self.point[p] == ord("_")
        return self.point[points]


def _letters(canonical: bool) -> Letters:
    if canonical not in _tables:
        _tables[canonical] = Letters(canonical)
    return _tables[canonical]


def _finder(literals: list[str], shapes: dict[str, str], canonical: bool, pad: int, keys: int):
    def find(batches):
        import ahocorasick
        import pyarrow as pa

        letters = _letters(canonical)
        automaton = ahocorasick.Automaton()
        for x in literals:
            automaton.add_word(x, x)
        automaton.make_automaton()
        patterns = {name: re.compile(p) for name, p in shapes.items()}
        for batch in batches:
            texts = [x or "" for x in batch.column(keys).to_pylist()]
            first, size = 0, 0
            for k, text in enumerate(texts):
                size += len(text)
                if size < TOGETHER and k < len(texts) - 1:
                    continue
                got = look(texts[first : k + 1], automaton, patterns, letters, pad)
                if got is not None:
                    own, cols = got
                    for j in range(0, len(own), 50_000):
                        part = slice(j, j + 50_000)
                        at = pa.array(own[part] + first)
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(keys)), *(pa.array(c[part], t) for c, t in zip(cols, KINDS(pa), strict=True))], [*batch.schema.names[:keys], *(x.split()[0] for x in PLACES.split(", "))])
                first, size = k + 1, 0

    def look(texts, automaton, patterns, letters, pad):
        """All places in some texts, looked for at once: which text, and the columns. Texts are joined by line ends, over which nothing reaches."""
        import numpy as np

        raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        raw_first = np.cumsum(lengths + 1) - lengths - 1
        points = letters.look_up(raw)
        back = np.flatnonzero(points)
        points = points[back]
        low = points.astype("<u4").tobytes().decode("utf-32-le")
        found = [(end - len(x) + 1, end + 1, x) for end, x in automaton.iter(low)]
        found += [(m.start(), m.end(), name) for name, p in patterns.items() for m in p.finditer(low)]
        if not found:
            return None
        found.sort()
        a, b = np.array([x[0] for x in found]), np.array([x[1] for x in found])
        begin, end = np.searchsorted(back, raw_first), np.searchsorted(back, raw_first + lengths)
        own = np.searchsorted(begin, a, "right") - 1
        s, e, r = begin[own], end[own], raw_first[own]
        word = letters.word[points]
        breaks, solid, stops = np.flatnonzero(~word), np.append(np.flatnonzero(~np.isin(points, (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0xA0))), len(points)), np.flatnonzero((points == 0x2E) | (points == 0x0A))
        whole = ((a == s) | ~word[a - 1]) & ~word[b]
        cols = [[x[2] for x in found], [low[x[0] : x[1]] for x in found], a - s, b - s, back[a] - r, back[b - 1] + 1 - r, back[np.maximum(a - pad, s)] - r, back[np.minimum(b + pad, e - 1)] + 1 - r]
        return own, [*cols, np.searchsorted(stops, a) - np.searchsorted(stops, s), breaks[np.searchsorted(breaks, b)] - s, np.minimum(solid[np.searchsorted(solid, b)], e) - s, whole]

    return find


def places(texts: DataFrame, key: list[str], text: str, literals: list[str], shapes: dict[str, str] | None = None, canonical: bool = True, pad: int = AROUND) -> DataFrame:
    """Every place of the literals (given in the same form) and shapes (patterns by name) in texts: the key and PLACES.

    start and end are places in the canonical text, raw_ ones in the text itself, pad_ ones the raw
    places of `pad` canonical characters to either side. sentence counts points and line ends before the place, word_end is where the
    word that it ends in ends, next_at where the next character that is no blank stands; whole: it begins and ends with words.
    """
    ship(texts.sparkSession)
    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in key)
    return texts.select(*key, F.col(text).cast("string").alias("__text")).mapInArrow(_finder(sorted(set(literals)), shapes or {}, canonical, pad, len(key)), f"{kinds}, {PLACES}")


def excerpt(text: str, start: str, end: str):
    """The raw text between two places, blanks as one, with dots where something is cut off."""
    said = F.trim(F.regexp_replace(F.expr(f"substring({text}, {start} + 1, {end} - {start})"), r"\s+", " "))
    return F.concat(F.when(F.col(start) > 0, "…").otherwise(""), said, F.when(F.col(end) < F.length(text), "…").otherwise(""))


def near(found: DataFrame, key: list[str], alternatives: DataFrame, against: DataFrame, reach: int = NEAR, beside: int = BESIDE) -> DataFrame:
    """The first place of each alternative in each text: key, rule, n, sure, start, end, raw_start, raw_end, pad_start, pad_end.

    alternatives: rule, n, stem (0 or 1), stems (how many), sure, literal; against: rule, literal. An alternative of two stems needs the
    second within `reach` of the first, in either order, the nearest counts (of two as near the one before). A place doesn't count if
    something against its rule stands between `beside` before and `beside` after it.
    """
    own = ["start", "end", "raw_start", "raw_end", "pad_start", "pad_end"]
    # one stream of places: first stems (0), second ones (1) and what speaks against (2)
    table = alternatives.unionByName(against.select("rule", "literal", F.lit(-1).alias("n"), F.lit(2).alias("stem")), allowMissingColumns=True)
    hits = found.select(*key, "literal", *own).join(F.broadcast(table), "literal").select(*key, "rule", "n", "stem", "stems", "sure", F.struct(*own).alias("x"))
    group = Window.partitionBy(*key, "rule", "n")
    second = F.when(F.col("stem") == 1, F.col("x"))
    before = F.last(second, ignorenulls=True).over(group.orderBy(F.col("x.start"), F.desc("stem"), F.desc("x.end")).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(second, ignorenulls=True).over(group.orderBy(F.desc("x.start"), F.desc("stem"), F.desc("x.end")).rowsBetween(Window.unboundedPreceding, 0))
    rows = hits.withColumn("before", before).withColumn("after", after).where("stem <> 1")
    far = lambda c: F.abs(F.col(f"{c}.start") - F.col("x.start"))
    nearest = F.when(F.col("before").isNotNull() & (F.col("after").isNull() | (far("before") <= far("after"))), F.col("before")).otherwise(F.col("after"))
    rows = rows.withColumn("y", F.when(F.coalesce("stems", F.lit(1)) == 1, F.col("x")).otherwise(nearest)).where(F.col("y").isNotNull() & (far("y") <= reach))
    low = lambda c: F.when(F.col("y.start") < F.col("x.start"), F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(c)
    high = lambda c: F.when(F.col("y.end") > F.col("x.end"), F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(c)
    spans = rows.select(*key, "rule", "n", "stem", "sure", F.col("x.start").alias("at"), low("start"), high("end"), low("raw_start"), high("raw_end"), low("pad_start"), high("pad_end"))
    mark = F.when(F.col("stem") == 2, F.col("start")).otherwise(F.col("start") - beside)
    bad = F.when(F.col("stem") == 2, F.col("end"))
    least = F.min(bad).over(Window.partitionBy(*key, "rule").orderBy(F.desc(mark), F.desc("stem")).rowsBetween(Window.unboundedPreceding, 0))
    good = spans.withColumn("least", least).where((F.col("stem") == 0) & (F.col("least").isNull() | (F.col("least") > F.col("end") + beside)))
    return good.withColumn("k", F.row_number().over(Window.partitionBy(*key, "rule", "n").orderBy("at", "end"))).where("k = 1").drop("k", "stem", "least", "at")
