"""Text functions that stay inside Catalyst: folding, containment, trigrams, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that are folded together, and those that vanish.
FOLD_FROM, FOLD_TO = "эёыйщьъ", "ееииш"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c) -> Column:
    """Lower case with look-alike Cyrillic letters as one; null gives null."""
    return F.translate(F.lower(_col(c)), FOLD_FROM, FOLD_TO)


def words(c) -> Column:
    """The words of a text in their order: runs of letters, digits and underscores, folded."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def contains_any(c: Column, needles: list[str]) -> Column:
    """Whether a text holds one of the literals; no pattern, so nothing to escape."""
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def word_starts(c: Column, term: str) -> Column:
    """Whether a word begins with the term."""
    quoted = "".join("\\" + x if not x.isalnum() and not x.isspace() else x for x in term)
    return c.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){quoted}")


def trigrams(c) -> Column:
    """Distinct three-letter substrings; shorter texts have none."""
    c = _col(c)
    n = F.length(c)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(c, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union; null where both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either)
