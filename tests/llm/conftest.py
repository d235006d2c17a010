import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, grp string, size long, h long, lines string, c0 string"
LONG = "\n".join(f"line {i} of the very long text with word{i % 97} and word{i % 89}" for i in range(4000))
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 2


@pytest.fixture(scope="session")
def rows():
    """Edge cases: nulls, empty and blank texts, ties, repeated rows, near copies, a very long text."""
    near = BASE.split()
    near[7] = "other"
    t = [
        (1, "Hello there world. This is the first text of all, it has some words.\nAll rights reserved."), (2, None), (3, ""), (4, "   \n\t "), (5, "one two"), (6, "one  two"), (7, LONG), (8, LONG), (8, LONG), (9, BASE), (10, " ".join(near)),
        (11, BASE.upper()), (12, "日本語 😀 naïve ▁ café"), (13, "x" * 5000), (14, "Licensed under CC BY-NC 4.0.\n" + BASE), (15, "a b c d"), (16, "A b C d"), (None, "without an id"), (17, ""), (18, "same line\n" * 30), (19, "1234 5678 !!! ###"),
    ]
    return [(i, x, None if i == 5 else "en", None, None if x is None else len(x), 99, "g", 1, 2, "l", "c") for i, x in t]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
