import random

import pytest

WORDS = "alpha beta gamma delta river stone cloud green table window music paper light winter summer ocean forest garden silver copper".split()


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows, near copies and shared lines."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))
    shared = "This very line is common to many documents"
    rows = [(None, text(30), "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "b"), (4, "one two", "de", "b"), (4, "one two", "de", "b"), (5, text(30000), "en", "é")]
    base = text(60)
    rows += [(10 + i, base, "en", "a") for i in range(5)]
    for i in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = f"changed{i}"
        rows.append((20 + i, " ".join(w), "fr", "a"))
    rows += [(40 + i, f"{text(12)}\n{shared if i % 2 else shared.upper() + ' '}\n\n{text(9)} über ß", "en", f"s{i % 4}") for i in range(20)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows, with extra columns whose names clash with those that operators make."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, size string, node string, pos int"
    rows = [(*r, len(r[1] or ""), 0.5, "mine", None, "n", 7) for r in odd_rows]
    return spark.createDataFrame(rows, schema).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
