import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice(["ba", "do", "ki", "lu", "me", "no", "ra", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def small(spark):
    """A table with copies, near copies, shared lines, odd texts."""
    rng = random.Random(5)
    rows = []
    shared = words(rng, 30)
    for i in range(60):
        lines = [words(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 5))]
        if i % 7 == 0:
            lines.insert(0, shared)
        rows.append((i, "\n".join(lines), ("en", "fr", None)[i % 3], f"s{i % 5}" if i % 11 else None, 0))
    for i in range(60, 75):
        text = rows[i - 60][1].split(" ")
        text[rng.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text), "en", "s1", 0))
    for i in range(75, 85):
        rows.append((i, rows[i - 70][1].upper(), "en", "s2", 0))
    odd = [None, "", " \n\t ", "one", "two words", "Été 中文字符 \U0001f600", "<s>[INST] x [/INST]", "a\x00b\x1cc"]
    rows += [(85 + i, t, None, "s3", None) for i, t in enumerate(odd)]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    long = "word " * 60_000 + "x" * 50_000
    rows = [
        (1, None, None, None, None), (None, "text without id", "en", "a", 1), (2, "", "en", "a", 0), (3, long, "en", "b", 1), (3, long, "en", "b", 1),
        (4, "same line of some length here\nsame line of some length here", "fr", None, 1), (4, "same line of some length here\nsame line of some length here", "fr", None, 1),
        (5, "tie", None, "a", 1), (5, "other text for the tied id", None, "a", 1), (6, "tie", "de", "c", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("id", "key", "size", "bucket", "place", "fp", "group", "rank", "toxic", "l_id", "row", "rep", "h", "hash", "source_size", "target", "line_count", "ids", "matches", "c_text", "dropped_id", "word", "s", "n", "order"):
        df = df.selectExpr("*", f"7 as `{c}`")
    return df.cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
