"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, and columns whose names clash."""

from pyspark.sql import DataFrame, SparkSession

LONG = "lorem ipsum dolor " * 4000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, hash long, size long, score double, row long, kept boolean, fp long, `class` string, digest string, unit string"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """From (doc_id, text, source) rows; the other columns bear names that operators use inside."""
    full = [(i, t, "en", s, None, 7, 7, 7, 0.5, 7, True, 7, "x", "x", "x") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows() -> list[tuple]:
    return [
        (1, None, "a"), (2, "", "a"), (3, LONG, "b"), (4, LONG, "b"), (5, "one two three", None), (5, "one two three", None), (5, "another text with the same id", "c"),
        (None, "a text without id", None), (None, "a text without id", None), (6, "x" * 5000, "a"), (7, " \n\t ", ""), (8, "naïve 漢字 🙂 text", "ü"), (9, "One Two Three", "a"),
    ]


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, [])


def sample(n: int = 160, seed: int = 3) -> list[tuple]:
    """Random texts with exact and near copies, shared passages, and personal data."""
    import random

    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    line = " ".join(rng.choice(words) for _ in range(40))
    rows: list[tuple] = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.15:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.35:
            parts = rng.choice(rows)[1].split(" ")
            parts[rng.randrange(len(parts))] = rng.choice(words)
            text = " ".join(parts)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))
            if rng.random() < 0.3:
                text += "\n" + line + "\n" + text[:150]
        rows.append((i * 3 + 1, text, rng.choice(["a", "a", "a", "b", "c", None])))
    rng.shuffle(rows)
    return rows
