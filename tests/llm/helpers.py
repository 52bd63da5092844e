"""Fixtures that the operators' tests share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n)]


def frame(spark, texts, schema: str = SCHEMA, **extra):
    """Documents 0.. with these texts; a (doc_id, text) pair sets the id."""
    rows = []
    for i, t in enumerate(texts):
        doc_id, text = t if isinstance(t, tuple) else (i, t)
        rows.append((doc_id, text, "en", f"src{i % 3}", None if text is None else len(text)))
    df = spark.createDataFrame(rows, schema)
    for name, value in extra.items():
        df = df.selectExpr("*", f"{value} as `{name}`")
    return df


#: Columns with names that an operator might use itself.
CLASHING = {"id": "1", "node": "'x'", "keep": "false", "n": "2", "pos": "3", "key": "'k'", "identity": "4", "quality": "0", "toxic": "1", "host": "'h'", "path": "'p'", "shard": "9", "chunk": "1", "root": "1", "start": "1", "length": "1", "piece": "1"}


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
