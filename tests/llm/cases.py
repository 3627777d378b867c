"""Small frames that all operators must handle."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Documents of (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def with_clashing_columns(df):
    """Extra columns with names that operators use inside."""
    for name in ("fp", "key", "tokens", "h", "row", "spans", "u", "v", "label", "kept_sha256", "n_tokens", "value", "path", "item_id", "_words", "_lang", "_row", "_text", "_bad", "_hit", "_id"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


def odd_rows():
    """Nulls, empties, white space, ties, repeated rows, a long text."""
    rng = random.Random(5)
    long = " ".join(rng.choice("the of and to in is that water stone river light".split()) + str(rng.randint(0, 99)) for _ in range(30_000))
    return [(1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (4, "one"), (5, "One  two"), (6, "a b c d e f g"), (6, "another text of that id"), (None, "a b c d e f g"), (7, long), (8, "ÀÉ É naïve ß € 漢字 🙂 \x1c x")]


def prose(rng, n, words=None):
    words = words or [a + b for a in "th er on an re in st".split() for b in "he an ing ed or at ly es".split()]
    return " ".join(rng.choice(words) for _ in range(n))
