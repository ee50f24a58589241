"""Small tables for the corpus operators."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]

LONG = " ".join(f"word{i % 977} runs" for i in range(30_000))
NEAR = " ".join(f"token{i}" for i in range(120))
EDGES = [
    (1, "The quick brown fox", "en", "a", 19),
    (2, "the QUICK brown fox", "en", "a", 19),
    (2, "the QUICK brown fox", "en", "a", 19),  # a repeated row
    (3, None, None, "b", None),
    (4, "", "en", None, 0),
    (None, "a row without an id", "en", "b", None),
    (5, " \t\n ", "en", "b", 4),
    (6, LONG, "en", "c", len(LONG)),
    (7, NEAR, "en", "c", len(NEAR)),
    (8, NEAR + " end", "en", "c", len(NEAR) + 4),
    (9, NEAR.upper(), "en", "a", len(NEAR)),
    (10, "Éa ß ñ 漢字 😀 <|endoftext|>  two  spaces", "es", "a", 30),
    (11, "one", "en", "a", 3),
]


def frame(spark, rows=EDGES):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """With extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = "row label features digest bag bands band group size turn sent taken target h norm bucket place extra _id _text _score score"
    return df.withColumns({n: F.lit(f"own {n}") for n in names.split()})


def nulls(df):
    """Every column null."""
    from pyspark.sql import functions as F

    return df.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
