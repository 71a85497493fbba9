"""Rows that every operator must take: nulls, empty and very long texts, ties, repeats, clashing column names."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, component_id string, kept boolean"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    long = words(1, 60_000, 50_000)
    texts = [
        (1, words(2, 80), "en", "a"),
        (2, None, "en", "a"),
        (3, "", "fr", "b"),
        (4, " \t\n ", None, None),
        (5, words(2, 80), "en", "a"),
        (5, words(2, 80), "en", "a"),
        (None, words(2, 80), "en", None),
        (None, None, None, None),
        (6, long, "fr", "b"),
        (7, "Ünïcode ÉTÉ 　 жук 𝛼 " + words(3, 40), "fr", "b"),
        (8, "x", "en", "c"),
        (9, "1234 5678 !!", "en", "c"),
    ]
    return [(i, t, lang, source, None, 0.5, 7, "clash", False) for i, t, lang, source in texts]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.filter(F.col("doc_id").isNotNull()).collect()}
