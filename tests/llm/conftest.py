import random

import pytest


@pytest.fixture
def rnd():
    return random.Random(20240611)


def words(rnd, n, vocabulary=400):
    """n words of letters out of a vocabulary of that size."""
    def word(k):
        out = "bcdfglmnrst"[k % 11] + "aeiou"[k % 5]
        while k:
            out += "bdfgklmnprstvz"[k % 14] + "aeiou"[k // 14 % 5]
            k //= 70
        return out
    return [word(rnd.randrange(vocabulary)) for _ in range(n)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, extra=()):
    """documents with odd extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in ("key", "sig", "label", "score", "n", "pos", "id", "line", "a", "b", *extra)})
