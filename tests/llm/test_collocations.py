import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tabwright.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, min_count=100, top=2000):
    out = []
    count, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    count[lang, tuple(w[i:i + m])] += 1
    cand = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= min_count}
    for (lang, ws), a in cand.items():
        score, k = min((1000 * a * n[lang] // (count[lang, ws[:k]] * count[lang, ws[k:]]), k) for k in range(1, len(ws)))
        if not any(o[0] == lang and len(o[1]) > len(ws) and 100 * f >= 100 * a
                   and any(o[1][i:i + len(ws)] == ws for i in range(len(o[1]) - len(ws) + 1)) for o, f in cand.items()):
            out.append((lang, -score, -a, " ".join(ws).encode(), count[lang, ws[:k]], count[lang, ws[k:]]))
    out.sort()
    rank, result = Counter(), set()
    for lang, score, a, phrase, left, right in out:
        rank[lang] += 1
        if rank[lang] <= top:
            result.add((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return result


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return df.withColumns({c: F.lit("q") for c in ("t", "l", "h", "c", "f", "word", "phrase", "w0", "ws", "n", "out")})


def corpus(rnd, docs, vocabulary):
    ws = [f"{c}{k}" for k, c in zip(range(vocabulary), "aÉbçdEfgßhij" * vocabulary)]
    rows = []
    for i in range(docs):
        text = "".join(rnd.choice(ws) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\x0b"]) for _ in range(rnd.randint(0, 60)))
        if i % 3 == 0:
            text += " New York City Hall of " + rnd.choice(ws) + " ß"
        rows.append((i, rnd.choice([text, text, text, None, ""]), rnd.choice(["en", "de", None, "und"])))
    return rows


def test_against_plain_counts(spark):
    rnd = random.Random(11)
    for docs, vocabulary, least in ((120, 6, 100), (150, 12, 10), (40, 30, 3)):
        rows = corpus(rnd, docs, vocabulary)
        assert {tuple(r) for r in C.collocations(frame(spark, rows), least).collect()} == plain(rows, least)


def test_small_blocks_and_long_text(spark, monkeypatch):
    rnd = random.Random(12)
    rows = corpus(rnd, 30, 5) + [(99, "new york " * 30_000, "en")]
    assert {tuple(r) for r in C.collocations(frame(spark, rows), 20, top=7).collect()} == plain(rows, 20, 7)


def test_products_beyond_64_bits(spark):
    freq = spark.createDataFrame([("en", "a", 1, 4_000_000_000_000), ("en", "b", 1, 5_000_000_000_000), ("en", "a b", 2, 3_000_000_000_000)],
                                 "lang string, phrase string, words int, f long")
    total = spark.createDataFrame([("en", 90_000_000_000_000)], "lang string, n long")
    import unittest.mock as m
    with m.patch.object(C, "phrase_counts", return_value=(total, freq)):
        (r,) = C.collocations(freq).collect()
    assert r.score == 1000 * 3_000_000_000_000 * 90_000_000_000_000 // (4_000_000_000_000 * 5_000_000_000_000)


def test_no_rows(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(frame(spark, [(1, None, "en"), (2, "", None), (3, " \t.", "en")]), 1).collect() == []
