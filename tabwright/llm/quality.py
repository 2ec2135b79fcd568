"""Quality by weak supervision: rules vote or abstain, EM learns their accuracies, the posterior decides.

Everything is DataFrame functions.  Signals come from one scan; each rule turns them into a vote (good, bad or
none).  The votes' joint counts are a table of at most 3^8 patterns, whatever the number of documents; EM over
that table fits, per rule, how often a vote is right on good and on bad documents, and the share of good
documents, over the documents that the base rule leaves open: those it rejects need no verdict, and being mostly of one
kind they would teach the rules that kind of junk alone.  A document's verdict is the posterior probability that it is good, as one column expression of its
votes, instead of requiring that all rules pass.

Null text counts as empty: no words, every count 0, base_failed.  Repeated rows are judged alike; the other
columns of the input are not read.  A table without rows gives a table without rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur at least twice in the text."""
    def covered(w):
        grams = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.struct(
            F.xxhash64(*[F.get(w, i + j) for j in range(width)]).alias("h"), i.alias("i"))))

        def repeated(s):
            return F.transform(F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                                        | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])
        return F.aggregate(F.sort_array(_let(grams, repeated)), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                           lambda a, i: F.struct((a["n"] + width - F.greatest(a["end"] - i, F.lit(0))).alias("n"),
                                                 (i + width).alias("end")), lambda a: a["n"])
    return _let(words, lambda w: F.when(F.size(w) > width, covered(w)).otherwise(0))


def signals(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at; one scan, no shuffle."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", t.alias("_t"))
    words = F.filter(F.split("_t", SPACE), lambda x: x != "")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: (F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))).cast("long")
    return base.select(
        "doc_id", F.size(words).cast("long").alias("n_words"), F.length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("_n_lines"), count("[A-Z]+").alias("_upper"), count(r"[\p{L}]+").alias("_letters"),
        count(r"[.!?](?=[\x20\x09-\x0D]|$)").alias("_ends"), count(r"[0-9]+").alias("_digits"))


def votes() -> dict[str, tuple[Column, Column]]:
    """(good, bad) condition of each rule; neither: it abstains."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = {c: F.col(c) / d for c, d in (("n_symbols", chars), ("n_repeat_words", words), ("_upper", chars), ("_letters", chars),
                                          ("_ends", words), ("_digits", chars))}
    dup, mean = F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)), F.col("word_chars") / words
    return {
        "length": (F.col("n_words") >= 30, F.col("n_words") < 12),
        "symbols": (share["n_symbols"] <= 0.01, share["n_symbols"] > 0.05),
        "dup_lines": (dup <= 0.1, (dup > 0.3) & (F.col("n_dup_lines") >= 3)),
        "repeats": (share["n_repeat_words"] <= 0.05, share["n_repeat_words"] > 0.15),
        "word_length": (mean.between(3.0, 9.0), (mean < 2.0) | (mean > 14.0)),
        "capitals": (share["_upper"] <= 0.1, share["_upper"] > 0.3),
        "letters": (share["_letters"] >= 0.85, share["_letters"] < 0.7),
        "sentences": (share["_ends"].between(0.01, 0.5), (share["_ends"] == 0) & (F.col("n_words") >= 50)),
    }


def learn(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, tolerance: float = 1e-9,
          most: float = 0.999) -> tuple[float, list[tuple[float, float]]]:
    """EM over (votes, count) rows: log odds of good, and per rule the log odds that a good / a bad vote adds.

    The start is a good document that passes every rule and a bad one that fails one of them, whatever the number of
    documents.  Accuracies on good documents stay in [0.99, 0.999]: the bad thresholds are wide, and without that
    bound a rarer kind of junk is explained as good documents on which one rule errs.  On bad documents, most of
    which fail one rule and pass the others, they may fall to 0.02: a good vote then says next to nothing, a bad
    vote still counts.  ``most`` is their upper bound there: at 0.5 a good vote adds 0.7 at most, so that a rule which
    finds the commonest kind of junk can't clear by its good vote what another rule finds."""
    rules = len(patterns[0][0]) if patterns else 0
    prior, acc = 0.8, [[0.99, min(1 / rules, most)] for _ in range(rules)]    # right on good documents, right on bad ones
    odds = lambda: (math.log(prior / (1 - prior)), [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in acc])
    last = None
    for _ in range(rounds):
        start, per = odds()
        post = []
        for v, _n in patterns:
            z = start + sum(per[j][0] if x > 0 else per[j][1] for j, x in enumerate(v) if x)
            post.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
        total = sum(n for _, n in patterns)
        prior = min(0.99, max(0.5, (sum(p * n for p, (_, n) in zip(post, patterns)) + 0.8) / (total + 1))) if total else prior
        for j in range(rules):
            for c in (0, 1):
                w = [(p if c == 0 else 1 - p) * n for p, (v, n) in zip(post, patterns) if v[j]]
                right = [(p if c == 0 else 1 - p) * n for p, (v, n) in zip(post, patterns) if v[j] == (1 if c == 0 else -1)]
                acc[j][c] = min((0.999, most)[c], max((0.99, 0.02)[c], (sum(right) + 0.8) / (sum(w) + 1)))
        now = [prior, *[x for a in acc for x in a]]
        if last and max(abs(x - y) for x, y in zip(now, last)) < tolerance:
            break
        last = now
    return odds()


def judge(docs: DataFrame, min_words: int = 10, max_repeat_pct: int = 20, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, p_good (posterior) and kept."""
    from tabwright.session import cut_lineage
    rules = votes()
    seen = signals(docs).withColumns({f"_v_{k}": F.when(bad, -1).when(good, 1).otherwise(0) for k, (good, bad) in rules.items()})
    seen = cut_lineage(seen.drop("_n_lines", "_upper", "_letters", "_ends", "_digits"))
    names = [f"_v_{k}" for k in rules]
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    table = seen.where(~failed).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect()      # at most 3^8 rows
    start, per = learn([(tuple(r[c] for c in names), r["n"]) for r in table], most=0.5)
    z = F.lit(start)
    for c, (good, bad) in zip(names, per):
        z = z + F.when(F.col(c) == 1, F.lit(good)).when(F.col(c) == -1, F.lit(bad)).otherwise(0.0)
    p = 1 / (1 + F.exp(-z))
    return seen.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                       (~failed & (p >= threshold)).alias("kept"), p.alias("p_good"))
