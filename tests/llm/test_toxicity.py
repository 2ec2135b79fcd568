from pyspark.sql import functions as F

from tabwright.llm import toxicity as T

from .conftest import table, words


def corpus(rnd, n=600):
    rows, labels = [], []
    for i in range(n):
        w, bad = words(rnd, rnd.randint(20, 120)), rnd.random() < 0.3
        if bad:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["Vile", "rotten", "SCUMMY"]))
        rows.append((i, " ".join(w), f"s{i % 3}"))
        labels.append((i, int(bad)))
    return rows, labels


def test_learns_and_keeps_to_the_fold(spark, rnd):
    rows, labels = corpus(rnd)
    odd = [(9001, None, None), (9002, "", "s"), (None, "vile rotten scummy", "s"), (9003, "vile " * 30_000, "s"), (5, rows[5][1], "s2")]
    docs = table(spark, rows + odd)
    lab = spark.createDataFrame([*labels, (77_777, 1), (3, None), (9002, None)], "doc_id long, toxic int")
    got = T.score_toxicity(docs, lab).collect()
    assert len(got) == len(rows) + len(odd)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[5]) == 1 and by[9001] == by[9002] and min(by[9003]) > 0.5
    # labels of the held-out fold must not matter
    flipped = lab.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in T.score_toxicity(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in got)
    kept = T.drop_toxic(docs, lab)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted == 0)


def test_nothing_to_learn(spark):
    docs = table(spark, [(1, "a b", "s"), (2, None, None)])
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.score_toxicity(docs, lab).collect()} == {0.0}
    assert T.drop_toxic(docs, lab).count() == 2
    assert T.score_toxicity(docs.limit(0), lab).count() == 0


def test_scoring_takes_little_memory():
    """Features of many texts at once need no more than those of a small block of them."""
    import tracemalloc

    import pyarrow as pa
    from tabwright.llm import textnum as tn
    from tabwright.llm import toxicity as T
    text = pa.array([" ".join(f"w{(i * 7919 + j * 104729) % 5000}" for j in range(300)) for i in range(2000)])
    sum(len(x) for _, x in T.features(text.slice(0, 10)))
    tn._POW[0], tn._POW[1] = tn._POW[0][:1], tn._POW[1][:1]
    tracemalloc.start()
    rows = [r for r, _ in T.features(text)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == list(range(2000)) and most < 30e6
