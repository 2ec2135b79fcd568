"""The pipeline over a small table, each stage against a plain version of it."""

import corpus_pipeline
from tabwright.llm import queries

from .conftest import words
from .test_jaccard_join import brute as near_brute
from .test_line_dedup import brute as line_brute


def test_stages(spark, rnd, tmp_path):
    bench = [" ".join(words(rnd, 25)) for _ in range(5)]
    rows, labels, toxic = [], [], set()
    for i in range(400):
        w = words(rnd, rnd.randint(30, 120), 10 ** 5)
        if rnd.random() < 0.25:
            toxic.add(i)
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["vile", "rotten", "scummy"]))
        text = " ".join(w)
        if i % 3 == 0:
            text += "\nsubscribe to our letter today"
        if i % 50 == 7:
            text += "\n" + bench[i % 5]
        rows.append((i, text, "en", f"s{i % 12}", len(text)))
        labels.append((i, 1, int(i in toxic)))
    rows += [(1000 + i, rows[i][1], "en", "s0", 1) for i in range(0, 60, 5)] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([*enumerate(bench)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, outs = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        assert k == 4 or docs.columns == columns, name
        outs.append(docs.collect())
    ids = lambda x: sorted(r.doc_id for r in x)
    want = {r[0] for r in rows if r[0] not in toxic and not (1000 <= r[0] < 2000 and r[0] - 1000 in toxic)}
    assert len(set(ids(outs[0])) ^ want) <= 4
    lines = {r[0]: r[4] for r in line_brute([(r.doc_id, r.text, r.source) for r in outs[0]], 10)}
    assert {r.doc_id: r.text for r in outs[1]} == lines and any("subscribe" in (r.text or "") for r in outs[0])
    near = near_brute([(r.doc_id, r.text, None) for r in outs[1]], 5, 80)
    assert ids(outs[2]) == sorted(r[0] for r in near if r[0] == r[2])
    assert ids(outs[3]) == [r.doc_id for r in sorted(outs[2], key=lambda r: r.doc_id) if not any(b in (r.text or "") for b in bench)]
    assert ids(outs[4]) == ids(outs[3])
    assert ids(corpus_pipeline.run(spark, sf).collect()) == ids(outs[4])


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
