import numpy as np

from tabwright.llm import decontaminate as D

from .conftest import table, words


def brute(item, text):
    prev = [0] * (len(text) + 1)
    for r, c in enumerate(item):
        cur = [r + 1]
        for j, d in enumerate(text):
            cur.append(min(prev[j] + (d != c), prev[j + 1] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_against_all_alignments(rnd):
    letters, found = "ab cde fgh", 0
    for _ in range(40):
        item = "".join(rnd.choice(letters) for _ in range(rnd.randint(5, 150)))
        docs = []
        for _ in range(3):
            d = list(item)
            for _ in range(rnd.randint(0, 8)):
                p = rnd.randrange(len(d) + 1)
                kind = rnd.randrange(3)
                d[p:p + (kind > 0)] = [] if kind == 1 else [rnd.choice(letters)]
            noise = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80)))
            docs.append(noise() + "".join(d) + noise())
        index = D.Index([(7, item)], 0.05)
        cp, off = D.fold(docs)
        got = {row: e for row, _, e, _, _ in index.matches(cp, off)} if index.ids else {}
        for row in range(3):
            want = None
            if index.ids:
                e = brute(list(index.text[0]), list(cp[off[row]:off[row + 1] - 1]))
                want = e if e <= index.k[0] else None
            assert got.get(row) == want
            found += want is not None
    assert found > 20


def test_table(spark, rnd):
    items = [" ".join(words(rnd, 30)) + "." for _ in range(6)]
    clean = " ".join(words(rnd, 300))
    leak = clean[:200] + " " + items[2].upper().replace(" ", "\n ") + " " + clean[200:]
    near = clean + " " + items[4][:40] + "x" + items[4][41:]
    docs = table(spark, [(1, clean, "a"), (2, leak, None), (3, near, "a"), (4, None, "a"), (5, "", "a"), (2, leak, None), (None, leak, "b"),
                         (6, items[0] + " " + items[1], "a")], extra=("t", "item_id"))
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "short"), (11, items[2])], "item_id long, text string")
    got = sorted(((r.doc_id or 0), r.item_id, r.edits) for r in D.find_leaks(docs, bench).collect())
    assert got == [(0, 2, 0), (0, 11, 0), (2, 2, 0), (2, 2, 0), (2, 11, 0), (2, 11, 0), (3, 4, 1), (6, 0, 0), (6, 1, 0)]
    assert sorted(((r.doc_id or 0), r.item_id, r.edits) for r in D.find_leaks(docs, bench, chunk_chars=300).collect()) == got
    kept = D.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    assert D.drop_leaks(docs, bench.limit(0)).count() == 8 and D.find_leaks(docs.limit(0), bench).count() == 0


def test_grams_of_different_texts_never_touch():
    cp, off = D.fold(["abcdef", "ghijkl mnopq"])
    assert list(off) == [0, 7, 20] and cp[6] == 0
    assert len(D.gram_hashes(np.arange(5, dtype=np.uint32))) == 0
