import hashlib

import numpy as np

from tabwright.llm.suffix_dedup import merged, remove_repeats


def brute(texts, k):
    raw, seen = [(t or "").encode() for t in texts], {}
    for i, b in enumerate(raw):
        for p in range(len(b) - k + 1):
            seen.setdefault(b[p:p + k], []).append((i, p))
    gone = [np.zeros(len(b), bool) for b in raw]
    for at in seen.values():
        if len(at) > 1:
            for i, p in at:
                gone[i][p:p + k] = True
    return [(len(b), int(m.sum()), int((m & ~np.insert(m[:-1], 0, False)).sum()) if len(b) else 0,
             hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()) for b, m in zip(raw, gone)]


def compare(spark, rows, k, gap):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    out = remove_repeats(df, k, gap).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in out)
    assert all(r.n_kept == r.n_bytes - r.n_removed for r in out)
    want = sorted(zip([-1 if i is None else i for i, _ in rows], brute([t for _, t in rows], k)))
    assert got == want
    return sum(w[1][1] > 0 for w in want)


def test_against_all_substrings(spark, rnd):
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    k, gap = 100, 40
    pool = [text(rnd.choice([100, 101, 103, 110, 120, 139, 140, 141, 150, 200, 300])) for _ in range(25)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            parts.append(text(rnd.randint(0, 60)))
            if rnd.random() < 0.7:
                p = rnd.choice(pool)
                parts.append(p[rnd.randint(0, 25):len(p) - rnd.randint(0, 25)] if rnd.random() < 0.5 else p)
        rows.append((i, "".join(parts)))
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (7, rows[7][1]), (None, rows[9][1]), (None, None), (1002, ""), (1003, "x" * 500),
             (1004, "é" * 200), (1005, text(40) * 20)]
    assert compare(spark, rows, k, gap) > 50


def test_nothing_to_do(spark):
    assert compare(spark, [(1, "a" * 50), (2, None)], 100, 40) == 0
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).count() == 0
    assert merged([(5, 9), (1, 3), (3, 4), (8, 12)]) == [(1, 4), (5, 12)]
