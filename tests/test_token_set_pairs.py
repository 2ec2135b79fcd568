import random

import pyarrow as pa
import pytest

from tabwright.operators import molecules as M


def plain(sets, t):
    reps = {}
    for i, s in sets:
        if s and i is not None:
            reps[frozenset(s)] = min(i, reps.get(frozenset(s), i))
    out, items = {}, sorted((i, s) for s, i in reps.items())
    for x, (i, a) in enumerate(items):
        for j, b in items[x + 1:]:
            sim = len(a & b) / len(a | b)
            if i < j and sim >= t:
                out[i, j] = sim
    return out


def some_sets(seed):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.6)) % 400}" for _ in range(4000)]
    out = []
    for _ in range(30):
        base = set(rnd.sample(words, rnd.choice([1, 2, 5, 10, 40, 150])))
        out.append(base)
        for _ in range(rnd.randint(0, 4)):
            near = {w for w in base if rnd.random() > 0.1} | {rnd.choice(words) for _ in range(len(base) // 15)}
            out.append(near)
    out += [set(), out[0], out[3]]
    return [(i, s) for i, s in enumerate(out)]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_pairs_against_all(spark, monkeypatch, threshold):
    monkeypatch.setattr(M, "_CELL", 8)                                # many cells to a size class
    sets = some_sets(int(threshold * 10))
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets], "id long, tokens array<string>").repartition(3)
    got = M.jaccard_threshold_pairs(df, "id", threshold).collect()
    want = plain(sets, threshold)
    assert {(r.id_a, r.id_b): r.jaccard for r in got} == want and len(got) == len(want)


def test_repeated_rows_and_large_sets(spark):
    big = [f"t{i}" for i in range(17_000)]                            # more than 255 tokens in a group
    sets = [(1, big), (2, big[:-100] + ["x", "y"]), (3, big[:9000]), (4, ["a", "b", "c", "d", "e"]), (5, ["a", "b", "c", "d"])]
    df = spark.createDataFrame(sets + sets[4:] + [(None, ["a", "b", "c"]), (6, None)], "id long, tokens array<string>")
    got = sorted((r.id_a, r.id_b) for r in M.jaccard_threshold_pairs(df, "id", 0.8).collect())
    assert got == [(1, 2)] + [(4, 5)] * 4                             # two rows of one key and set stand for four


def test_pairs_are_judged_where_they_meet():
    def meeting(sets):
        r = pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))
        return next(M._meeting_rows(0.8, 0)([pa.record_batch([pa.array(range(len(sets))), r], ["sid", "r"])])).to_pylist()

    def reach(x, y):
        cols = {"a": [x["sid"]], "b": [y["sid"]], "na": [x["n"]], "nb": [y["n"]], "va": [x["vec"]], "vb": [y["vec"]], "ba": [x["before"]], "bb": [y["before"]]}
        return next(M._may_reach(0.8)([pa.RecordBatch.from_pydict(cols)])).num_rows
    common, rnd = set(range(0, 100)), random.Random(2)
    far = [set(range(6)) | set(rnd.sample(range(6, 5000), 94)) for _ in range(2)]     # share their six rarest tokens, no more
    rows = meeting([common, common | {200}, *far])
    at = {(r["sid"], r["rank"]): r for r in rows}
    assert reach(at[2, 0], at[3, 0]) == 0
    assert [reach(at[0, k], at[1, k]) for k in range(3)] == [1, 0, 0]                 # only at the first shared token
