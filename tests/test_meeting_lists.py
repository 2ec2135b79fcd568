import random

import pyarrow as pa
import pytest

from tabwright.operators import molecules as M


def reached(sets, threshold):
    batch = pa.record_batch([pa.array(range(len(sets))), pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))], ["sid", "r"])
    first = {}
    for b in M._meeting_rows(threshold, 0)([batch]):
        for r in b.to_pylist():
            first.setdefault(r["sid"], r)
    x, y = first[0], first[1]
    cols = {"a": [0], "b": [1], "na": [x["n"]], "nb": [y["n"]], "va": [x["vec"]], "vb": [y["vec"]], "ba": [x["before"]], "bb": [y["before"]]}
    return next(M._may_reach(threshold)([pa.RecordBatch.from_pydict(cols)])).num_rows


@pytest.mark.parametrize("size", [30, 300, 1000, 1900])
def test_large_sets_that_share_half_are_ruled_out_where_they_meet(size):
    rnd = random.Random(size)
    words = rnd.sample(range(100, 1_000_000), 3 * size)
    half = words[:size // 2]
    assert reached([{1, *half, *words[size:size + size // 2]}, {1, *half, *words[2 * size:2 * size + size // 2]}], 0.8) == 0
    near = set(words[:size])
    assert reached([near | {1}, near - set(words[:size // 20]) | {1}], 0.8) == 1


@pytest.mark.parametrize("threshold, most", [(0.8, 7), (0.6, 5), (0.4, 4096)])
def test_long_lists_are_dealt_into_chunks(spark, monkeypatch, threshold, most):
    monkeypatch.setattr(M, "_LIST", most)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    sets = [(i, sorted({*rnd.sample(base, rnd.randint(35, 60)), *(f"o{rnd.randrange(30)}" for _ in range(4))})) for i in range(90)]
    df = spark.createDataFrame(sets, "id long, tokens array<string>").repartition(3)
    want = {}
    for i, a in sets:
        for j, b in sets:
            sim = len({*a} & {*b}) / len({*a} | {*b})
            if i < j and sim >= threshold:
                want[i, j] = sim
    got = M.jaccard_threshold_pairs(df, "id", threshold).collect()
    assert {(r.id_a, r.id_b): r.jaccard for r in got} == want and len(got) == len(want)


def test_overlaps_over_several_slices(monkeypatch):
    import numpy as np
    monkeypatch.setattr(M, "_SLICE", 64)
    rnd = random.Random(1)
    sets = [sorted(rnd.sample(range(1000), rnd.randint(1, 400))) for _ in range(20)]
    of = np.repeat(np.arange(20), [len(s) for s in sets])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(20), np.arange(20)))
    keep = a != b
    a, b = a[keep], b[keep]
    got = M._overlaps(of, np.concatenate(sets), a, b)
    assert got.tolist() == [len({*sets[i]} & {*sets[j]}) for i, j in zip(a, b)]
