from itertools import combinations

import numpy as np

from tabwright.llm import packing as P

from .conftest import table


def test_boundaries_are_optimal(rnd):
    for _ in range(30):
        v = sorted(rnd.sample(range(1, 60), rnd.randint(1, 9)))
        c = [rnd.randint(1, 20) for _ in v]
        for k in (1, 2, 3, 5):
            cost = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(v, c))  # noqa: E731,B023
            best = min(cost([*s, v[-1]]) for s in combinations(v[:-1], min(k, len(v)) - 1))
            assert cost(P.boundaries(np.array(v), np.array(c), k)) == best


def test_batches(spark, rnd):
    rows = [(i, " ".join(["w"] * rnd.randint(0, 90)), "s") for i in range(300)] + [(7, "w w w", "s"), (7, "w w w", "s"), (None, None, None),
                                                                                   (500, "w " * 5000, "s")]
    got = P.pack(table(spark, rows), buckets=4, budget=512).collect()
    assert len(got) == len(rows)
    seen, size = set(), {}
    for r in got:
        assert r.n_tokens <= r.bucket and (r.bucket, r.batch, r.slot) not in seen
        seen.add((r.bucket, r.batch, r.slot))
        size[r.bucket, r.batch] = size.get((r.bucket, r.batch), 0) + 1
    assert all(n == 1 or n * b <= 512 for (b, _), n in size.items())
    for b in {b for b, _ in size}:
        full = [n for (x, k), n in sorted(size.items()) if x == b]
        assert len(set(full[:-1])) <= 1 and all(n == max(1, 512 // b) for n in full[:-1])
    assert P.pack(table(spark, rows).limit(0)).count() == 0
