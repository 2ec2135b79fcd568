import re

from tabwright.llm import jaccard_join as J

from .conftest import table, words


def sets_of(rows, k):
    out = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append(set(zip(*[w[j:] for j in range(k)])) if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(rows, k, pct):
    s = sets_of(rows, k)
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not s[a]:
                continue
            both = len(s[a] & s[b])
            if 100 * both >= pct * (len(s[a]) + len(s[b]) - both):
                root[find(a)] = find(b)
    low = {}
    for a, r in enumerate(rows):
        if r[0] is not None:
            low[find(a)] = min(low.get(find(a), r[0]), r[0])
    return [(r[0], len(s[a]), None if r[0] is None else low[find(a)]) for a, r in enumerate(rows)]


def edited(rnd, w, n):
    w = list(w)
    for _ in range(n):
        p = rnd.randrange(len(w))
        w[p:p + rnd.randrange(2)] = [f"new{rnd.randrange(10 ** 6)}"] * rnd.randrange(2)
    return w


def corpus(rnd):
    rows = []
    common = words(rnd, 30)
    for f in range(12):
        base = words(rnd, rnd.choice([3, 8, 12, 40, 90, 200]))
        for _ in range(rnd.randint(1, 25)):
            rows.append(" ".join(edited(rnd, base, rnd.randint(0, 4))))
    for _ in range(40):
        rows.append(" ".join(words(rnd, 20) + common + words(rnd, 20)))
    rows += ["", None, "one", "One", "one two", "  ONE\ttwo\n", "a b c d", "a b c d e"]
    rnd.shuffle(rows)
    return [(i + 10, t, "s") for i, t in enumerate(rows)] + [(3, rows[0], "s"), (3, rows[0], "s"), (None, rows[1], "s")]


def test_against_all_pairs(spark, rnd, monkeypatch):
    rows = corpus(rnd)
    for k, pct in ((4, 85), (5, 80)):
        got = J.link_components(table(spark, rows, extra=("v", "vec", "hub")), k, pct).collect()
        key = lambda r: tuple(-1 if x is None else x for x in r)
        assert sorted(map(key, (tuple(r) for r in got))) == sorted(map(key, brute(rows, k, pct)))


def test_linked_sets_share_a_signature(rnd):
    import pyarrow as pa
    for pct in (80, 85):
        bounds, shared = J.size_classes(pct), 0
        for _ in range(300):
            base = words(rnd, rnd.choice([6, 9, 15, 60, 300]), 10 ** 6)
            pair = [" ".join(base), " ".join(edited(rnd, base, rnd.randint(1, max(1, len(base) // 40))))]
            (_, a), (_, b) = J.shingle_sets(pa.array(pair), 4)
            both = len(set(a.tolist()) & set(b.tolist()))
            if len(a) and 100 * both >= pct * (len(a) + len(b) - both) and set(a.tolist()) != set(b.tolist()):
                assert set(J.signatures(a, bounds, pct).tolist()) & set(J.signatures(b, bounds, pct).tolist())
                shared += 1
        assert shared > 30


def test_large_blocks_are_dealt_out(spark):
    """Pairs of hubs that span several cells, against all pairs that share a block under the same bound."""
    import numpy as np
    rng = np.random.default_rng(5)
    base = rng.integers(0, 9, J.COORDS)
    pts = [np.clip(base + rng.integers(-2, 3, J.COORDS) * (rng.random(J.COORDS) < rng.random()), 0, None).astype(np.uint8) for _ in range(60)]
    blocks = {s: sorted(rng.choice(60, 25, replace=False).tolist()) for s in range(1, 9)}
    label = [i % 7 if i % 3 else i + 100 for i in range(60)]
    points = spark.createDataFrame([(1000 + i, i, int(p.sum()), bytearray(p.tobytes())) for i, p in enumerate(pts)], "v long, id long, n long, vec binary")
    members = spark.createDataFrame([(s, 1000 + i, label[i]) for s, m in blocks.items() for i in m], "sig long, v long, label long")
    want = {(1000 + i, 1000 + j) for m in blocks.values() for i in m for j in m if i < j and label[i] != label[j]
            and 185 * int(np.minimum(pts[i], pts[j]).sum()) >= 85 * (int(pts[i].sum()) + int(pts[j].sum()))}
    for cell in (1024, 16):
        old, J.CELL = J.CELL, cell
        try:
            got = {(r.a, r.b) for r in J._block_pairs(members, points, 85).collect()}
        finally:
            J.CELL = old
        assert got == want and want


def test_stage_and_empty(spark, rnd):
    docs = table(spark, corpus(rnd))
    kept = J.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = [r for r in brute([(r.doc_id, r.text, None) for r in docs.collect()], 5, 80) if r[0] is None or r[0] == r[2]]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in want)
    assert J.link_components(docs.limit(0)).count() == 0


def test_frequent_signatures_are_left_out(spark):
    """Sets with a common passage meet far less often, while linked ones still meet."""
    import numpy as np
    rng, bounds = np.random.default_rng(3), J.size_classes(80)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    passage = draw(60)
    sets = [np.unique(np.concatenate([passage, draw(int(rng.integers(520, 560)))])) for _ in range(80)]
    sets += [np.unique(np.concatenate([rng.permutation(u)[:-30], draw(20)])) for u in sets[:30]]
    block = {}
    for v, u in enumerate(sets):
        for s in J.signatures(u, bounds, 80).view(np.int64).tolist():
            block.setdefault(s, set()).add(v)
    block = {s: m for s, m in block.items() if len(m) > 1}
    meet = lambda rows: {(a, b) for m in rows.values() for a in m for b in m if a < b}
    points = spark.createDataFrame([(v, len(u)) for v, u in enumerate(sets)], "v long, n long")
    kept = {}
    for r in J._rarest(spark.createDataFrame([(s, v) for s, m in block.items() for v in m], "sig long, v long"), points, 80).collect():
        kept.setdefault(r.sig, set()).add(r.v)
    before, after = meet(block), meet(kept)
    linked = {(a, b) for a, b in before if 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]))}
    assert linked == {(v, 80 + v) for v in range(30)}
    assert linked <= after <= before and len(after) < len(before) / 4


def test_bitmaps_bound_what_sets_share():
    import numpy as np
    rng, ruled_out = np.random.default_rng(4), 0
    for n in (1, 5, 63, 64, 65, 300, 5000):
        u = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0, 0.3, 0.9, 1):
            w = np.unique(np.concatenate([u[rng.random(len(u)) < share], rng.integers(0, 1 << 63, max(1, n // 5)).astype(np.uint64)]))
            most, both = J.most_common(J.bitmap(u), J.bitmap(w), len(u), len(w)), len(np.intersect1d(u, w))
            assert both <= most <= min(len(u), len(w))
    for _ in range(50):
        u, w = (np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64)) for _ in range(2))
        ruled_out += 180 * J.most_common(J.bitmap(u), J.bitmap(w), len(u), len(w)) < 80 * (len(u) + len(w))
    assert ruled_out == 50


def test_batches_are_bounded_in_bytes(spark):
    import pyarrow as pa

    def nbytes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["id"])

    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]
    with J._batches_of(spark, 50, 100_000):
        assert [spark.conf.get(k) for k in keys] == ["50", "100000"]
        rows = spark.range(400, numPartitions=1).selectExpr("id", "repeat('x', 20000) t")
        sizes = rows.mapInArrow(nbytes, "id long").collect()
        assert max(r.id for r in sizes) < 200_000
    assert [spark.conf.get(k) for k in keys] == before
