from tabwright.llm import line_dedup as L

from .conftest import table, words


def brute(rows, sites):
    norm = lambda x: " ".join(x.replace("\t", " ").split(" ")).strip()
    norm = lambda x: " ".join(w for w in x.replace("\t", " ").split(" ") if w)  # noqa: E731,F811
    on = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            on.setdefault(norm(x), set()).add(s)
    def hits(t):
        parts = [] if t is None else t.split("\n")
        return parts, [bool(norm(x)) and len(on[norm(x)]) >= sites for x in parts]
    copies = {}
    for i, t, _ in rows:
        parts, hit = hits(t)
        if any(hit) and sum(hit) == sum(bool(norm(x)) for x in parts):
            copies.setdefault(t, []).append((i is None, i or 0))
    keeps = {(t, min(ids)) for t, ids in copies.items() if len(ids) > 1}
    out = []
    for i, t, _ in rows:
        parts, hit = hits(t)
        cut = any(hit) and (t, (i is None, i or 0)) not in keeps
        out.append((i, sum(bool(norm(x)) for x in parts), sum(hit), sum(hit) if cut else 0, "\n".join(x for x, h in zip(parts, hit) if not h) if cut else t))
    return out


def test_against_exact_counts(spark, rnd):
    boiler = [" ".join(words(rnd, 6)) for _ in range(6)]
    rows = []
    for i in range(150):
        lines = [" ".join(words(rnd, rnd.randint(1, 15), 10 ** 6)) for _ in range(rnd.randint(0, 5))]
        for k, b in enumerate(boiler):
            if rnd.random() < 0.3 and i % 20 < 4 + 3 * k:
                lines.insert(rnd.randint(0, len(lines)), rnd.choice([b, f"  {b.replace(' ', '  ')}\t"]))
        rows.append((i, "\n".join(lines), f"s{i % 20}"))
    rows += [(500, None, None), (501, "", "s1"), (502, "\n\n", None), (None, boiler[5] + "\n" + " ".join(words(rnd, 20)), None), (7, rows[7][1], "s7")]
    rows += [(600 + k, "\n".join(boiler), f"s{k}") for k in range(20)]                     # whole copies on every site
    docs = table(spark, rows, extra=("n_lines", "n_removed", "site", "_at", "_gone", "_k1", "_k2", "_row", "_site", "_keep", "_n_lines"))
    for sites in (4, 10, 16):
        key = lambda r: tuple("" if x is None else x for x in (str(r[0]), *r[1:]))
        got = L.line_dedup(docs, min_sites=sites).collect()
        assert sorted(map(key, map(tuple, got))) == sorted(map(key, brute(rows, sites)))
    kept = L.drop_spread_lines(docs)
    assert kept.columns == docs.columns and all(r.n_chars == len(r.text) for r in kept.collect() if r.text is not None)
    assert L.line_dedup(docs.limit(0)).count() == 0


def test_thresholds_around_the_sketch_error(spark):
    """Lines on 57 to 63 of 100 sites with a small sketch: the exact count decides."""
    rows = [(1000 * n + s, f"line {n}\n" + "\n".join(f"own {n} {s} {k}" for k in range(4)), f"site{s}") for n in range(57, 64) for s in range(n)]
    got = {(r.doc_id // 1000): r.n_removed for r in L.line_dedup(table(spark, rows), min_sites=60, lg_k=6).collect()}
    assert got == {n: int(n >= 60) for n in range(57, 64)}


def test_short_texts_under_a_long_notice(spark):
    """Every spread line goes whatever its share; of whole copies one keeps its text."""
    notice = " ".join(f"notice{k}" for k in range(30))
    rows = [(i, f"{notice}\nown text {i}", f"s{i}") for i in range(12)] + [(100 + i, f"{notice}\nsecond line", f"s{i}") for i in range(12)]
    rows += [(300, notice, "s1"), (None, f"{notice}\nsecond line", "s3"), (301, f"second line\n{notice}\n", "s2")]
    got = {r.doc_id: (r.text, r.n_chars) for r in L.drop_spread_lines(table(spark, rows)).collect()}
    want = {i: f"own text {i}" for i in range(12)} | {i: "" for i in (*range(101, 112), 300, None)} | {100: rows[12][1], 301: ""}
    assert got == {i: (t, len(t)) for i, t in want.items()}
