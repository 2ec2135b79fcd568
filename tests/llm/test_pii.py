import hashlib
import math
import re

from tabwright.llm import pii as P

from .conftest import table, words


def brute(t):
    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                           r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, t):
            d = re.sub(r"[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(d) <= 19 and P.luhn(d)) \
                    or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_against_plain_regular_expressions(rnd):
    pieces = ["a", "@", ".", "b-c", "x%y", "1", "23", "255", "256", "+", " ", "-", "(", ")", "é", "4111111111111111", "1.2.3.4", "m@n.o", "@@", "..",
              "+1 (555) 123-4567", "4111-1111 1111 1111", "\n", "0", "٣"]
    for _ in range(4000):
        t = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14)))
        assert P.base_spans(t) == brute(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@a" * 100_000, "+1 " * 50_000, "a@" * 100_000):
        P.base_spans(t)


def test_words_that_give_an_entity_away(spark, rnd):
    mail = "jane.roe@mail.example.org"
    rows = [(i, " ".join(words(rnd, 40)), "s") for i in range(60)]
    rows += [(100 + i, " ".join(words(rnd, 20)) + f" zorblax {mail} the " + " ".join(words(rnd, 20)), "s") for i in range(4)]
    rows += [(200 + i, "the " + " ".join(words(rnd, 20)), "s") for i in range(60)]
    rows += [(300, f"copy quux {mail.replace('roe', 'doe')}", "s")] * 5 + [(400, None, None), (401, "", "s"), (None, "card 4111 1111 1111 1111!", "s")]
    got = P.find_personal_data(table(spark, rows, extra=("t", "terms"))).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next(t for i, t, _ in rows if i == r.doc_id)
        base = P.base_spans(t or "")
        assert r.base_sha256 == hashlib.sha256(P.joined(base).encode()).hexdigest()
        extra = [s for s in r.spans.split(",") if s.startswith("term")]
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == [s for s in P.joined(base).split(",") if s]
        named = [t[int(s.split(":")[1]):int(s.split(":")[2])] for s in extra]
        if 100 <= (r.doc_id or 0) < 104:
            assert "zorblax" in named and "the" not in named
            assert "zorblax" not in r.sanitised and mail not in r.sanitised and "<email>" in r.sanitised
        else:
            assert not named                                   # copies of one text are no evidence
        assert (r.sanitised is None) == (t is None)
    assert P.find_personal_data(table(spark, rows).limit(0)).count() == 0


def brute_terms(rows, support=3, alpha=0.9):
    """Term spans of each row by plain counting over whole documents."""
    seen, n_t, n_e, pair = [], {}, {}, {}
    for _, t, _ in rows:
        base = P.base_spans(t or "")
        ent = {P._entity(t, *s) for s in base}
        found = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t or "")]
        free = [w for w in found if all(w[1] <= a or w[0] >= b for a, _, b in base)]
        seen.append((ent, free))
        for w in {w[2] for w in found}:
            n_t[w] = n_t.get(w, 0) + 1
        for e in ent:
            n_e[e] = n_e.get(e, 0) + 1
            for w in {w[2] for w in free}:
                pair.setdefault((e, w), []).append(t)
    bad = {(e, w) for (e, w), ts in pair.items() if len(set(ts)) >= support
           and math.log2(len(rows) * len(ts) / (n_t[w] * n_e[e])) >= alpha * math.log2(len(rows) / n_e[e])}
    return [[(a, z) for a, z, w in free if any((e, w) in bad for e in ent)] for ent, free in seen], bad


def check_terms(spark, rows, **options):
    want, bad = brute_terms(rows)
    got = {r.doc_id: r.spans for r in P.find_personal_data(table(spark, rows), **options).collect()}
    for (i, _, _), spans in zip(rows, want):
        assert [s for s in got[i].split(",") if s.startswith("term")] == [f"term:{a}:{z}" for a, z in spans], i
    return {w for _, w in bad}


def entity_texts(rnd, seps):
    """Letters whose head and foot name the same person, some words near, some far from the e-mail."""
    join = lambda ws: "".join(w + rnd.choice(seps) for w in ws)
    rows = []
    for k in range(6):
        for i in range(4):
            far = join(words(rnd, rnd.randint(15, 40)))
            rows.append((10 * k + i, join([f"Name{k}", *words(rnd, 3)]) + far + join([f"p{k}@x.org", f"4111 1111 1111 1111", f"near{k}"]) + far
                         + join([f"street{k}", "regards", f"NEAR{k}"]), "s"))
    rows += [(100 + i, join([*words(rnd, 40), "regards", f"near{i % 2}"]), "s") for i in range(80)]
    return rows + [(900 + i, rows[0][1], "s") for i in range(3)]


def test_words_at_any_distance(spark, rnd):
    rows = entity_texts(rnd, [" "])
    for chunk in (200_000, 3):
        found = check_terms(spark, rows, chunk=chunk)
        assert {"name3", "street3", "near3"} <= found and not {"regards", "near0"} & found


def test_pairs_are_summed_in_any_order(rnd):
    import numpy as np
    rows = np.array([[rnd.randrange(3), rnd.randrange(4), rnd.randrange(6)] for _ in range(500)])
    e, w, x, n = P._summed(*rows.T, np.ones(500, np.int64), 3)
    for a in range(3):
        for b in range(4):
            of = rows[(rows[:, 0] == a) & (rows[:, 1] == b)]
            assert n[(e == a) & (w == b)].sum() == len(of) and ((e == a) & (w == b)).sum() == min(3, len(set(of[:, 2])))


def test_words_between_unicode_punctuation(spark, rnd):
    """Quotes, dashes, no-break spaces and CJK punctuation part words in the corpus count too."""
    seps = [" \u201c", "\u201d ", "\u2014", "\u00a0", "\u3001", "\u3002", "\u300c", "_", " \u00e9t\u00e9 ", "\u6771\u4eac\u3000"]
    rows = entity_texts(rnd, seps)
    found = check_terms(spark, rows)
    assert {"name3", "street3", "near3"} <= found and not {"regards", "near0"} & found


def test_one_rule_for_words():
    import numpy as np
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    member = np.frombuffer("".join("1" if P._WORD.match(c) else "0" for c in text).encode(), np.uint8) == 49
    buf = np.frombuffer(text.encode(), np.uint8)
    assert (P._letters(buf)[(buf & 0xC0) != 0x80] == member).all() and (P._letters(buf[:128]) == member[:128]).all()
