import re

import pytest

from tabwright.llm import quality as Q

from .conftest import table, words


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_base_counts_and_verdicts(spark, rnd):
    good = [" ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words(rnd, rnd.randint(40, 200)))) for _ in range(120)]
    junk = ["%%% ".join(words(rnd, 60)) for _ in range(10)] + [" ".join(words(rnd, 60)).upper() + "." for _ in range(10)]
    odd = [None, "", " ", "\n \n", "a b c d e a b c d e", "a a a a a a a", "x\nx\n x\nx y", "é#" * 50, " ".join(["loop de loop de"] * 4000),
           "a b c d e f a b c d e g", "a\x0bb\x0cc\td"]
    rows = [(i, t, "s") for i, t in enumerate([*good, *junk, *odd])] + [(None, good[0], "s"), (3, good[3], "s")]
    got = Q.judge(table(spark, rows, extra=("kept", "n_words"))).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t, _ in rows:
        for r in by[i]:
            n = brute(t)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, t
            assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.kept and r.base_failed)
    assert len(got) == len(rows)
    kept = lambda lo, hi: sum(by[i][0].kept for i in range(lo, hi))
    assert kept(0, 120) == 120 and kept(120, 140) <= 10              # twenty cases of junk are few to learn from
    assert Q.judge(table(spark, rows).limit(0)).count() == 0


def test_em_finds_the_planted_accuracies(rnd):
    counts = {}
    for _ in range(20_000):
        y = 1 if rnd.random() < 0.8 else -1
        v = tuple(0 if rnd.random() < 0.2 else y if rnd.random() < (0.995 if y > 0 else a) else -y for a in (0.9, 0.7, 0.5, 0.8))
        counts[v] = counts.get(v, 0) + 1
    start, per = Q.learn(sorted(counts.items()))
    assert start == pytest.approx(1.386, abs=0.15)
    for (good, bad), a in zip(per, (0.9, 0.7, 0.5, 0.8)):
        assert 1 - 0.995 * 2.718281828 ** -good == pytest.approx(a, abs=0.1) and bad < 0 < good


@pytest.mark.parametrize("times", [1, 12])
def test_rejected_share_does_not_hang_on_size(spark, rnd, times):
    good = [" ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words(rnd, rnd.randint(40, 90)))) for _ in range(170 * times)]
    loops = [("LOOP OF WORDS IN CAPITALS " * 15).strip() for _ in range(20 * times)]                   # left to the base rule
    junk = [" ".join(w + ("%#" if k % 3 else ".") for k, w in enumerate(words(rnd, 50))) for _ in range(12 * times)]
    got = Q.judge(table(spark, [(i, t, "s") for i, t in enumerate([*good, *loops, *junk])])).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert kept == set(range(len(good)))
    assert sum(r.base_failed for r in got) == len(loops)


def test_no_python_on_the_executors(spark):
    plan = Q.signals(table(spark, [(1, "a", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
