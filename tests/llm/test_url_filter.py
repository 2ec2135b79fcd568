import math
import random
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from tabwright.llm import url_filter as U


def shape(seg):
    import re
    n = re.sub("[0-9]+", "{n}", seg)
    return "/" + ("{x}" if re.fullmatch("[0-9a-fA-F-]{16,}", seg) else "{s}" if len(n) > 40 else n)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:at], rest[at:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(h) + len(p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def apart(x, y):
    feats = [f for f in set(x) | set(y) if x[f] + y[f] > 0]
    sx, sy, df = sum(x.values()), sum(y.values()), len(feats) - 1
    g = 2 * sum(v * math.log(v * (sx + sy) / (s * (x[f] + y[f]))) for f in feats for v, s in ((x[f], sx), (y[f], sy)) if v)
    return df > 0 and (max(g, 0) / df) ** (1 / 3) > 1 - 2 / (9 * df) + U.Z * math.sqrt(2 / (9 * df))


def plain(urls, levels=4):
    rows = []
    for u in urls:
        host, path = split(u)
        segs = [] if path == "" else [shape(s) for s in path[1:].split("/")]
        if len(segs) > levels:
            segs = [*segs[:levels - 1], "/{**}"]
        rows.append((host, path, *rule(host, path), segs + [""] * (levels - len(segs))))
    named = [[] for _ in rows]
    for i in range(levels):
        nodes = defaultdict(lambda: defaultdict(Counter))
        for (host, _, _, v, segs), g in zip(rows, named):
            after = segs[i + 1] if i + 1 < levels else ""
            nodes[host, tuple(g)][segs[i]][v or "open", 0 if after == "" else 1 if "{" in after else 2] += 1
        names = {}
        for node, branches in nodes.items():
            real = {s: f for s, f in branches.items() if s}
            n = {s: sum(f.values()) for s, f in real.items()}
            share = lambda s, v: sum(c for (x, _), c in real[s].items() if x == v) / n[s]  # noqa: B023, E731
            names[node, ""] = ""
            if len(real) > 256 or len(real) >= U.SPREAD and sum(n.values()) < U.THIN * len(real):
                names |= {(node, s): "/*" for s in real}
                continue
            islands = []
            for s in sorted(real, key=lambda s: (share(s, "block"), share(s, "allow"), s)):
                if not islands or apart(real[islands[-1][-1]], real[s]):
                    islands.append([])
                islands[-1].append(s)
            for isl in islands:
                names |= {(node, s): min(isl) + (f"~{len(isl)}" if len(isl) > 1 else "") for s in isl}
        named = [[*g, names[(r[0], tuple(g)), r[4][i]]] for r, g in zip(rows, named)]
    a, b = Counter(), Counter()
    for r, g in zip(rows, named):
        a[r[0], tuple(g)] += r[3] is not None
        b[r[0], tuple(g)] += r[3] == "block"
    purity = {k: (b[k] + 0.75) / (a[k] + 3) for k in a}
    return [(r[0], r[1], r[2], r[3] or ("block" if purity[r[0], tuple(g)] >= 0.5 else "allow"), "".join(g),
             float(Decimal(purity[r[0], tuple(g)]).quantize(Decimal("1e-6"), ROUND_HALF_UP)))
            for r, g in zip(rows, named)]


def judged(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    df = df.withColumns({c: F.lit("q") for c in ("host", "path", "rule", "_verdict", "_s", "s1", "g1", "_k1", "n", "template")})
    return [tuple(r)[1:] for r in sorted(U.judge_urls(df).collect())]


def test_against_plain_tree(spark):
    rnd = random.Random(4)
    hosts = ["a.example.com", "WWW.example.com", "x.www.example.com", "b.example.net", "net", "c.org", "fr.net", "example.com:80"]
    urls = [None, "", "no scheme", "http://", "http://net", "http://net?x=/es/", "http://c.org#t", "://NET/es/1", "ftp://a.net/fr/x://y/es", "http://c.org//"]
    for _ in range(900):
        segs = [rnd.choice(["en", "es", "fr", "de"]), *[rnd.choice([str(rnd.randint(1, 999)), "about", "news", f"p{rnd.randint(0, 5)}.html", "",
                rnd.choice("abcdefghijklmnop") + rnd.choice("qrstuvw"), "0123456789abcdef0123", "w" * 50]) for _ in range(rnd.randint(0, 5))]]
        urls.append("https://" + rnd.choice(hosts) + "/" + "/".join(segs) + rnd.choice(["", "?q=/en/", "#es"]))
    urls += urls[:50]
    assert judged(spark, urls) == plain(urls)


def test_templates_decide_where_no_rule_fits(spark):
    """Few pages in another language can't be told from the blocked ones of their host; many can."""
    urls = [f"http://small.net/es/{i}" for i in range(3)] + ["http://small.net/de/7"]
    urls += [f"http://large.net/{lang}/{i}" for i in range(200) for lang in ("es", "fr", "de")] + [f"http://free.org/en/{i}" for i in range(50)]
    got = dict(zip(urls, judged(spark, urls)))
    assert got["http://small.net/de/7"][3] == "block" and got["http://large.net/de/7"][3] == "allow"
    assert got["http://large.net/fr/7"][4] == got["http://large.net/es/7"][4] == "/es~2/{n}"
    assert {got[u][3] for u in urls if "free" in u} == {"allow"}


def test_hot_node_with_many_words_is_variable(spark):
    word = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:04d}")
    urls = [f"http://h.org/{word(k)}/x" for k in range(300) for _ in range(6)]
    assert {r[4] for r in judged(spark, urls)} == {"/*/x"}


def test_no_rows(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_no_python_in_the_plan(spark, sf):
    plan = U.judge_urls(spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
