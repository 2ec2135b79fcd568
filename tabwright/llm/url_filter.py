"""URL filter: rules where one fits, else the labelled purity of the url's path template.

A path-template tree per host, in DataFrame functions only:

1. Rules (host, path, verdict) label the urls they fit: the rule's host or a subdomain of it, and a path that starts with
   the rule's; the longest host + path wins.
2. Each path becomes ``levels`` segments with their lexical variation taken out (digits are ``{n}``, long hexadecimal
   names ``{x}``, segments over 40 characters ``{s}``; what lies deeper is ``{**}``).  From here on the work is done on
   (host, segments, labels) counts, combined before any shuffle.
3. The tree grows level by level.  A node whose segment takes more than ``max_literals`` values, or many values of few
   urls each, is variable: its branches become the wildcard ``*``.  Elsewhere the branches of a node are put in order of
   their label shares and neighbours that a G-test can't tell apart (labels by kind of the next segment) become one branch.
4. A template (the path of generalised segments) is rejected when (blocked + prior·weight) / (labelled + weight) reaches
   ``threshold``.  Templates without labels keep the prior and are allowed.

Null urls and urls without ``://`` have an empty host and path; they form a host of their own, no rule fits them.  An
empty path is a template of its own.  Repeated rows count as often as they stand there.  Other columns are not read,
whatever their names.  A table without rows gives a table without rows.  A host with a third of all urls is one row per
distinct path shape before it is shuffled; its urls are only ever joined to the templates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (host, path, verdict) of the registered query; fixed values.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 100_000                     # templates (two hashes, a verdict, a name) that may be broadcast

SPREAD, THIN = 8, 4                          # a node of so many branches with fewer urls each than that is variable
Z = 2.326                                    # 1 % point of the normal: few urls don't tell branches apart


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):          # later ones overwrite
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def segments(path: Column, levels: int) -> Column:
    """``levels`` segments of a path: '/' and its lexical shape each, '' where the path has ended."""
    def shape(s):
        n = F.regexp_replace(s, "[0-9]+", "{n}")
        return F.concat(F.lit("/"), F.when(s.rlike("^[0-9a-fA-F-]{16,}$"), "{x}").when(F.length(n) > 40, "{s}").otherwise(n))
    raw = F.split(F.substr(path, F.lit(2)), "/", -1)
    own = F.transform(F.slice(raw, 1, levels), shape)
    own = F.when(F.size(raw) > levels, F.concat(F.slice(own, 1, levels - 1), F.array(F.lit("/{**}")))).otherwise(own)
    own = F.when(path == "", F.array().cast("array<string>")).otherwise(own)
    return F.concat(own, F.array_repeat(F.lit(""), F.greatest(F.lit(levels) - F.size(own), F.lit(0))))


def _apart(x: list[Column], y: list[Column]) -> Column:
    """Whether two rows of counts differ by a G-test at 1 % (Wilson–Hilferty's normal form of the chi-square)."""
    sx, sy = reduce(lambda a, b: a + b, x), reduce(lambda a, b: a + b, y)
    total = sx + sy
    term = lambda v, s, both: F.when(v > 0, v * F.log(v * total / (s * both))).otherwise(0.0)
    g = 2 * reduce(lambda a, b: a + b, [term(a, sx, a + b) + term(b, sy, a + b) for a, b in zip(x, y)])
    df = reduce(lambda a, b: a + b, [F.when(a + b > 0, 1).otherwise(0) for a, b in zip(x, y)]) - 1
    part = 2.0 / (9.0 * df)
    return (df > 0) & (F.pow(F.greatest(g, F.lit(0.0)) / df, F.lit(1.0 / 3.0)) > 1 - part + Z * F.sqrt(part))


def grow(shapes: DataFrame, levels: int, max_literals: int) -> DataFrame:
    """``shapes`` (host, s1.., allow, block, open) with the generalised segments g1.. of each row."""
    from tabwright.session import cut_lineage
    for i in range(1, levels + 1):
        node, s = ["host", *[f"g{j}" for j in range(1, i)]], f"s{i}"
        after = F.col(f"s{i + 1}") if i < levels else F.lit("")
        kind = F.when(after == "", 0).when(after.contains("{"), 1).otherwise(2)
        names = [f"f{k}{c}" for k in range(3) for c in "abo"]
        counts = [F.sum(F.when(kind == k, F.col(c)).otherwise(0)).alias(f"f{k}{c[0]}") for k in range(3) for c in ("allow", "block", "open")]
        branch = cut_lineage(shapes.groupBy(*node, s).agg(*counts, F.sum(F.col("allow") + F.col("block") + F.col("open")).alias("n")))
        wide = (branch.where(F.col(s) != "").groupBy(*node).agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("urls"))
                .select(*node, ((F.col("values") > max_literals) | ((F.col("values") >= SPREAD) & (F.col("urls") < THIN * F.col("values"))))
                        .alias("variable")))
        branch = branch.join(cut_lineage(wide), node, "left")
        blocked = reduce(lambda a, b: a + b, [F.col(f"f{k}b") for k in range(3)]) / F.col("n")
        allowed = reduce(lambda a, b: a + b, [F.col(f"f{k}a") for k in range(3)]) / F.col("n")
        order = Window.partitionBy(*node).orderBy(blocked, allowed, s)
        literal = branch.where(~F.col("variable") & (F.col(s) != ""))                 # at most max_literals rows a node
        cut = _apart([F.col(c).cast("double") for c in names], [F.coalesce(F.lag(c).over(order), F.lit(0)).cast("double") for c in names])
        island = (literal.withColumn("cut", (F.coalesce(cut, F.lit(False)) | F.lag("n").over(order).isNull()).cast("int"))
                  .withColumn("island", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0))))
        mates = Window.partitionBy(*node, "island")
        name = F.concat(F.min(s).over(mates), F.when(F.count(F.lit(1)).over(mates) > 1, F.concat(F.lit("~"), F.count(F.lit(1)).over(mates)))
                        .otherwise(""))
        merged = island.select(*node, s, name.alias(f"g{i}"))
        rest = branch.where(F.coalesce(F.col("variable"), F.lit(False)) | (F.col(s) == ""))
        rest = rest.select(*node, s, F.when(F.col(s) == "", "").otherwise("/*").alias(f"g{i}"))
        shapes = cut_lineage(shapes.join(cut_lineage(merged.unionAll(rest)), [*node, s]))
    return shapes


def judge_urls(pages: DataFrame, rules=RULES, url_col: str = "url", keep=("page_id",), levels: int = 4, max_literals: int = 256,
               prior: float = 0.25, weight: float = 3.0, threshold: float = 0.5) -> DataFrame:
    """The ``keep`` columns, host, path, rule, verdict, and the template and its purity (share of blocks, smoothed)."""
    from tabwright.session import cut_lineage
    host, path = parts(pages[url_col].cast("string"))
    urls = pages.select(*[pages[c] for c in keep], host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "_verdict": verdict, "_s": segments(F.col("path"), levels)})
    state = lambda c: F.count(F.when(c, 1))
    shapes = (urls.groupBy("host", "_s").agg(state(F.col("_verdict") == "allow").alias("allow"), state(F.col("_verdict") == "block").alias("block"),
                                             state(F.col("_verdict").isNull()).alias("open"))
              .select("host", *[F.get("_s", F.lit(i)).alias(f"s{i + 1}") for i in range(levels)], "allow", "block", "open"))
    shapes = grow(cut_lineage(shapes), levels, max_literals)
    path_of = [f"g{i}" for i in range(1, levels + 1)]
    labelled = F.sum(F.col("allow") + F.col("block"))
    purity = ((F.sum("block") + prior * weight) / (labelled + weight)).alias("purity")
    template = shapes.groupBy("host", *path_of).agg(purity)
    key = lambda *c: [F.xxhash64(F.lit(k), *c).alias(f"_k{k}") for k in (1, 2)]
    found = shapes.join(cut_lineage(template), ["host", *path_of]).select(
        *key("host", F.array(*[f"s{i}" for i in range(1, levels + 1)])), F.concat(*path_of).alias("template"), "purity")
    found = cut_lineage(found)                                     # one row per host and path shape
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    urls = urls.select("*", *key("host", "_s")).join(found, ["_k1", "_k2"], "left")
    told = F.coalesce("_verdict", F.when(F.col("purity") >= threshold, "block").otherwise("allow"))
    return urls.select(*keep, "host", "path", "rule", told.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def _oracle(levels: int = 4, max_literals: int = 256, prior: float = 0.25, weight: float = 3.0, threshold: float = 0.5) -> str:
    """The same tree in SQL, a few expressions a level."""
    ranked = sorted(RULES, key=lambda r: (-len(r[0]) - len(r[1]), r))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p if what == 'rule' else v}'" for h, p, v in ranked) + " END"
    shape = ("'/' || CASE WHEN regexp_matches(s, '^[0-9a-fA-F-]{16,}$') THEN '{x}' WHEN length(regexp_replace(s, '[0-9]+', '{n}', 'g')) > 40 "
             "THEN '{s}' ELSE regexp_replace(s, '[0-9]+', '{n}', 'g') END")
    seg = "[" + ", ".join(
        f"CASE WHEN path = '' OR len(raw) < {i} THEN ''" + (f" WHEN len(raw) > {levels} THEN '/{{**}}'" if i == levels else "")
        + f" ELSE list_transform([raw[{i}]], lambda s: {shape})[1] END" for i in range(1, levels + 1)) + "]"
    sql = rf"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
ruled AS (SELECT *, {case('rule')} AS rule, {case('verdict')} AS told, string_split(substr(path, 2), '/') AS raw FROM split),
urls AS (SELECT page_id, host, path, rule, told, {seg} AS s FROM ruled),
t0 AS (SELECT host, {', '.join(f's[{i}] AS s{i}' for i in range(1, levels + 1))}, count(*) FILTER (told = 'allow') AS allow,
              count(*) FILTER (told = 'block') AS block, count(*) FILTER (told IS NULL) AS open FROM urls GROUP BY ALL)"""
    names = [f"f{k}{c}" for k in range(3) for c in "abo"]
    for i in range(1, levels + 1):
        node, after = ", ".join(["host", *[f"g{j}" for j in range(1, i)]]), f"s{i + 1}" if i < levels else "''"
        kind = f"(CASE WHEN {after} = '' THEN 0 WHEN contains({after}, '{{') THEN 1 ELSE 2 END)"
        counts = ", ".join(f"coalesce(sum({c}) FILTER ({kind} = {k}), 0)::DOUBLE AS f{k}{c[0]}" for k in range(3) for c in ("allow", "block", "open"))
        x, y = "(" + "+".join(names) + ")", "(" + "+".join("p" + c for c in names) + ")"
        term = lambda v, s, a, b: f"CASE WHEN {v} > 0 THEN {v} * ln({v} * ({x} + {y}) / ({s} * ({a} + {b}))) ELSE 0 END"  # noqa: E731, B023
        g = " + ".join(f"{term(c, x, c, 'p' + c)} + {term('p' + c, y, c, 'p' + c)}" for c in names)
        df = " + ".join(f"({c} + p{c} > 0)::INT" for c in names) + " - 1"
        sql += f""",
b{i} AS (SELECT {node}, s{i}, {counts}, sum(allow + block + open) AS n FROM t{i - 1} GROUP BY ALL),
w{i} AS (SELECT *, count(*) FILTER (s{i} <> '') OVER (PARTITION BY {node}) AS vals, sum(n) FILTER (s{i} <> '') OVER (PARTITION BY {node}) AS urls FROM b{i}),
v{i} AS (SELECT *, vals > {max_literals} OR (vals >= {SPREAD} AND urls < {THIN} * vals) AS variable FROM w{i}),
l{i} AS (SELECT *, {', '.join(f'coalesce(lag({c}) OVER o, 0) AS p{c}' for c in names)}, lag(n) OVER o AS before,
                (f0b + f1b + f2b) / n AS blocked, (f0a + f1a + f2a) / n AS allowed
         FROM v{i} WHERE NOT variable AND s{i} <> '' WINDOW o AS (PARTITION BY {node} ORDER BY (f0b + f1b + f2b) / n, (f0a + f1a + f2a) / n, s{i})),
d{i} AS (SELECT *, 2 * ({g}) AS g, {df} AS df FROM l{i}),
c{i} AS (SELECT *, CASE WHEN before IS NULL OR (df > 0 AND pow(greatest(g, 0) / greatest(df, 1), 1.0 / 3) > 1 - 2.0 / (9 * greatest(df, 1))
                                                                 + {Z} * sqrt(2.0 / (9 * greatest(df, 1)))) THEN 1 ELSE 0 END AS cut FROM d{i}),
i{i} AS (SELECT *, sum(cut) OVER (PARTITION BY {node} ORDER BY blocked, allowed, s{i} ROWS UNBOUNDED PRECEDING) AS island FROM c{i}),
m{i} AS (SELECT {node}, s{i}, min(s{i}) OVER k || CASE WHEN count(*) OVER k > 1 THEN '~' || count(*) OVER k ELSE '' END AS g{i}
         FROM i{i} WINDOW k AS (PARTITION BY {node}, island)
         UNION ALL SELECT {node}, s{i}, CASE WHEN s{i} = '' THEN '' ELSE '/*' END FROM v{i} WHERE variable OR s{i} = ''),
t{i} AS (SELECT * FROM t{i - 1} JOIN m{i} USING ({node}, s{i}))"""
    path = ", ".join(f"g{i}" for i in range(1, levels + 1))
    return sql + f""",
pure AS (SELECT host, {path}, (sum(block) + {prior * weight}) / (sum(allow + block) + {weight}) AS purity FROM t{levels} GROUP BY ALL),
told AS (SELECT host, [{', '.join(f's{i}' for i in range(1, levels + 1))}] AS s, concat({path}) AS template, purity FROM t{levels} JOIN pure USING (host, {path}))
SELECT page_id, host, path, rule, coalesce(u.told, CASE WHEN purity >= {threshold} THEN 'block' ELSE 'allow' END) AS verdict, template,
       round(purity, 6) AS purity
FROM urls u LEFT JOIN told t USING (host, s)
"""


ORACLE = _oracle()
