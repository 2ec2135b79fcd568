"""Main text of web pages by wrapper inference: union-free regular expressions over a host's token streams.

A page's tag and text tokens form nested sequences.  Two sequences are aligned on their tags: matching elements
are aligned recursively, an element that one side lacks becomes optional, neighbouring elements of one tag fold
into a repeated group, and texts become slots: a slot keeps its text as long as all pages agree (template
text) and is a field otherwise.  The result is a wrapper, a regular expression without unions.  Every task aligns
the pages it reads, per host; the partial wrappers (a few kB each, whatever the number of pages) are then
aligned salt by salt and host by host, so no host's pages ever meet in one task.

The host's wrapper tells where the article is: the ``article``/``main`` element if the wrapper has one with text,
else the deepest element that holds most of the host's running text, with link lists and boilerplate elements
(menus, headers, footers, sidebars, notices, adverts, forms, comments, by tag, role or class) left out.
Template text inside it that stands once per page, alike on at least ``min_pages`` different pages, goes too.  Each page is
then read against that: blocks inside the region, in page order.

Null or empty html: text ''.  Pages without a readable host are one host of their own; a page that has no text in
its host's region is read by its own structure.  Unclosed elements and cut tags, comments or references
are read as browsers do; a cut reference stays as it is.  Repeated rows are extracted one by one.
"""

from __future__ import annotations

import json
import re
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var img wbr picture source".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BOILER_TAGS = frozenset("nav footer aside form script style noscript template iframe svg math button select textarea dialog head menu "
                        "canvas object audio video title datalist map".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar "
                         "navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar comment comments respond disqus reply "
                         "replies notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription "
                         "signup login share sharing social related recommended recommendations pagination pager widget widgets toolbar "
                         "search copyright feedback rating ratings".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div body main".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)>""")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")).lower() for m in _ATTR.finditer(text)} if text.strip(" /") else {}


def _key(tag: str, attr: dict[str, str], inside: bool) -> str:
    """Tag and class names without digits; '!' marks boilerplate.  ``inside``: below an article or main element."""
    names = attr.get("class", "").split()
    bad = tag in BOILER_TAGS or attr.get("role") in BOILER_ROLES or "hidden" in attr or attr.get("aria-hidden") == "true" \
        or "display:none" in attr.get("style", "").replace(" ", "")
    if tag not in ("html", "body", "article", "main"):
        for name in [*names, attr.get("id", "")]:
            parts = [p for p in re.split(r"[^a-z]+", name) if p]
            bad |= bool(parts) and "free" not in parts and (parts[0] in BOILER_WORDS or parts[-1] in BOILER_WORDS
                                                            or (not inside and (parts[0] == "header" or parts[-1] == "header")))
        bad |= tag == "header" and not inside
    label = ".".join(dict.fromkeys(re.sub(r"[0-9]+", "", n) for n in names[:4]))
    return tag + (f".{label}" if label else "") + ("=main" if tag == "main" or attr.get("role") == "main" else "") + ("!" if bad else "")


def parse(html: str) -> list:
    """The page as nested [key, children]; a text block is (text, characters in links)."""
    root: list = ["", []]
    stack: list[tuple[str, list, bool]] = [("", root, False)]      # tag, nearest block element, inside an article
    block: list[tuple[str, bool]] = []
    links = 0

    def flush():
        text = " ".join("".join(t for t, _ in block).split())
        if text:
            stack[-1][1][1].append((text, min(len(text), sum(len(t) for t, k in block if k))))
        block.clear()

    def pop(n):
        nonlocal links
        for tag, _, _ in stack[n:]:
            links -= tag == "a"
        if any(tag not in INLINE for tag, _, _ in stack[n:]):
            flush()
        del stack[n:]

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            block.append((unescape(html[at:lt]), links > 0))
        if lt == size:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        nxt = html[lt + 1:lt + 2]
        if nxt in ("!", "?"):
            end = html.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        if not (nxt.isascii() and nxt.isalpha() or nxt == "/" and html[lt + 2:lt + 3].isalpha()):
            block.append(("<", links > 0))
            at = lt + 1
            continue
        m = _TAG.match(html, lt)
        if m is None:                                              # a quote that never closes, or a cut tag
            end = html.find(">", lt)
            if end < 0:
                break
            m = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>").match(html, lt)
        at, tag = m.end(), m[2].lower()
        if m[1]:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n][0] == tag:
                    pop(n)
                    break
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            if tag != "head" and stack[-1][0] == "head" and tag not in RAW | {"noscript", "template"}:
                pop(len(stack) - 1)
            for n in range(len(stack) - 1, 0, -1):                 # an open paragraph ends where a block begins
                if stack[n][0] == "p":
                    pop(n)
                    break
                if stack[n][0] not in INLINE:
                    break
            ends = CLOSED_BY.get(tag, ())
            for n in range(len(stack) - 1, 0, -1):
                if stack[n][0] in ends:
                    pop(n)
                    break
                if stack[n][0] in SCOPE:
                    break
        if tag in RAW:                                             # its content is no markup, nor text of the page
            end = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(html, at)
            at = size if end is None else max(html.find(">", end.end()) + 1, end.end())
            continue
        if m[3].endswith("/") and tag not in INLINE:
            continue
        inside = stack[-1][2]
        if tag in INLINE:
            links += tag == "a"
            stack.append((tag, stack[-1][1], inside))
        else:
            key = _key(tag, _attributes(m[3]), inside)
            node: list = [key, []]
            stack[-1][1][1].append(node)
            stack.append((tag, node, inside or tag in ("article", "main") or "=main" in key))
    flush()
    return root


# A wrapper item: {"k": key or "" for a text slot, "o": optional, "r": repeated, "n": pages, "c": characters, "l": characters
# in links, "t": the text's hash while all pages agree, "d": the smallest hashes of different pages with the slot, "i": items}
WITNESSES = 8

def shape(node, page: int = 0) -> dict:
    """The wrapper of one page (or element); ``page``: a hash of the page, by which copies count once."""
    if isinstance(node, tuple):
        return {"k": "", "o": 0, "r": 0, "n": 1, "c": len(node[0]), "l": node[1], "t": crc32(node[0].encode("utf-8", "replace")), "d": [page], "i": []}
    return {"k": node[0], "o": 0, "r": 0, "n": 1, "c": 0, "l": 0, "t": None, "d": [], "i": _fold([shape(x, page) for x in node[1]], True)}


def _join(a: dict, b: dict, same_page: bool) -> dict:
    """Two matching items as one."""
    return {"k": a["k"], "o": a["o"] | b["o"], "r": a["r"] | b["r"] | same_page, "n": max(a["n"], b["n"]) if same_page else a["n"] + b["n"],
            "c": a["c"] + b["c"], "l": a["l"] + b["l"], "t": a["t"] if a["t"] == b["t"] and not same_page else None,
            "d": sorted({*a["d"], *b["d"]})[:WITNESSES],
            "i": _align(a["i"], b["i"], same_page)}


def _fold(items: list[dict], same_page: bool) -> list[dict]:
    """Neighbours of one key become a repeated group; so does a pair of keys that follows itself."""
    out: list[dict] = []
    for x in items:
        if out and out[-1]["k"] == x["k"]:
            out[-1] = _join(out[-1], x, True)
        elif len(out) >= 3 and out[-2]["k"] == x["k"] and out[-3]["k"] == out[-1]["k"]:
            last = out.pop()                                       # a b a + b: the group (a b)+
            out[-1] = _join(out[-1], x, True)
            out[-2] = _join(out[-2], last, True)
        else:
            out.append(x)
    return out


def _align(a: list[dict], b: list[dict], same_page: bool) -> list[dict]:
    """Longest common subsequence on keys; what one side lacks is optional."""
    if [x["k"] for x in a] == [x["k"] for x in b]:
        return _fold([_join(x, y, same_page) for x, y in zip(a, b)], same_page)
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i]["k"] == b[j]["k"] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i]["k"] == b[j]["k"]:
            out.append(_join(a[i], b[j], same_page))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append({**a[i], "o": 1})
            i += 1
        else:
            out.append({**b[j], "o": 1})
            j += 1
    return _fold(out, same_page)


def merge(a: dict, b: dict) -> dict:
    return _join(a, b, False)


def region(wrapper: dict, min_pages: int) -> dict:
    """Where the wrapper's article is: {"at": element paths, "drop": {slot path: text hash}}."""
    stats: dict[str, list[int]] = {}                               # path: running text, text in links
    slots: dict[str, list] = {}

    def walk(item, path, bad):
        path = f"{path}/{item['k']}"
        bad = bad or item["k"].endswith("!")
        own = [0, 0]
        for x in item["i"]:
            if not x["k"]:
                if not bad:
                    own[0] += x["c"]
                    own[1] += x["l"]
                    slots.setdefault(path, []).append(x)
            else:
                c, k = walk(x, path, bad)
                own[0] += c
                own[1] += k
        s = stats.setdefault(path, [0, 0])
        s[0] += own[0]
        s[1] += own[1]
        return own

    walk(wrapper, "", False)
    text = {p: c - k for p, (c, k) in stats.items()}
    last = lambda p: p.rsplit("/", 1)[1]
    named = [p for p in text if text[p] > 0 and not any(k.endswith("!") for k in p.split("/"))
             and (last(p).split(".")[0].split("=")[0] == "article" or "=main" in last(p))]
    named = [p for p in named if not any(p != q and p.startswith(q + "/") for q in named)]
    if named:
        inner = [p for p in text if any(p.startswith(q + "/") for q in named) and last(p).split(".")[0] == "article" and text[p] > 0]
        top = [p for p in inner if not any(p != q and p.startswith(q + "/") for q in inner)]
        if top and sum(text[p] for p in top) >= 0.5 * sum(text[q] for q in named):
            named = top                                            # an article inside main
        at = named
    else:
        here = next((p for p in text if last(p).split(".")[0] == "body"), "/")
        while True:
            below = [p for p in text if p.startswith(here + "/") and "/" not in p[len(here) + 1:]
                     and last(p).split(".")[0] in ("div", "section", "td", "table", "tbody", "tr", "center")]
            deepest = max(below, key=lambda p: (text[p], p), default=None)
            if deepest is None or text[deepest] < 0.7 * text[here]:
                break
            here = deepest
        at = [here]
    drop = {}
    for path, found in slots.items():
        if any(path == q or path.startswith(q + "/") for q in at) and len(found) == 1:
            x = found[0]
            if x["t"] is not None and not x["r"] and len(x["d"]) >= min_pages:
                drop[path] = x["t"]
    return {"at": sorted(at), "drop": drop}


def main_text(html: str, where: dict | None) -> str:
    """The page's blocks inside the region, joined by newlines; without text there, by the page's own structure."""
    page = parse(html)

    def blocks(node, path, inside, where):
        path = f"{path}/{node[0]}"
        if node[0].endswith("!"):
            return
        inside = inside or path in where["at"]
        for x in node[1]:
            if isinstance(x, tuple):
                if inside and not (path in where["drop"] and where["drop"][path] == crc32(x[0].encode("utf-8", "replace"))):
                    yield x[0]
            else:
                yield from blocks(x, path, inside, where)

    out = "\n".join(blocks(page, "", False, where)) if where else ""
    return out or "\n".join(blocks(page, "", False, region(shape(page), 1 << 60)))


def _host(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame, salts: int = 64) -> DataFrame:
    """(host, wrapper): one wrapper per host, as JSON."""
    def local(batches):
        from pyspark import TaskContext
        found: dict[str, dict] = {}
        for b in batches:
            for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                if html:
                    one = shape(parse(html), crc32(html.encode("utf-8", "replace")))
                    found[host] = merge(found[host], one) if host in found else one
        salt = TaskContext.get().partitionId() % salts
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([salt] * len(found), pa.int32()),
                                          pa.array([json.dumps(w) for w in found.values()], pa.string())], ["host", "salt", "wrapper"])

    def combine(pdf):
        import pandas as pd
        one = None
        for w in sorted(pdf.wrapper):                              # a fixed order, however the rows arrived
            one = json.loads(w) if one is None else merge(one, json.loads(w))
        return pd.DataFrame({"host": pdf.host.iloc[:1], "wrapper": [json.dumps(one)]})

    part = pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(
        local, "host string, salt int, wrapper string")
    return (part.groupBy("host", "salt").applyInPandas(combine, "host string, wrapper string")
            .groupBy("host").applyInPandas(combine, "host string, wrapper string"))


def extract_main_text(pages: DataFrame, min_pages: int = 5, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    if min_pages > WITNESSES:
        raise ValueError(f"min_pages is at most {WITNESSES}")
    from tabwright.session import cut_lineage

    def decide(batches):
        for b in batches:
            where = [json.dumps(region(json.loads(w), min_pages)) for w in b.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(where, pa.string())], ["host", "where"])

    regions = cut_lineage(infer_wrappers(pages).mapInArrow(decide, "host string, where string"))
    size = regions.agg(F.sum(F.length("where") + F.length("host"))).first()[0] or 0
    if size <= broadcast_bytes:                                    # measured; beyond it a join that splits hot hosts
        regions = F.broadcast(regions)

    def read(batches):
        known: dict[str, dict] = {}
        for b in batches:
            text = []
            for html, where in zip(b.column("html").to_pylist(), b.column("where").to_pylist()):
                if where is not None and where not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[where] = json.loads(where)
                text.append(main_text(html, known.get(where)) if html else "")
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()),
                                              pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), _host(F.col("url")).alias("host"),
                        F.col("html").cast("string").alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.join(regions, "host", "left").select("page_id", "url", "html", "where").mapInArrow(
        read, f"page_id {kind}, url string, text string, n_chars long")
