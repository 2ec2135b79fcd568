"""Personal data: fixed patterns, and words whose corpus co-occurrence gives a protected value away.

Base spans (leftmost, not overlapping, per kind): e-mail, IP address, card number (Luhn), phone number.  A
protected entity is one such value.  Information-theoretic sanitisation asks how much a word tells about an
entity: with document counts over the corpus, PMI(word; entity) = log2(N·n(word, entity) / (n(word)·n(entity)))
against the entity's information content IC = log2(N / n(entity)).  A word that stands in a document with the
entity, at any distance, discloses it if PMI ≥ alpha·IC; alpha 1 would mean that the word never stands anywhere
else.  The evidence must come from at least ``support`` different texts, so that copies of one text disclose
nothing.  All occurrences of a disclosing word in a document with the entity, outside base spans, become spans of
kind ``term``; sanitising puts a kind's name in place of a base span and removes the terms.

n(entity) is counted first; only entities that have the support go on.  n(word, entity) comes from whole documents
with such an entity, summed by (entity, word) inside each task with at most ``support`` texts a pair, which decide
the support as well as all would.  n(word) is counted over every document, but only for words of pairs that the
count inside those documents has not ruled out.  Entities, words and disclosing pairs are sent to the tasks
``chunk`` at a time, with as many passes as that takes.

Null or empty text: no spans, base_sha256 of the empty string.  Null ids are kept.  Repeated rows get equal
answers; rows are told apart by (doc_id, text).  Positions count code points.  Words are runs of Unicode letters
and digits in every count.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm import textnum as tn

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run is never entered in its middle: a match always takes the whole run, so the look-behind changes nothing
# but the time spent on long runs.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")


def _emails(t: str):
    at, done = t.find("@"), 0
    while at >= 0:
        a = at
        while a > done and t[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(t, at + 1) if a < at else None
        if m:
            yield a, m.end()
            done = m.end()
        at = t.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches, sorted."""
    out = [(a, 0, b) for a, b in _emails(t)]
    if "." in t:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(t)
                if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 12:
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in t:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(t) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _entity(t: str, a: int, k: int, b: int) -> str:
    return f"{KINDS[k]}:" + (t[a:b].lower() if k == 0 else t[a:b] if k == 1 else re.sub(r"\D", "", t[a:b]))


def _hash64(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _words(t: str, spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes (lower-case A-Z, as in the corpus count) of the words outside the base spans."""
    at = np.array([m.span() for m in _WORD.finditer(t)], np.int64).reshape(-1, 2)
    start, end = at[:, 0], at[:, 1]
    free = np.ones(len(at), bool)
    for a, _, b in spans:
        free[np.searchsorted(end, a, "right"):np.searchsorted(start, b, "left")] = False
    start, end = start[free], end[free]
    buf = tn.LOWER[np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)]
    byte = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))                    # where each code point begins
    return start, end, tn.substring_hash(tn.prefix_sums(buf), byte[start], byte[end])


def _entity_docs(column: pa.Array, wanted: np.ndarray | None = None):
    """(row, text, base spans, sorted entity hashes) of the rows with an entity, or one of the sorted ``wanted``."""
    for r, t in enumerate(column.to_pylist()):
        spans = base_spans(t) if t else ()
        if spans:
            ent = np.unique(np.array([_hash64(_entity(t, *s)) for s in spans], np.int64))
            if wanted is not None:
                ent = ent[np.isin(ent, wanted)]
            if len(ent):
                yield r, t, spans, ent


@functools.cache
def _alnum() -> np.ndarray:
    """Per code point whether it belongs to a word, by the rule of _WORD."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def _letters(buf: np.ndarray) -> np.ndarray:
    """Per byte of UTF-8 text whether its character belongs to a word."""
    if not len(buf) or buf.max() < 128:
        return tn.ALNUM[buf]
    begin = np.flatnonzero((buf & 0xC0) != 0x80)
    points = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.repeat(_alnum()[points], np.diff(np.append(begin, len(buf))))


def _parts(df: DataFrame, column: str, chunk: int):
    """The rows of ``df`` as arrays, dealt by ``column`` into parts of about ``chunk`` rows."""
    parts = max(1, -(-df.count() // chunk))
    for p in range(parts):
        yield df.where(F.pmod(F.xxhash64(column), F.lit(parts)) == p).toPandas()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def entity_counts(docs: DataFrame, support: int) -> DataFrame:
    """(entity, n_e) of the entities in at least ``support`` different texts."""
    def run(batches):
        for b in batches:
            ent, text = [], []
            for r, _, _, e in _entity_docs(b.column("t")):
                ent.append(e), text.append(np.full(len(e), b.column("x")[r].as_py(), np.int64))
            if ent:
                got, n = np.unique(np.stack([np.concatenate(ent), np.concatenate(text)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1]), pa.array(n)], ["entity", "text", "n"])
    return (_keyed(docs).select(F.xxhash64("t").alias("x"), "t").mapInArrow(run, "entity long, text long, n long")
            .groupBy("entity", "text").agg(F.sum("n").alias("n"))
            .groupBy("entity").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support)
            .select("entity", "n_e"))


def _summed(ent, term, text, n, support: int):
    """Rows (entity, term, text, n) summed by pair: at most ``support`` texts of each stay, the first with the sum."""
    order = np.lexsort((text, term, ent))
    ent, term, text, n = ent[order], term[order], text[order], n[order]
    pair = np.append(True, (ent[1:] != ent[:-1]) | (term[1:] != term[:-1]))
    first = np.flatnonzero(pair)
    new = pair | np.append(True, text[1:] != text[:-1])
    rank = np.cumsum(new)
    keep = new & (rank - rank[first][np.cumsum(pair) - 1] < support)
    total = np.zeros(len(ent), np.int64)
    total[first] = np.add.reduceat(n, first)
    return ent[keep], term[keep], text[keep], total[keep]


def pair_counts(docs: DataFrame, entities: DataFrame, support: int, chunk: int, buffer: int = 1 << 20) -> DataFrame:
    """(pass, entity, term, n_te, texts) over whole documents; entity null: the documents with any entity of the pass."""
    def counted(ids):
        bc = docs.sparkSession.sparkContext.broadcast(np.sort(ids))

        def run(batches):
            held, size = [], 0

            def out():
                e, w, x, n = _summed(*map(np.concatenate, zip(*held)), support)
                return pa.RecordBatch.from_arrays([pa.array(e, mask=e == 0), pa.array(w), pa.array(x), pa.array(n)], ["entity", "term", "text", "n"])

            for b in batches:
                for r, t, spans, ent in _entity_docs(b.column("t"), bc.value):
                    term, x = np.unique(_words(t, spans)[2].view(np.int64)), b.column("x")[r].as_py()
                    for e in (0, *ent):
                        held.append((np.full(len(term), e, np.int64), term, np.full(len(term), x, np.int64), np.ones(len(term), np.int64)))
                        size += len(term)
                        if size >= buffer:
                            held, size = [_summed(*map(np.concatenate, zip(*held)), support)], 0
                            if len(held[0][0]) >= buffer // 2:
                                yield out()
                                held = []
            if held and sum(len(h[0]) for h in held):
                yield out()
        return _keyed(docs).select(F.xxhash64("t").alias("x"), "t").mapInArrow(run, "entity long, term long, text long, n long")

    got = _union([counted(part.entity.to_numpy(np.int64)).withColumn("pass", F.lit(k))
                  for k, part in enumerate(_parts(entities, "entity", chunk))])
    return (got.groupBy("pass", "entity", "term", "text").agg(F.sum("n").alias("n"))
            .groupBy("pass", "entity", "term").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("texts")))


def _keyed(docs: DataFrame) -> DataFrame:
    t = F.col("text").cast("string")
    return docs.select("doc_id", t.alias("t"), F.xxhash64(F.lit(1), "doc_id", t).alias("k1"), F.xxhash64(F.lit(2), "doc_id", t).alias("k2"))


def _term_counts(docs: DataFrame, terms: DataFrame, chunk: int) -> DataFrame:
    """(term, n): documents with the term, over all documents; ``chunk`` terms are broadcast per pass."""
    out = []
    for got in _parts(terms, "term", chunk):
        bc = docs.sparkSession.sparkContext.broadcast(np.sort(got.term.to_numpy(np.int64).view(np.uint64)))

        def run(batches, bc=bc):
            want = bc.value
            for b in batches:
                n = np.zeros(len(want), np.int64)
                for lo, hi, buf, off in tn.text_blocks(b.column("t")):
                    low = tn.LOWER[buf]
                    start, end, first = tn.spans(_letters(low), off)
                    if not len(start) or not len(want):
                        continue
                    h = tn.substring_hash(tn.prefix_sums(low), start, end)
                    at = np.minimum(np.searchsorted(want, h), len(want) - 1)
                    hit = np.flatnonzero(want[at] == h)
                    row = np.searchsorted(first, hit, "right") - 1
                    n += np.bincount(np.unique(row * len(want) + at[hit]) % len(want), minlength=len(want))
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([tn.i64(want[k]), pa.array(n[k])], ["term", "n"])

        out.append(docs.select(F.col("text").cast("string").alias("t")).mapInArrow(run, "term long, n long"))
    return _union(out).groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, support: int, alpha: float, chunk: int) -> DataFrame:
    """(entity, term) pairs whose co-occurrence exceeds the disclosure threshold."""
    from tabwright.session import cut_lineage
    n_e = cut_lineage(entity_counts(docs, support))
    total = F.lit(float(docs.count()))

    def exceeds(n):
        return F.log2(total * F.col("n_te") / (F.col(n) * F.col("n_e"))) >= alpha * F.log2(total / F.col("n_e"))

    pairs = cut_lineage(pair_counts(docs, n_e, support, chunk))
    # A word stands in at least as many documents as it does in those with an entity.
    least = pairs.where("entity IS NULL").groupBy("term").agg(F.max("n_te").alias("least"))
    pair = cut_lineage(pairs.where(F.col("entity").isNotNull() & (F.col("texts") >= support)).join(n_e, "entity").join(least, "term")
                       .where(exceeds("least")).drop("pass", "least"))
    n_t = _term_counts(docs, pair.select("term").distinct(), chunk)
    return pair.join(n_t, "term").where(exceeds("n")).select("entity", "term")


def term_spans(docs: DataFrame, pairs: DataFrame, chunk: int) -> DataFrame:
    """k1, k2 (the row), terms: first and end of every occurrence of a word that discloses an entity of the document."""
    def marked(pdf):
        pdf = pdf.sort_values(["entity", "term"])
        ent, first = np.unique(pdf.entity.to_numpy(np.int64), return_index=True)
        bc = docs.sparkSession.sparkContext.broadcast((ent, np.append(first, len(pdf)), pdf.term.to_numpy(np.int64)))

        def run(batches):
            ids, first, terms = bc.value
            for b in batches:
                row, spans = [], []
                for r, t, base, ent in _entity_docs(b.column("t"), ids):
                    start, end, word = _words(t, base)
                    at = np.searchsorted(ids, ent)
                    hit = np.isin(word.view(np.int64), np.concatenate([terms[first[i]:first[i + 1]] for i in at]))
                    if hit.any():
                        row.append(r), spans.append([{"first": a, "end": z} for a, z in zip(start[hit].tolist(), end[hit].tolist())])
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("k1").take(at), b.column("k2").take(at), pa.array(
                    spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))], ["k1", "k2", "terms"])
        return _keyed(docs).select("k1", "k2", "t").mapInArrow(run, "k1 long, k2 long, terms array<struct<first:int,end:int>>")

    return (_union([marked(part) for part in _parts(pairs, "entity", chunk)]).groupBy("k1", "k2")
            .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("terms")))


def find_personal_data(docs: DataFrame, support: int = 3, alpha: float = 0.9, chunk: int = 200_000,
                       broadcast_spans: int = 500_000) -> DataFrame:
    """Per row: doc_id, counts by kind, base_sha256, spans (base and term) and the sanitised text."""
    from tabwright.session import cut_lineage
    extra = cut_lineage(term_spans(docs, cut_lineage(disclosing(docs, support, alpha, chunk)), chunk))
    if (extra.agg(F.sum(F.size("terms") + 1)).first()[0] or 0) <= broadcast_spans:        # counted; beyond that a shuffle join
        extra = F.broadcast(extra)

    def run(batches):
        for b in batches:
            counts, sha, spans, clean = [], [], [], []
            for t, terms in zip(b.column("t").to_pylist(), b.column("terms").to_pylist()):
                base = base_spans(t or "")
                both = sorted(base + [(x["first"], 4, x["end"]) for x in terms or ()])
                counts.append([sum(k == i for _, k, _ in both) for i in range(5)])
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(both))
                clean.append(None if t is None else sanitise(t, both))
            cols = list(zip(*counts)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols), pa.array(sha, pa.string()),
                                              pa.array(spans, pa.string()), pa.array(clean, pa.string())],
                                             ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "sanitised"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (_keyed(docs).join(extra, ["k1", "k2"], "left").select("doc_id", "t", "terms")
            .mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, sanitised string"))


def sanitise(t: str, spans) -> str:
    """Base spans become their kind in angle brackets, terms go; where spans overlap the first wins."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a < at:
            at = max(at, b)
            continue
        out += [t[at:a], "" if k == 4 else f"<{KINDS[k]}>"]
        at = b
    return "".join([*out, t[at:]])
