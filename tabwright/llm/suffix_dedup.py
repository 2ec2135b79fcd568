"""Exact-substring dedup: sampled suffixes sorted externally, common prefixes carried, the rest induced.

A byte goes if a string of ``length`` (400) bytes that covers it also starts anywhere else.  Sorting every suffix
of the table is not needed for that: as in induced sorting, a sample of suffixes is sorted and what holds for the
others follows from the next sampled one.

* Sample: in every window of ``gap`` (128) positions the position of the smallest 16-byte hash.  A repeated string's
  first ``gap`` positions hold a sampled one, at the same place in every copy, because the choice only looks at
  bytes inside the string.
* Naming: sampled suffixes are named by the hash of their first length − gap bytes; those with a name of their own
  start no repeat and go at once.  The others are named again by their ``gap`` bytes to the left, ``length + gap``
  to the right; equal names are repeats on both sides and one of them represents the rest.
* Sorting: the representatives' tuples (name, bytes to the left, reversed, or to the right) go through one external
  sort: range partitions, each sorted by Spark with spills to disk, every hot name spread over partitions by its
  bytes.  A single pass over each sorted partition carries the longest common prefix with either neighbour, which
  is the longest with any suffix of that name; the ends of neighbouring partitions (two rows each) are compared
  on the driver.  The name fixes the first bytes, so the recursion ends at a known depth of length + gap bytes.
* Induction: a sampled suffix at a that shares ``length`` bytes to the right with others repeats from a − L to
  a + length + R, L and R being its longest common extensions.  The strings whose copies end before that, between
  ``length`` − gap and ``length`` bytes right of a, are few: where a and its neighbours allow one and it isn't
  covered yet, every sample of that name gives the hashes of the strings that start at most ``gap`` before it.

Texts are compared by 64-bit hashes of whole byte strings; nothing is cut, capped or sampled away.  Null or empty
text: 0 bytes, nothing removed.  Rows are told apart by (doc_id, text); a row that stands twice in the table repeats
itself as a whole.  A null doc_id is kept as null.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm import textnum as tn

GRAM = 16


def anchors(buf: np.ndarray, off: np.ndarray, p: np.ndarray, length: int, gap: int) -> np.ndarray:
    """Positions of the sampled suffixes of a block of texts that have length − gap bytes to their right."""
    n = len(buf)
    if n < gap + GRAM:
        return np.zeros(0, np.int64)
    at = np.arange(n - GRAM + 1)
    h = (tn.substring_hash(p, at, at + GRAM) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    m, w = h, 1
    while w < gap:                                             # minimum of gap neighbours, leftmost of equal ones
        s = min(w, gap - w)
        m = np.minimum(m[:-s], m[s:])
        w += s
    end = np.repeat(off[1:], np.diff(off))
    first = np.arange(len(m))
    got = (m[first + gap + GRAM - 1 <= end[:len(m)]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    got = got[np.insert(got[1:] != got[:-1], 0, True)] if len(got) else got
    return got[got + length - gap <= end[got]]


def _keyed(docs: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", t.alias("t"), F.xxhash64("doc_id", "text").alias("key"))


def _names(docs: DataFrame, length: int, gap: int) -> DataFrame:
    """(name, key, pos) of all sampled suffixes."""
    def run(batches):
        for b in batches:
            key = b.column("key").to_numpy().view(np.uint64)
            for lo, hi, buf, off in tn.text_blocks(b.column("t"), 1_000_000):
                p = tn.prefix_sums(buf)
                a = anchors(buf, off, p, length, gap)
                row = np.searchsorted(off, a, "right") - 1
                yield pa.RecordBatch.from_arrays([tn.i64(tn.substring_hash(p, a, a + length - gap)), tn.i64(key[lo + row]),
                                                  pa.array((a - off[row]).astype(np.int32))], ["name", "key", "pos"])
    return docs.where(F.octet_length("t") >= length).select("key", "t").mapInArrow(run, "name long, key long, pos int")


def _each(batches, emit, names, types):
    """Rows of emit(bytes, prefix sums, row) over rows with a text ``t``, as Arrow batches."""
    for b in batches:
        rows = b.select([c for c in b.schema.names if c != "t"]).to_pylist()
        for lo, hi, buf, off in tn.text_blocks(b.column("t"), 1):    # one text at a time
            out = emit(buf, tn.prefix_sums(buf), rows[lo])
            if out is not None and len(out[0]):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(out, types)], names)


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _contexts(texts: DataFrame, length: int, gap: int) -> DataFrame:
    """key, pos, name, name_l (hash of length bytes, null near the end), both (hash of the whole context), left, right."""
    def emit(buf, p, r):
        a = np.unique(np.asarray(r["at"], np.int64))
        left, right = np.minimum(gap, a), np.minimum(length + gap, len(buf) - a)
        a, left, right = (x[left + right >= length] for x in (a, left, right))
        far = right >= length
        name_l = pa.array(_signed(tn.substring_hash(p, a, np.where(far, a + length, a))), pa.int64(), mask=~far)
        both = tn.mix(tn.substring_hash(p, a - left, a + right) + left.astype(np.uint64))
        key = np.full(len(a), r["key"], np.int64)
        return key, a, _signed(tn.substring_hash(p, a, a + length - gap)), name_l, _signed(both), left, right

    cols = ["key", "pos", "name", "name_l", "both", "left", "right"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return texts.select("key", "at", "t").mapInArrow(lambda bs: _each(bs, emit, cols, types),
                                                     "key long, pos int, name long, name_l long, both long, left int, right int")


def _tuples(texts: DataFrame, length: int, gap: int) -> DataFrame:
    """The sort tuples of the representatives: (class, bytes) by kind 0 right of length, 1 and 2 left, 3 right of the name."""
    def emit(buf, p, r):
        cls, ext, pos, kind = [], [], [], []
        for x in r["reps"]:
            a = x["pos"]
            left = bytes(buf[max(0, a - gap):a][::-1])
            rows = [(2, x["name"], left), (3, x["name"], bytes(buf[a + length - gap:a + length]))]
            if x["name_l"] is not None:
                rows += [(0, x["name_l"], bytes(buf[a + length:a + length + gap])), (1, x["name_l"], left)]
            for k, c, e in rows:
                cls.append(c), ext.append(e), pos.append(a), kind.append(k)
        cls = _signed(tn.mix(np.asarray(cls, np.int64).view(np.uint64) + np.asarray(kind, np.uint64)))
        return cls, ext, np.full(len(pos), r["key"], np.int64), pos, kind

    cols, types = ["cls", "ext", "key", "pos", "kind"], [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
    return texts.select("key", "reps", "t").mapInArrow(lambda bs: _each(bs, emit, cols, types),
                                                       "cls long, ext binary, key long, pos int, kind int")


def _lcp(cls: np.ndarray, ext: list[bytes], width: int) -> np.ndarray:
    """Common prefix of each row with the next one; −1 where the class differs."""
    size = np.array([len(e) for e in ext])
    flat = np.frombuffer(b"".join(e.ljust(width, b"\0") for e in ext), np.uint8).reshape(-1, width)
    same = flat[1:] == flat[:-1]
    n = np.where(same.all(1), width, same.argmin(1))
    return np.where(cls[1:] == cls[:-1], np.minimum(n, np.minimum(size[1:], size[:-1])), -1)


def _neighbours(tuples: DataFrame, width: int) -> DataFrame:
    """(key, pos, kind, lcp): longest common prefix of each tuple's bytes with any other of its class, if there is one."""
    from tabwright.session import cut_lineage

    def run(batches):
        from pyspark import TaskContext
        part, held, seen = TaskContext.get().partitionId(), None, False
        cols = ["key", "pos", "kind", "lcp", "part", "edge", "cls", "ext"]

        def out(rows):
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], cols)

        for b in batches:
            if not b.num_rows:
                continue
            cls, ext = b.column("cls").to_numpy(), b.column("ext").to_pylist()
            ids = list(zip(*(b.column(c).to_pylist() for c in ("key", "pos", "kind"))))
            before = -1
            if held is not None:                               # (ids, cls, ext, lcp with the row before)
                cls, ext, ids, before = np.insert(cls, 0, held[1]), [held[2], *ext], [held[0], *ids], held[3]
            nxt = _lcp(cls, ext, width)
            best = np.maximum(np.insert(nxt, 0, before)[:-1], nxt)
            rows = [(*i, int(v), part, 0, None, None) for i, v in zip(ids, best) if v >= 0]
            if not seen:
                rows.append((*ids[0], -1, part, 1, int(cls[0]), ext[0]))
                seen = True
            held = (ids[-1], int(cls[-1]), ext[-1], int(nxt[-1]) if len(nxt) else before)
            if rows:
                yield out(rows)
        if held is not None:
            yield out([(*held[0], held[3], part, 2, held[1], held[2])])

    got = cut_lineage(tuples.repartitionByRange("cls", "ext").sortWithinPartitions("cls", "ext")
                      .mapInArrow(run, "key long, pos int, kind int, lcp int, part int, edge int, cls long, ext binary"))
    ends = sorted(got.where("edge > 0").collect(), key=lambda r: (r.part, r.edge))       # two rows per partition
    more = []
    for x, y in zip(ends, ends[1:]):
        if x.edge == 2 and y.edge == 1 and x.cls == y.cls:
            v = int(_lcp(np.array([x.cls, y.cls]), [bytes(x.ext), bytes(y.ext)], width)[0])
            more += [(r.key, r.pos, r.kind, v) for r in (x, y)]
    got = got.where("lcp >= 0").select("key", "pos", "kind", "lcp")
    if more:
        got = got.unionAll(got.sparkSession.createDataFrame(more, "key long, pos int, kind int, lcp int"))
    return got


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _open_ranges(samples: DataFrame, length: int, gap: int) -> DataFrame:
    """(name, lo, hi): left offsets at which a string not covered yet may repeat, for the samples that allow one.

    ``samples``: key, spans (known repeats of the document), open (samples with a chance of more)."""
    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                known = merged((s["a"], s["b"]) for s in r["spans"] or () if s["a"] is not None)
                for x in r["open"] or ():
                    lo, hi = max(x["lo"], length - x["right"]), x["left"]
                    a, z = x["pos"] - hi, x["pos"] - lo + length
                    if lo <= hi and not any(s <= a and z <= e for s, e in known):
                        out.append((x["name"], lo, hi))
            n, lo, hi = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["name", "lo", "hi"])
    return samples.mapInArrow(run, "name long, lo int, hi int").groupBy("name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _short_repeats(texts: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """(key, a, b) of the strings at left offsets lo..hi of the given samples that start at two places at least."""
    def emit(buf, p, r):
        start = np.unique(np.concatenate([np.arange(max(0, x["pos"] - x["hi"]), x["pos"] - x["lo"] + 1) for x in r["members"]] or [np.zeros(0, int)]))
        start = start[(start >= 0) & (start + length <= len(buf))].astype(np.int64)
        return _signed(tn.substring_hash(p, start, start + length)), np.full(len(start), r["key"], np.int64), start

    cols, types = ["h", "key", "a"], [pa.int64(), pa.int64(), pa.int32()]
    per_doc = members.groupBy("key").agg(F.collect_list(F.struct("pos", "lo", "hi")).alias("members"))
    rows = (texts.select("key", "t").join(per_doc, "key").select("key", "members", "t")
            .mapInArrow(lambda bs: _each(bs, emit, cols, types), "h long, key long, a int").distinct())
    twice = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    return rows.join(twice, "h", "left_semi").select("key", "a", (F.col("a") + length).alias("b"))


def repeated_spans(texts: DataFrame, length: int, gap: int) -> DataFrame:
    """(key, a, b): byte ranges whose every byte is covered by a repeated string; ``texts``: key, t, at (samples)."""
    from tabwright.session import cut_lineage
    ctx = cut_lineage(_contexts(texts, length, gap))
    # written and without the contexts that stand once, so that the join deals both sides and can split a context that many texts share
    group = cut_lineage(ctx.groupBy("both").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos")).alias("rep")).where("n > 1"))
    ctx2 = ctx.join(group, "both", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    twin = ctx2.where("n > 1").select("key", (F.col("pos") - F.col("left")).alias("a"), (F.col("pos") + F.col("right")).alias("b"))
    reps = cut_lineage(ctx2.where("n = 1 or (key = rep.key and pos = rep.pos)").select("key", "pos", "name", "name_l", "left", "right", "n").distinct())
    # a name that only one representative bears has nothing to be compared with
    shared = reps.groupBy("name").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("name")
    reps = cut_lineage(reps.join(shared, "name", "left_semi"))
    per_doc = reps.groupBy("key").agg(F.collect_list(F.struct("pos", "name", "name_l")).alias("reps"))
    near = _neighbours(_tuples(texts.select("key", "t").join(per_doc, "key"), length, gap), gap)
    lcp = near.groupBy("key", "pos").agg(*[F.max(F.when(F.col("kind") == k, F.col("lcp"))).alias(c)
                                          for k, c in enumerate(("r400", "l400", "l1", "r1"))])
    one = cut_lineage(reps.where("n = 1").join(lcp, ["key", "pos"]))
    far = one.where("l400 is not null").select("key", (F.col("pos") - F.col("l400")).alias("a"), (F.col("pos") + length + F.col("r400")).alias("b"))
    known = cut_lineage(twin.unionAll(far).distinct())
    maybe = one.where(F.col("l1") > F.coalesce("l400", F.lit(0))).where(F.col("l1") + F.col("r1") >= gap)
    maybe = maybe.groupBy("key").agg(F.collect_list(F.struct(
        "pos", "name", F.col("l1").alias("left"), (F.col("r1") + length - gap).alias("right"),
        (F.coalesce("l400", F.lit(0)) + 1).alias("lo"))).alias("open"))
    ranges = cut_lineage(_open_ranges(maybe.join(known.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "key", "left")
                                      .select("key", "spans", "open"), length, gap))
    if not ranges.limit(1).count():
        return known
    members = cut_lineage(reps.join(ranges, "name").select("key", "pos", "lo", "hi"))
    return known.unionAll(_short_repeats(texts, members, length))


def remove_repeats(docs: DataFrame, length: int = 400, gap: int = 128) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_kept (bytes that stay) of every row."""
    from tabwright.session import checkpoint_dir, cut_lineage
    if not GRAM + gap < length - gap:
        raise ValueError("gap must stay under half the length")
    spark, rows = docs.sparkSession, _keyed(docs)
    names = _names(rows, length, gap)
    # written, so that the join below deals both sides itself and can split a name that many texts share
    twice = cut_lineage(names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"))
    at = names.join(twice, "name", "left_semi").groupBy("key").agg(F.collect_list("pos").alias("at"))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/repeats-{uuid.uuid4().hex}"
    rows.select("key", "t").join(at, "key").write.parquet(folder)      # the texts that hold a sample named twice
    texts = spark.read.parquet(folder)
    spans = repeated_spans(texts, length, gap).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def cut(batches):
        for b in batches:
            out = []
            for key, t, s in zip(*(b.column(c).to_pylist() for c in ("key", "t", "spans"))):
                gone, raw, pos, sha = merged((x["a"], x["b"]) for x in s), t.encode("utf-8", "surrogatepass"), 0, hashlib.sha256()
                for a, z in gone:
                    sha.update(raw[pos:a])
                    pos = z
                sha.update(raw[pos:])
                out.append((key, sum(z - a for a, z in gone), len(gone), sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                             ["key", "n_removed", "n_spans", "sha"])

    done = cut_lineage(texts.select("key", "t").join(spans, "key").select("key", "t", "spans")
                       .mapInArrow(cut, "key long, n_removed long, n_spans long, sha string").distinct())
    whole = rows.select("doc_id", "key", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2(F.col("t").cast("binary"), 256).alias("all"))
    zero = F.lit(0).cast("long")
    return whole.join(done, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("sha", "all").alias("kept_sha256"), (F.col("n_bytes") - F.coalesce("n_removed", zero)).alias("n_kept"))
