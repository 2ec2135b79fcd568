"""Molecule-table operators (K1–K10, J2, J3, J7–J9, F9–F11) re-aimed as Spark jobs.

No chemistry toolkit is bundled: per-molecule descriptor functions are the
caller's plugins, applied once per *distinct* string (``mapInPandas`` in Arrow
batches) and joined back; property formulas and catalogs are tables.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.scalar import cap_polymer, has_polymer_marker, ionisation_state, spin_arguments
from tabwright.plans.ordering import global_row_number
from tabwright.session import cut_lineage, release

T_REF = 298.15


def group_contribution_properties(counts: DataFrame, coefficients: DataFrame, mol: str = "mol_id",
                                  n_atoms: str = "n_atoms", group: str = "group_label", n: str = "n") -> DataFrame:
    """K3 / J11 — group-contribution estimates from (molecule, atoms, group, count)
    and a caller-supplied coefficient table (group_label, dTb, dTm, dTc, dPc, dVc,
    dHf, dGf, cp_a, cp_b, cp_c, cp_d):
    Tb = 198.2 + Σ, Tm = 122.5 + Σ, Tc = Tb / (0.584 + 0.965Σ − Σ²),
    Pc = (0.113 + 0.0032·n_atoms − Σ)⁻², Vc = 17.5 + Σ, Hf = 68.29 + Σ,
    Gf = 53.88 + Σ, Cp298 = Σa + Σb·T + Σc·T² + Σd·T³ (T = 298.15); all rounded
    to 2 dp; a molecule without matched groups gets NULLs.  The coefficient
    table has one row per group (bounded) and is broadcast."""
    j = counts.where(F.col(n) > 0).join(F.broadcast(coefficients), group)
    s = {k: F.sum(F.col(n) * F.col(k)) for k in ("dTb", "dTm", "dTc", "dPc", "dVc", "dHf", "dGf",
                                                  "cp_a", "cp_b", "cp_c", "cp_d")}
    g = j.groupBy(mol).agg(F.first(n_atoms).alias("_na"), F.sum(n).alias("n_groups"),
                           *[e.alias(k) for k, e in s.items()])
    allm = counts.select(mol).distinct()
    tb = F.lit(198.2) + F.col("dTb")
    den = F.lit(0.584) + 0.965 * F.col("dTc") - F.col("dTc") * F.col("dTc")
    inv_pc = F.lit(0.113) + 0.0032 * F.col("_na") - F.col("dPc")
    cp = F.col("cp_a") + F.col("cp_b") * T_REF + F.col("cp_c") * T_REF ** 2 + F.col("cp_d") * T_REF ** 3
    out = g.select(mol, F.round(tb, 2).alias("Tb"), F.round(F.lit(122.5) + F.col("dTm"), 2).alias("Tm"),
                   F.round(F.when(F.abs(den) > 1e-10, tb / den), 2).alias("Tc"),
                   F.round(F.when(F.abs(inv_pc) > 1e-10, F.pow(inv_pc, -2.0)), 2).alias("Pc"),
                   F.round(F.lit(17.5) + F.col("dVc"), 2).alias("Vc"), F.round(F.lit(68.29) + F.col("dHf"), 2).alias("Hf"),
                   F.round(F.lit(53.88) + F.col("dGf"), 2).alias("Gf"), F.round(cp, 2).alias("Cp298"),
                   F.col("n_groups").cast("long"))
    return allm.join(out, mol, "left")


def run_descriptor_plugins(df: DataFrame, mol_col: str, plugins: dict, keep_input: bool = True) -> DataFrame:
    """K1 / J2 — apply descriptor plugins to every *distinct* molecule string.

    ``plugins`` maps name → function(pd.Series[str]) → pd.Series (one column named
    after the plugin) or pd.DataFrame (many columns).  Each batch of distinct
    strings is evaluated once per plugin; a plugin that raises or returns the
    wrong length yields NULLs for that batch; values are coerced to double;
    the first plugin defining a name wins; an input column with the same name
    loses.  Results are joined back on the string (not by position)."""
    import pandas as pd

    # discover output names on an empty probe of each plugin
    names = []
    for pname, fn in plugins.items():
        try:
            probe = fn(pd.Series(["C"], dtype="object"))
            cols = [pname] if isinstance(probe, pd.Series) else list(probe.columns)
        except Exception:  # noqa: BLE001
            cols = []
        for c in cols:
            if c not in names:
                names.append(c)
    schema = T.StructType([T.StructField("_tw_mol", T.StringType())] +
                          [T.StructField(c, T.DoubleType()) for c in names])

    def run(batches):
        for pdf in batches:
            s = pdf["_tw_mol"]
            out = pd.DataFrame({"_tw_mol": s})
            for c in names:
                out[c] = float("nan")
            seen = set()
            for pname, fn in plugins.items():
                try:
                    res = fn(s.reset_index(drop=True))
                    res = res.to_frame(pname) if isinstance(res, pd.Series) else res
                    if len(res) != len(s):
                        continue
                    for c in res.columns:
                        if c in seen or c not in names:
                            continue
                        seen.add(c)
                        out[c] = pd.to_numeric(res[c].reset_index(drop=True), errors="coerce").astype("float64").values
                except Exception:  # noqa: BLE001
                    continue
            yield out

    distinct = df.select(F.col(mol_col).cast("string").alias("_tw_mol")).where(F.col("_tw_mol").isNotNull()).distinct()
    desc = distinct.mapInPandas(run, schema)
    base = df.drop(*[c for c in names if c in df.columns]) if keep_input else df.select(mol_col)
    return base.join(desc, base[mol_col].cast("string") == desc["_tw_mol"], "left").drop("_tw_mol")


def descriptor_success(desc: DataFrame, columns) -> DataFrame:
    """K2 — failed rows (every descriptor NULL), success rate, number of columns."""
    cols = list(columns)
    all_null = F.lit(True)
    for c in cols:
        all_null = all_null & F.col(c).isNull()
    return desc.agg(F.sum(all_null.cast("int")).cast("long").alias("n_failed"),
                    F.avg((~all_null).cast("double")).alias("success_rate"),
                    F.lit(len(cols)).alias("n_columns"))


def precomputed_lookup(df: DataFrame, mol_col: str, table: DataFrame, key_col: str):
    """J3 — left join a precomputed descriptor table; usable only if every row hit.
    Returns (joined frame, all_hit flag from one ``bool_and``)."""
    j = df.join(table.withColumnRenamed(key_col, "_tw_key"), F.col(mol_col) == F.col("_tw_key"), "left")
    ok = j.agg(F.bool_and(F.col("_tw_key").isNotNull())).first()[0]
    return j.drop("_tw_key"), bool(ok)


def charge_columns(df: DataFrame, mol: str, overrides: DataFrame | None = None, default_charge: int = 0,
                   default_multiplicity: int = 1) -> DataFrame:
    """K5 / F11 — per-molecule charge and multiplicity (override table joined,
    default otherwise), uhf = multiplicity − 1 and a validity flag."""
    out = df
    if overrides is not None:
        out = out.join(overrides.select(mol, F.col("charge").alias("_tw_q"), F.col("multiplicity").alias("_tw_m")), mol, "left")
    else:
        out = out.withColumn("_tw_q", F.lit(None).cast("int")).withColumn("_tw_m", F.lit(None).cast("int"))
    out = out.withColumn("charge", F.coalesce("_tw_q", F.lit(default_charge))) \
        .withColumn("multiplicity", F.coalesce("_tw_m", F.lit(default_multiplicity))).drop("_tw_q", "_tw_m")
    uhf, valid = spin_arguments(F.col("multiplicity"), F.col("charge"))
    return out.withColumn("uhf", uhf).withColumn("valid_spin", valid)


def protonation_states(pka: DataFrame, ph: float = 7.4) -> DataFrame:
    """F10 — (mol_id, pka_acidic, pka_basic) → ionisation state at pH."""
    return pka.withColumn("state", ionisation_state(F.col("pka_acidic"), F.col("pka_basic"), ph))


def polymer_rows(df: DataFrame, mol_col: str) -> DataFrame:
    """K7 / F9 — flag strings with attachment points and cap them."""
    return df.withColumn("is_polymer", has_polymer_marker(F.col(mol_col))) \
        .withColumn(f"{mol_col}_capped", F.when(has_polymer_marker(F.col(mol_col)), cap_polymer(F.col(mol_col)))
                    .otherwise(F.col(mol_col)))


def catalog_categories(catalog: DataFrame, order_col: str, category: str = "category") -> DataFrame:
    """K6 — distinct categories in first-seen order (by the smallest position)."""
    first = catalog.groupBy(category).agg(F.min(order_col).alias("_tw_first"))
    return global_row_number(first, ["_tw_first", category], "position").select(category, "position")


def recommend(targets: DataFrame, key: str, target_col: str, catalog: DataFrame, pattern_col: str,
              order_col: str) -> DataFrame:
    """J9 — first catalog entry (by ``order_col``) whose pattern occurs in the
    target name, case-insensitively.  The catalog is a small dimension table
    (bounded by its own definition) and is broadcast."""
    j = targets.join(F.broadcast(catalog), F.lower(F.col(target_col)).contains(F.lower(F.col(pattern_col))))
    w = Window.partitionBy(key).orderBy(order_col, pattern_col)
    return j.withColumn("_tw_r", F.row_number().over(w)).where("_tw_r = 1").drop("_tw_r")


def novelty(candidates: DataFrame, known: DataFrame, col: str) -> DataFrame:
    """J8 / U6 — candidates whose value is not in the known set (anti-join)."""
    return candidates.join(known.select(col).distinct(), col, "left_anti")


# --- J7 / K4: exact set-similarity join ----------------------------------------

def token_sets(df: DataFrame, key: str, text: str, pattern: str = r"[^\p{L}\p{N}]+") -> DataFrame:
    """(key, tokens): distinct lower-cased word tokens of the *whole* text."""
    toks = F.array_distinct(F.array_remove(F.split(F.lower(F.col(text)), pattern), ""))
    return df.select(key, toks.alias("tokens"))


def exact_duplicate_groups(sets: DataFrame, key: str) -> DataFrame:
    """Rows whose token sets are identical: (key, rep) with rep = smallest key of
    the set.  A ``groupBy`` on the sorted set — copies collapse map-side."""
    s = sets.withColumn("_tw_sorted", F.array_sort("tokens"))
    reps = s.groupBy("_tw_sorted").agg(F.min(key).alias("rep"))
    return s.join(reps, "_tw_sorted").select(key, "rep")


_BITS, _BEFORE, _LIST = 2048, 4, 4096               # most bits of a sketch, tokens looked back on, sets of a list
_CELL = 1 << 19                                      # tokens of a cell
_BLOCK, _SLICE = 1 << 17, 1 << 13                    # pairs judged at a time, tokens compared at a time


def _ceil(x):
    import numpy as np
    return np.ceil(x - 1e-9).astype(np.int64)


def _meeting_rows(threshold: float, unique: int):
    """Rows (rank, sid, n, pos, vec, before) of the prefix tokens of each set that others have too: its size, the token's
    place, a sketch of the set and the four prefix tokens ahead of this one.  The sketch has 64 to 2048 bits by size; each says
    whether an odd number of tokens fall on it, so every bit that differs is a token that one of two sets lacks."""
    import numpy as np
    import pyarrow as pa

    def binary(data, ends):
        off = np.concatenate([[0], ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])

    def rows(b):
        off = b.column("r").offsets.to_numpy().astype(np.int64)
        flat, off = b.column("r").values.to_numpy()[off[0]:off[-1]].astype(np.int64), off - off[0]
        n = np.diff(off)
        at = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(flat)) - off[at]
        first = np.bincount(at[flat < unique], minlength=len(n))
        take = np.flatnonzero((place >= first[at]) & (place <= (n - _ceil(threshold * n))[at]))
        if not len(take):
            return
        wide = np.clip(1 << np.frexp(np.maximum(n - 1, 1).astype(np.float64))[1].astype(np.int64), 64, _BITS)
        odd = np.bincount(at * _BITS + flat % wide[at], minlength=len(n) * _BITS).reshape(-1, _BITS) & 1
        vec = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little")
        ahead = take[:, None] - np.arange(_BEFORE, 0, -1)
        there = ahead >= (off[:-1] + first)[at[take], None]
        before = np.where(there, flat[np.where(there, ahead, 0)], -1).astype(np.int64)
        at = at[take]
        has = np.arange(_BITS // 8) < (wide // 8)[at, None]
        yield pa.record_batch([pa.array(flat[take]), b.column("sid").take(pa.array(at)), pa.array(n[at].astype(np.int32)), pa.array((place[take] + 1).astype(np.int32)),
                               binary(vec[at][has], np.cumsum((wide // 8)[at])), binary(before, np.arange(1, len(at) + 1) * before.strides[0])],
                              ["rank", "sid", "n", "pos", "vec", "before"])

    def run(batches):
        for batch in batches:
            ends = np.cumsum(batch.column("r").value_lengths().to_numpy().astype(np.int64))
            part = (ends >> 17) + np.arange(batch.num_rows) // 1000                                 # about 131,072 tokens, 1,000 sets at a time
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if j > i:
                    yield from rows(batch.slice(i, j - i))
    return run


def _words(col):
    """Sketches of any length as rows of 64-bit words, and those rows folded to 1, 2, 4 … words."""
    import numpy as np
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
    out = np.zeros((len(col), _BITS // 8), np.uint8)
    out[np.arange(_BITS // 8) < np.diff(off)[:, None]] = np.frombuffer(col.buffers()[2], np.uint8)[off[0]:off[-1]]
    return out.view(np.uint64), (np.diff(off) // 8).astype(np.int64)


def _befores(col):
    import numpy as np
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0]:off[-1]].view(np.int64).reshape(len(col), _BEFORE)


def _judge(threshold: float, n, vec, width, before):
    """A function that keeps those of the pairs (x, y) that can reach the threshold by their sketches, at the first token they share."""
    import numpy as np
    folded = {}

    def fold(w):
        if w not in folded:
            folded[w] = np.bitwise_xor.reduce(vec.reshape(len(vec), -1, w), axis=1)
        return folded[w]

    def judged(x, y):
        for i in range(_BEFORE - 1, -1, -1):                                 # met at an earlier token already
            t = before[x, i]
            ok = ~(((t[:, None] == before[y]) & (t[:, None] >= 0)).any(1))
            x, y = x[ok], y[ok]
        most, least, ok = (1 - threshold) / (1 + threshold) * (n[x] + n[y]) + 1e-6, np.minimum(width[x], width[y]), np.zeros(len(x), bool)
        for w in np.unique(least).tolist():
            at = np.flatnonzero(least == w)
            f = fold(w)
            ok[at] = np.bitwise_count(f[x[at]] ^ f[y[at]]).sum(1, dtype=np.int64) <= most[at]
        return x[ok], y[ok]
    return judged


def _may_reach(threshold: float):
    """Of pairs that meet in a token, those that can reach the threshold by their sketches, at the first token they share."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            (va, wa), (vb, wb) = _words(b.column("va")), _words(b.column("vb"))
            n = np.concatenate([b.column(c).to_numpy() for c in ("na", "nb")]).astype(np.int64)
            before = np.concatenate([_befores(b.column(c)) for c in ("ba", "bb")])
            x, _ = _judge(threshold, n, np.concatenate([va, vb]), np.concatenate([wa, wb]), before)(np.arange(b.num_rows), np.arange(b.num_rows) + b.num_rows)
            yield b.select(["a", "b"]).take(pa.array(x))
    return run


def _cell(sid, n, cell: int):
    """Sets of a size class that follow one another by their smallest hash share a cell of ``cell`` tokens and 1,024 sets at most."""
    import numpy as np
    k = np.frexp(n.astype(np.float64))[1].astype(np.int64)                   # n < 2^k
    return (k << 56) + (sid >> np.clip(cell.bit_length() - 1 - k, 0, 10))


def _meeting_pairs(threshold: float, cell: int):
    """Pairs (a, b, ca, cb) of the sets in a list that can reach the threshold, with their cells.  The rows come by list and
    side and, in it, by size, so that a set's partners by the size bound lie in one run; pairs are judged in blocks by the
    token's place, by whether they met at an earlier token and by their sketches."""
    import numpy as np
    import pyarrow as pa

    def arrays(b):
        v = {c: b.column(c).to_numpy().astype(np.int64) for c in ("rank", "tile", "side", "sid", "n", "pos")}
        v["vec"], v["width"] = _words(b.column("vec"))
        return v | {"before": _befores(b.column("before"))}

    def lists(v):
        """The pairs of whole lists, a block at a time."""
        size, side, n, pos = len(v["sid"]), v["side"], v["n"], v["pos"]
        new = np.ones(size, bool)
        new[1:] = (np.diff(v["rank"]) != 0) | (np.diff(v["tile"]) != 0)
        part = new.copy()
        part[1:] |= np.diff(side) != 0
        group, code = np.cumsum(new), np.cumsum(part)
        wide = int(n.max()) + 2
        key, top = code * wide + n, np.minimum(np.floor((n + 1e-6) / threshold), wide - 1).astype(np.int64)
        end = np.searchsorted(code, code, "right")                           # where the other side of the list begins
        cross = (v["tile"] >> 20) != (v["tile"] & 0xFFFFF)
        other = cross & (side == 0) & (end < size) & (group[np.minimum(end, size - 1)] == group)
        low = np.where(cross, np.searchsorted(key, (code + 1) * wide + _ceil(threshold * n)), np.arange(1, size + 1))
        high = np.searchsorted(key, np.where(cross, code + 1, code) * wide + top, "right")
        much = np.where(cross & ~other, 0, np.maximum(high - low, 0))
        upto = np.cumsum(much)
        judged = _judge(threshold, n, v["vec"], v["width"], v["before"])
        for s in range(0, int(upto[-1]), _BLOCK):
            at = np.arange(s, min(s + _BLOCK, int(upto[-1])))
            x = np.searchsorted(upto, at, "right")
            y = low[x] + at - (upto - much)[x]
            most = np.minimum(pos[x], pos[y]) + np.minimum(n[x] - pos[x], n[y] - pos[y])
            ok = (1 + threshold) * most >= threshold * (n[x] + n[y]) - 1e-6
            x, y = judged(x[ok], y[ok])
            if len(x):
                turned = v["sid"][x] > v["sid"][y]
                x, y = np.where(turned, y, x), np.where(turned, x, y)
                a, b = v["sid"][x], v["sid"][y]
                yield pa.record_batch([pa.array(c) for c in (a, b, _cell(a, n[x], cell), _cell(b, n[y], cell))], ["a", "b", "ca", "cb"])

    def run(batches):
        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            v = arrays(b)
            if kept is not None:
                v = {c: np.concatenate([kept[c], v[c]]) for c in v}
            last = int(np.flatnonzero((v["rank"] != v["rank"][-1]) | (v["tile"] != v["tile"][-1])).max(initial=-1)) + 1
            kept = {c: x[last:].copy() for c, x in v.items()}                # the last list may go on in the next batch
            if last:
                yield from lists({c: x[:last] for c, x in v.items()})
        if kept is not None:
            yield from lists(kept)
    return run


def _overlaps(of, flat, a, b):
    """The number of tokens that the sets ``a`` and ``b`` (places of sets) share; ``flat`` has the tokens, ``of`` their set."""
    import numpy as np
    _, token, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often > 1
    token, of = (np.cumsum(shared) - 1)[token[shared[token]]], of[shared[token]]
    both, order = np.zeros(len(a), np.int64), np.argsort(token, kind="stable")
    token, of = token[order], of[order]
    for low in range(0, int(shared.sum()), _SLICE):                          # a bit per set and token of the slice
        i, j = np.searchsorted(token, [low, low + _SLICE])
        width = -(-min(_SLICE, int(shared.sum()) - low) // 64) * 64
        bits = np.zeros((int(max(a.max(), b.max())) + 1, width), bool)
        bits[of[i:j], token[i:j] - low] = True
        bits = np.packbits(bits, axis=1).view(np.uint64)
        step = max(1, (1 << 18) // bits.shape[1])
        for s in range(0, len(a), step):
            both[s:s + step] += np.bitwise_count(bits[a[s:s + step]] & bits[b[s:s + step]]).sum(1, dtype=np.int64)
    return both


def _verified_pairs(cand: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs that reach the threshold.  A set goes to a pair of cells once, however many of its pairs
    lie there."""
    import numpy as np
    import pyarrow as pa
    need = cand.select(F.col("ca").alias("x"), F.col("cb").alias("y"), F.explode(F.array("a", "b")).alias("sid")).distinct()
    sent = need.join(sets.select("sid", "r"), "sid")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        r = right.column("r").combine_chunks()
        off, flat, sid = r.offsets.to_numpy(), r.values.to_numpy(), right.column("sid").to_numpy()
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        n, order = np.diff(off).astype(np.int64), np.argsort(sid)
        x, y = (order[np.searchsorted(sid, c, sorter=order)] for c in (a, b))
        both = _overlaps(np.repeat(np.arange(len(n)), n), flat[off[0]:off[-1]], x, y)
        sim = both / (n[x] + n[y] - both)
        ok = sim >= threshold
        return pa.table([pa.array(a[ok]), pa.array(b[ok]), pa.array(sim[ok])], ["a", "b", "jaccard"])
    return cand.groupBy("ca", "cb").cogroup(sent.groupBy("x", "y")).applyInArrow(compare, "a long, b long, jaccard double")


def jaccard_threshold_pairs(sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """J7 — exact pairs of *distinct* token sets with Jaccard ≥ threshold
    (Tanimoto on sets), id_a < id_b over set representatives.

    Prefix filtering: tokens are ordered globally from rare to frequent; two
    sets with J ≥ τ must share a token among each one's first
    |s| − ⌈τ|s|⌉ + 1 tokens.  Sets meet in shared prefix tokens and are judged
    there, before anything is shuffled: by the size bound τ|a| ≤ |b| ≤ |a|/τ, by
    the place of the token in both, by whether they met at an earlier token and by
    sketches, whose differing bits bound the overlap.  The list of a token with
    more than ``_LIST`` sets is dealt into chunks, each pair of which is a list of
    its own.  What is left goes to the sets themselves, a set once per pair of
    cells; sets are numbered by size class and smallest hash, which near copies
    mostly share, so that their pairs lie in few cells.  Exact copies are collapsed
    first, so a group of copies never produces all its pairs.  Tokens are told apart by 64-bit hashes."""
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be in (0, 1]")
    spark = sets.sparkSession
    hashed = sets.select(F.col(key).alias("id"), F.sort_array(F.array_distinct(F.transform("tokens", lambda x: F.xxhash64(x)))).alias("t"))
    uniq = hashed.where(F.size("t") > 0).groupBy("t").agg(F.min("id").alias("id")).where(F.col("id").isNotNull())
    near = [F.floor(F.log2(F.size("t"))), F.element_at("t", 1), F.col("id")]
    uniq = uniq.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), *near).sortWithinPartitions(*near)
    uniq = cut_lineage(uniq.withColumn("sid", F.monotonically_increasing_id()))
    release(spark)                                                           # the sets are on disk once more in two shuffles
    ids, times = cut_lineage(uniq.select("sid", "id")), None
    often = hashed.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 and id is not null").select("id")
    if often.limit(1).count():                                               # c rows of one set and key stand for c² on their side
        same = hashed.join(often, "id", "left_semi").groupBy("id", "t").agg(F.count(F.lit(1)).alias("c")).join(uniq, ["id", "t"])
        times = cut_lineage(same.select("sid", (F.col("c") * F.sum("c").over(Window.partitionBy("id"))).alias("m")))
    ex = uniq.select("sid", F.explode("t").alias("tok"))
    freq = ex.groupBy("tok").agg(F.count(F.lit(1)).alias("_f"))
    order = cut_lineage(global_row_number(freq, ["_f", "tok"], "rank").select("tok", "rank", "_f"))
    unique, most = order.agg(F.min(F.when(F.col("_f") > 1, F.col("rank"))), F.max("rank")).first()
    unique, kind = (1 << 62) if unique is None else unique, "int" if (most or 0) < 1 << 31 else "long"
    release(spark)
    ranks = ex.join(order.select("tok", F.col("rank").cast(kind)), "tok").groupBy("sid").agg(F.sort_array(F.collect_list("rank")).alias("r"))
    ranks = cut_lineage(ranks)
    del uniq, ex, freq, order, hashed, often
    same = None
    release(spark)
    n = F.size("r")
    listed = ranks.select(F.explode(F.slice("r", F.lit(1), (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int"))).alias("rank")).where(F.col("rank") >= unique)
    long = cut_lineage(listed.groupBy("rank").agg(F.ceil(F.count(F.lit(1)) / _LIST).cast("int").alias("c")).where("c > 1"))     # few: total / _LIST at most
    release(spark)                                                           # by now Spark's own events hold the shuffles of ``ranks`` no more
    meet = ranks.mapInArrow(_meeting_rows(threshold, unique), "rank long, sid long, n int, pos int, vec binary, before binary")
    meet = meet.join(F.broadcast(long), "rank", "left").withColumn("_c", F.coalesce("c", F.lit(1)))
    meet = meet.withColumn("_i", F.pmod(F.xxhash64("sid"), F.col("_c"))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    tile = F.shiftleft(F.least("_i", "_j").cast("long"), 20) + F.greatest("_i", "_j")
    meet = meet.select("rank", tile.alias("tile"), (F.col("_i") > F.col("_j")).cast("int").alias("side"), "sid", "n", "pos", "vec", "before")
    meet = meet.repartition("rank", "tile").sortWithinPartitions("rank", "tile", "side", "n")
    cand = cut_lineage(meet.mapInArrow(_meeting_pairs(threshold, _CELL), "a long, b long, ca long, cb long").distinct())
    del meet
    release(spark)
    some = ranks.join(cand.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi")
    got = _verified_pairs(cand, some, threshold)
    name = lambda c: ids.select(F.col("sid").alias(c), F.col("id").alias("i" + c))
    got = got.join(name("a"), "a").join(name("b"), "b").where(F.col("ia") != F.col("ib"))
    if times is not None:
        for c in ("a", "b"):
            got = got.join(times.select(F.col("sid").alias(c), F.col("m").alias("m" + c)), c, "left")
        many = F.coalesce("ma", F.lit(1)) * F.coalesce("mb", F.lit(1))
        got = got.withColumn("_o", F.explode(F.array_repeat(F.lit(1), many.cast("int"))))
    return got.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "jaccard")


def max_similarity_to_reference(cands: DataFrame, ref: DataFrame, key: str, threshold: float) -> DataFrame:
    """J7 nearest-reference form — one row per candidate: the largest Jaccard to any
    reference set if it reaches ``threshold``, else NULL.  Candidates and references
    are joined as two sides: each side's copies are collapsed, an equal set is at
    1.0, and rare-token prefixes of the one side meet those of the other."""
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be in (0, 1]")
    sides = [d.select(key, F.array_sort(F.array_distinct("tokens")).alias("t")) for d in (cands, ref)]
    c, r = (s.where(F.size("t") > 0).select("t").distinct().withColumn("_h", F.xxhash64("t")) for s in sides)
    freq = c.unionAll(r).select(F.explode("t").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("_f"))
    w = Window.partitionBy("t").orderBy("_f", "tok")

    def prefix(s):
        ex = s.select("t", F.explode("t").alias("tok")).join(freq, "tok").withColumn("_p", F.row_number().over(w))
        n = F.size("t")
        return ex.where(F.col("_p") <= n - F.ceil(F.lit(threshold) * n) + 1).select("tok", "t")

    a, b = prefix(c).withColumnRenamed("t", "ta"), prefix(r).withColumnRenamed("t", "tb")
    size_ok = (F.size("tb") >= threshold * F.size("ta")) & (F.size("ta") >= threshold * F.size("tb"))
    inter = F.size(F.array_intersect("ta", "tb"))
    best = (a.join(b, "tok").where(size_ok).select("ta", (inter / (F.size("ta") + F.size("tb") - inter)).alias("j"))
            .where(F.col("j") >= threshold).groupBy("ta").agg(F.max("j").alias("max_jaccard")))
    return sides[0].join(best, sides[0].t == best.ta, "left").select(key, "max_jaccard")


def staged_descriptor_build(df: DataFrame, mol_col: str, stages: list) -> DataFrame:
    """K8 — apply plugin sets in order (e.g. recommended → counts → curated →
    extra engines); a later stage only adds names not produced before.  Each
    stage is one distinct-string ``mapInPandas`` joined back on the string."""
    out = df
    seen = set(df.columns)
    for plugins in stages:
        stage = run_descriptor_plugins(df.select(mol_col).distinct(), mol_col, plugins)
        new = [c for c in stage.columns if c not in seen and c != mol_col]
        if new:
            out = out.join(stage.select(mol_col, *new), mol_col, "left")
            seen |= set(new)
    return out


def descriptor_sets(df: DataFrame, mol_col: str, sets: dict, enabled=None) -> dict:
    """K9 — named descriptor sets (name → plugins); returns name → frame with that
    set's columns, for the enabled sets only (evaluate each with V1/V20)."""
    names = [n for n in sets if enabled is None or n in set(enabled)]
    return {n: run_descriptor_plugins(df, mol_col, sets[n]) for n in names}
