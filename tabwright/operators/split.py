"""Cross-validation splits as fold tables.

A split never copies rows: it is a table ``(key, fold)`` (compact: each row's
test fold) or ``(key, split_id, role)`` (long: train/test membership per
split).  Training filters the cached data by joining on the key.
Randomness is ``xxhash64(key, seed[, repeat])`` ordering — stable under
repartitioning and re-execution — and positions come from the distributed
global row number (no single-task window)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions import boundary as B
from tabwright.session import cut_lineage
from tabwright.plans.ordering import global_row_number

# Registry of split names and their requirements.
SPLITS = {
    "kfold": (False, False), "stratified_kfold": (False, True), "stratifiedfold": (False, True),
    "group_kfold": (True, False), "groupfold": (True, False), "stratified_group_kfold": (True, True),
    "loo": (False, False), "lpo": (False, False), "logo": (True, False), "leave_one_group_out": (True, False),
    "lpgo": (True, False), "repeated_kfold": (False, False), "repeated_stratified_kfold": (False, True),
    "shuffle_split": (False, False), "stratified_shuffle_split": (False, True), "group_shuffle_split": (True, False),
    "timeseries": (False, False), "walkthrough": (False, False), "walk_forward": (False, False),
    "walkforward": (False, False), "predefined": (False, False),
}


def _order(key: str, shuffle: bool, seed: int, repeat: int = 0):
    if shuffle:
        return [F.xxhash64(F.col(key), F.lit(seed), F.lit(repeat)), F.col(key)]
    return [F.col(key)]


def _positions(df: DataFrame, key: str, order, name="_tw_pos") -> DataFrame:
    return global_row_number(df.select(key, *[c for c in df.columns if c != key]), order, name)


def _kfold_of_position(pos, n, k):
    """sklearn KFold sizes: the first n % k folds hold n//k + 1 rows."""
    q, r = n // k, n % k
    big = r * (q + 1)
    p0 = pos - 1
    return F.when(p0 < big, F.floor(p0 / (q + 1))).otherwise(r + F.floor((p0 - big) / max(q, 1))).cast("int")


def _row_sized(folds: DataFrame) -> DataFrame:
    """A table with a row per input row, joined by a shuffle, each task holding its share of it: Spark judges it by the
    compressed file that its key comes from, far too small, and would send every key through the driver to all executors."""
    return folds.hint("shuffle_hash")


def kfold(df: DataFrame, key: str, n_splits: int = 5, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """C1 — (key, fold): contiguous blocks of the (hash-shuffled) key order."""
    B.require_key(df, key)
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    n = df.count()
    if n < n_splits:
        raise ValueError(f"cannot split {n} rows into {n_splits} folds")
    pos = _positions(df.select(key), key, _order(key, shuffle, seed))
    return _row_sized(pos.select(key, _kfold_of_position(F.col("_tw_pos"), n, n_splits).alias("fold")))


def stratified_kfold(df: DataFrame, key: str, label: str, n_splits: int = 5, shuffle: bool = True,
                     seed: int = 42) -> DataFrame:
    """C2 — (key, fold) with fold = (rank within class) mod k: every class is
    spread evenly over the folds.  Rank within class = global position in
    (class, order) minus the class's first position (class table is tiny)."""
    B.require_key(df, key)
    base = df.select(key, F.col(label).cast("string").alias("_tw_y"))
    pos = _positions(base, key, [F.col("_tw_y")] + _order(key, shuffle, seed))
    start = pos.groupBy("_tw_y").agg(F.min("_tw_pos").alias("_tw_start"))
    return _row_sized(pos.join(F.broadcast(start), "_tw_y")
                      .select(key, F.pmod(F.col("_tw_pos") - F.col("_tw_start"), F.lit(n_splits)).cast("int").alias("fold")))


def _greedy_deal(sizes, n_splits: int):
    """(size, position of its first group, [(start, folds)]) for (size, number of groups) in falling order of size.

    The groups of one size go one by one to the lightest fold (ties to the lowest).  With load = level·size + rest, that
    is the order of (level, rest, fold): the folds open at a level take turns, and only a fold's own level adds it to
    them.  So a size has at most ``n_splits`` runs; the r-th group of a run goes to folds[r mod length]."""
    load, before = [0] * n_splits, 0
    for size, count in sizes:
        at, runs, got = 0, [], [0] * n_splits
        levels = sorted({x // size for x in load})
        for i, level in enumerate(levels):
            turn = sorted((f for f in range(n_splits) if load[f] // size <= level), key=lambda f: (load[f] % size, f))
            n = count - at
            if i + 1 < len(levels):
                n = min(n, (levels[i + 1] - level) * len(turn))
            runs.append((at, turn))
            for j, f in enumerate(turn):
                got[f] += n // len(turn) + (j < n % len(turn))
            at += n
            if at == count:
                break
        load = [x + size * g for x, g in zip(load, got)]
        yield size, before, runs
        before += count


def group_kfold(df: DataFrame, key: str, group: str, n_splits: int = 5) -> DataFrame:
    """C3 — whole groups per fold; groups by size descending (ties by name) go to
    the lightest fold (greedy, ties to the lowest fold).  The driver gets the
    number of groups per size, at most sqrt(2·rows) rows; groups are numbered
    and given their fold in the tasks."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_tw_n"))
    per_size = sizes.groupBy("_tw_n").agg(F.count(F.lit(1)).alias("c")).collect()
    n_groups = sum(r["c"] for r in per_size)
    if n_groups < n_splits:
        raise ValueError(f"{n_groups} groups < {n_splits} folds")
    deal = df.sparkSession.createDataFrame(list(_greedy_deal(sorted((tuple(r) for r in per_size), reverse=True), n_splits)),
                                           "_tw_n long, _tw_first long, _tw_runs array<struct<start:long,folds:array<int>>>")
    ranked = global_row_number(sizes, [F.desc("_tw_n"), F.col(group).cast("string"), F.col(group)], "_tw_r")
    r = F.col("_tw_r") - 1 - F.col("_tw_first")
    amap = (ranked.join(F.broadcast(deal), "_tw_n").withColumn("_tw_r", r)
            .withColumn("_tw_run", F.element_at(F.filter("_tw_runs", lambda x: x["start"] <= F.col("_tw_r")), -1))
            .select(group, F.expr("_tw_run.folds[cast((_tw_r - _tw_run.start) % size(_tw_run.folds) AS int)]").alias("fold")))
    return df.select(key, group).join(amap, group).select(key, "fold")


def stratified_group_kfold(df: DataFrame, key: str, group: str, label: str, n_splits: int = 5) -> DataFrame:
    """C4 — whole groups per fold, every fold's class shares close to the overall ones.

    Groups with the same class counts are one kind.  Of a kind's groups, numbered by name, each fold gets the same
    number in turn; the fewer than ``n_splits`` left over go, kinds by falling size, to the fold that then leaves the
    classes spread most evenly over the folds (least mean deviation; ties to the lightest, then the lowest fold).  The driver gets
    one row per kind; groups are numbered and given their fold in the tasks.  A null label is a class."""
    counts = df.groupBy(group, F.col(label).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    groups = cut_lineage(counts.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("y", "n"))).alias("_tw_kind"), F.sum("n").alias("_tw_n")))
    kinds = [([(x["y"], x["n"]) for x in r["_tw_kind"]], r["c"]) for r in groups.groupBy("_tw_kind").agg(F.count(F.lit(1)).alias("c")).collect()]
    classes = sorted({y for kind, _ in kinds for y, _ in kind}, key=lambda y: (y is not None, y))
    at = {y: i for i, y in enumerate(classes)}
    overall = [0] * len(classes)
    for kind, c in kinds:
        for y, n in kind:
            overall[at[y]] += c * n
    load, deal = [[0] * len(classes) for _ in range(n_splits)], []

    def spread(fold, kind):
        """Mean over the classes of the standard deviation, over the folds, of a class's share in each."""
        added = {at[y]: n for y, n in kind}
        out = 0.0
        for j, all_of in enumerate(overall):
            part = [(load[f][j] + (added.get(j, 0) if f == fold else 0)) / all_of for f in range(n_splits)]
            m = sum(part) / n_splits
            out += math.sqrt(sum((x - m) ** 2 for x in part) / n_splits)
        return round(out / len(overall), 12)
    for kind, c in sorted(kinds, key=lambda k: (-sum(n for _, n in k[0]), [(at[y], n) for y, n in k[0]])):
        each, left = divmod(c, n_splits)
        folds = []
        for f in range(n_splits):
            for y, n in kind:
                load[f][at[y]] += each * n
        for _ in range(left):
            f = min(range(n_splits), key=lambda f: (spread(f, kind), sum(load[f]), f))  # noqa: B023
            folds.append(f)
            for y, n in kind:
                load[f][at[y]] += n
        deal.append((kind, each * n_splits, folds))
    table = df.sparkSession.createDataFrame(deal, "_tw_kind array<struct<y:string,n:bigint>>, _tw_even long, _tw_rest array<int>")
    ranked = global_row_number(groups, ["_tw_kind", F.col(group).cast("string"), F.col(group)], "_tw_r")
    start = ranked.groupBy("_tw_kind").agg(F.min("_tw_r").alias("_tw_first"))
    pos = F.col("_tw_r") - F.col("_tw_first")
    fold = F.when(pos < F.col("_tw_even"), F.pmod(pos, F.lit(n_splits)).cast("int")).otherwise(F.get("_tw_rest", (pos - F.col("_tw_even")).cast("int")))
    amap = ranked.join(table.join(start, "_tw_kind"), "_tw_kind").select(F.col(group).alias("_tw_g"), fold.alias("fold"))
    return df.select(key, group).join(cut_lineage(amap), F.col(group).eqNullSafe(F.col("_tw_g"))).select(key, "fold")


def leave_one_out(df: DataFrame, key: str) -> DataFrame:
    """C5 — (key, fold) with one fold per row (fold = key-order position − 1)."""
    pos = _positions(df.select(key), key, [F.col(key)])
    return pos.select(key, (F.col("_tw_pos") - 1).cast("long").alias("fold"))


def _combinations(items: DataFrame, column: str, p: int) -> DataFrame:
    """(split_id, column): every p-combination of the rows, numbered in lexicographic order of their positions."""
    if p < 1:
        raise ValueError("p must be at least 1")
    numbered = global_row_number(items.select(column), [F.col(column)], "_tw_pos").withColumn("_tw_pos", F.col("_tw_pos") - 1)
    n = numbered.count()
    rows = numbered.where(F.col("_tw_pos") <= n - p).select(F.col("_tw_pos").alias("_tw_c0"))
    for i in range(1, p):
        rows = rows.select("*", F.explode(F.sequence(F.col(f"_tw_c{i - 1}") + 1, F.lit(n - p + i).cast("long"))).alias(f"_tw_c{i}"))
    rank = f"{math.comb(n, p) - 1}L"
    for i in range(p):
        after = "1L"
        for t in range(1, p - i + 1):                          # C(n - 1 - c, p - i), whole at each step
            after = f"({after} * ({n - t}L - _tw_c{i}) div {t})"
        rank = f"{rank} - {after}"
    return (rows.select(F.expr(rank).alias("split_id"), F.explode(F.array(*[f"_tw_c{i}" for i in range(p)])).alias("_tw_pos"))
            .join(numbered, "_tw_pos").select("split_id", column))


def leave_p_out(df: DataFrame, key: str, p: int = 2) -> DataFrame:
    """C5 — (split_id, key) test sets of every p-subset: C(n, p) splits by
    definition, formed in the tasks from numbered keys."""
    return _combinations(df, key, p)


def leave_one_group_out(df: DataFrame, key: str, group: str) -> DataFrame:
    """C6 — (key, fold) with fold = rank of the group among sorted distinct groups."""
    groups = df.select(group).distinct()
    ranked = global_row_number(groups, [F.col(group)], "_tw_g")
    return (df.select(key, group).join(ranked, group)
            .select(key, (F.col("_tw_g") - 1).cast("int").alias("fold")))


def leave_p_groups_out(df: DataFrame, key: str, group: str, p: int = 2) -> DataFrame:
    """C6 — (split_id, group) test groups of every p-combination of groups; join
    to rows on the group for membership."""
    return _combinations(df.select(group).distinct(), group, p)


def repeated_kfold(df: DataFrame, key: str, n_splits: int = 5, n_repeats: int = 3, seed: int = 42,
                   label: str | None = None) -> DataFrame:
    """C7 — (key, repeat, fold); split_id = repeat·k + fold; stratified with ``label``."""
    parts = []
    for r in range(n_repeats):
        if label:
            f = stratified_kfold(df, key, label, n_splits, True, seed + r)
        else:
            n = df.count()
            pos = _positions(df.select(key), key, _order(key, True, seed, r))
            f = pos.select(key, _kfold_of_position(F.col("_tw_pos"), n, n_splits).alias("fold"))
        parts.append(f.withColumn("repeat", F.lit(r)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("split_id", F.col("repeat") * n_splits + F.col("fold"))


def shuffle_split(df: DataFrame, key: str, n_splits: int = 5, test_size: float = 0.2, seed: int = 42,
                  label: str | None = None, group: str | None = None) -> DataFrame:
    """C8 — long (key, split_id, role): per split the ceil(test_size·n) rows (or
    groups) first in hash order are test; with ``label`` per class."""
    unit = group or key
    base = df.select(key, *([group] if group and group != key else []), *([label] if label else []))
    units = base.select(unit).distinct() if group else base.select(unit, *([label] if label else []))
    split_ids = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    ex = units.select("*", split_ids.alias("split_id"))
    h = F.xxhash64(F.col(unit), F.lit(seed), F.col("split_id"))
    part = ["split_id"] + ([label] if label and not group else [])
    pos = global_row_number(ex, [*map(F.col, part), h, F.col(unit)], "_tw_pos")
    start = pos.groupBy(*part).agg(F.min("_tw_pos").alias("_tw_s"), F.count(F.lit(1)).alias("_tw_n"))
    ranked = pos.join(F.broadcast(start), part)
    test = (F.col("_tw_pos") - F.col("_tw_s")) < F.ceil(F.col("_tw_n") * F.lit(test_size))
    roles = ranked.select(unit, "split_id", F.when(test, "test").otherwise("train").alias("role"))
    if group:
        return base.select(key, group).join(roles, group).select(key, "split_id", "role")
    return roles


def to_long(folds: DataFrame, key: str, n_splits: int) -> DataFrame:
    """(key, fold) → (key, split_id, role) with role test where fold = split_id.
    A row with fold −1 (predefined 'never tested') is train in every split."""
    return (folds.select(key, "fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split_id"))
            .select(key, "split_id", F.when(F.col("fold") == F.col("split_id"), "test").otherwise("train").alias("role")))


def time_series_split(df: DataFrame, key: str, order_by, n_splits: int = 5) -> DataFrame:
    """C9 — expanding train, test blocks of n // (k + 1) rows in time order."""
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    n = df.count()
    t = n // (n_splits + 1)
    if t <= 0:
        raise ValueError("too few rows for the time series split")
    bounds = [(i, n - (n_splits - i) * t, n - (n_splits - i) * t, n - (n_splits - i - 1) * t) for i in range(n_splits)]
    return _positional_long(df, key, order_by, bounds)


def walk_forward(df: DataFrame, key: str, order_by, n_splits: int = 5, min_train_size: int | None = None,
                 gap: int = 0) -> DataFrame:
    """C10 — expanding window: train [0, m + i·t), test [m + i·t + gap, … + t)
    with m = min_train (default n // (k+1)), t = (n − m − gap) // k; t ≤ 0 raises."""
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    n = df.count()
    m = min_train_size or n // (n_splits + 1)
    t = (n - m - gap) // n_splits
    if t <= 0:
        raise ValueError(f"too few rows ({n}) for {n_splits} walk-forward splits")
    bounds = []
    for i in range(n_splits):
        te = m + i * t
        ts, tend = te + gap, te + gap + t
        if tend > n:
            break
        bounds.append((i, te, ts, tend))
    return _positional_long(df, key, order_by, bounds)


def _positional_long(df, key, order_by, bounds) -> DataFrame:
    """Rows at 0-based position p: train if p < train_end, test if in [ts, te)."""
    pos = global_row_number(df.select(key, *[c for c in order_by if c != key]), [*order_by, *([] if key in order_by else [key])], "_tw_pos")
    spec = df.sparkSession.createDataFrame(bounds, "split_id int, train_end long, test_start long, test_end long")
    p0 = F.col("_tw_pos") - 1
    # spec has one row per split (bounded by n_splits): broadcast, no shuffle of the data
    j = pos.select(key, "_tw_pos").crossJoin(F.broadcast(spec))
    role = F.when(p0 < F.col("train_end"), "train").when((p0 >= F.col("test_start")) & (p0 < F.col("test_end")), "test")
    return j.select(key, "split_id", role.alias("role")).where(F.col("role").isNotNull())


def predefined(df: DataFrame, key: str, fold_col: str) -> DataFrame:
    """C11 — the caller's fold column; −1 = never in a test set; missing raises."""
    if fold_col not in df.columns:
        raise KeyError(f"fold column '{fold_col}' not found")
    return df.select(key, F.col(fold_col).cast("int").alias("fold"))


def list_splits(spark, task: str | None = None, has_groups: bool | None = None) -> DataFrame:
    """C12 — split names filtered by task (classification-only ones need it) and groups."""
    rows = [(n, g, c) for n, (g, c) in SPLITS.items()]
    out = spark.createDataFrame(rows, "name string, requires_groups boolean, requires_classification boolean")
    if task == "regression":
        out = out.where(~F.col("requires_classification"))
    if has_groups is False:
        out = out.where(~F.col("requires_groups"))
    return out


def guard_group_folds(df: DataFrame, group: str, n_splits: int) -> tuple[int, bool]:
    """C13 — folds reduced to the number of groups; (n_splits, use_groups) with
    plain folds when fewer than two groups exist."""
    g = df.agg(F.countDistinct(group)).first()[0]
    if g < 2:
        return n_splits, False
    return min(n_splits, g), True
