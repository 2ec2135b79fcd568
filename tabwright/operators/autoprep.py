"""Kind-routed preprocessing (E20–E23): detected column kinds → imputer +
scaler/encoder per group, fitted layer by layer (imputer statistics in one
aggregate, then scaler statistics on the imputed expressions in one more).

Output columns are named ``<group>__<feature>`` like a column transformer
with verbose names; the transform is one lazy projection (plus joins only for
high-cardinality maps)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators import prep as P
from tabwright.operators.kinds import detect_column_types


@dataclass
class PreprocessConfig:
    numeric_scaler: str = "auto"
    cat_low_encoder: str = "onehot"
    cat_high_encoder: str = "ordinal"
    numeric_imputer: str = "mean"
    categorical_imputer: str = "most_frequent"
    add_missing_indicator: bool = False
    binary_imputer: str = "most_frequent"
    onehot_drop: str | None = "first"
    onehot_max_categories: int | None = None
    power_method: str = "yeo-johnson"
    quantile_n_quantiles: int = 1000
    periodic_periods: dict = field(default_factory=dict)
    passthrough_cols: list = field(default_factory=list)
    exclude_smiles: bool = True
    exclude_datetime: bool = True
    exclude_constant: bool = True


ENCODERS = ("onehot", "ordinal", "target", "binary", "woe", "leaveoneout", "hashing")
_NUMERIC_ROUTE = {"numeric_normal": ("num_normal", None), "numeric_log": ("num_log", "log_standard"),
                  "numeric_power": ("num_power", "power"), "numeric_outlier": ("num_outlier", "robust")}


@dataclass
class Step:
    group: str
    columns: list
    models: list          # applied in order; each maps the group's columns


@dataclass
class AutoPreprocessModel:
    steps: list
    passthrough: list
    keep: list

    def transform(self, df: DataFrame) -> DataFrame:
        """Chain the group transforms on the full frame; consecutive projections
        collapse into one ``Project`` (joins appear only for large maps)."""
        cur = df
        final = []
        for st in self.steps:
            before = set(cur.columns) - set(st.columns)
            for m in st.models:
                cur = m.transform(cur, keep_other=True)
            produced = [c for c in cur.columns if c not in before]
            ren = {c: f"{st.group}__{c}" for c in produced}
            cur = cur.select(*[F.col(c).alias(ren.get(c, c)) for c in cur.columns])
            final += [ren[c] for c in produced]
        return cur.select(*self.keep, *final, *[F.col(c).alias(f"passthrough__{c}") for c in self.passthrough])


class AutoPreprocessor:
    """E22 — route by detected kind: NORMAL → configured scaler, LOG → log +
    standard, POWER → power transform, OUTLIER → robust, BINARY → most-frequent
    impute + ordinal, CATEGORY_LOW → impute + one-hot (or configured),
    CATEGORY_HIGH → impute + ordinal (or configured), PERIODIC → mean impute +
    sin/cos.  Target, molecule, datetime and constant columns are excluded;
    text is dropped; nothing routed → first column passes through."""

    def __init__(self, config: PreprocessConfig | None = None):
        self.config = config or PreprocessConfig()

    def fit(self, df: DataFrame, target: str | None = None, profile: DataFrame | None = None,
            key: str | None = None, keep=()) -> AutoPreprocessModel:
        cfg = self.config
        skip = set(keep) | ({key} if key else set())
        side = {}
        profile = profile if profile is not None else detect_column_types(
            df, key=key, columns=[c for c in df.columns if c not in skip], stats_out=side)
        vcounts = side.get("value_counts", {})
        types = dict(df.dtypes)
        kinds = {r["col_name"]: r["col_type"] for r in profile.collect()}
        exclude = set(cfg.passthrough_cols) | set(keep)
        if key:
            exclude.add(key)
        if target:
            exclude.add(target)
        for k, flag in (("smiles", cfg.exclude_smiles), ("datetime", cfg.exclude_datetime),
                        ("constant", cfg.exclude_constant)):
            if flag:
                exclude |= {c for c, t in kinds.items() if t == k}
        by = {}
        for c, t in kinds.items():
            if c not in exclude:
                by.setdefault(t, []).append(c)
        steps = []
        cur = df
        for kind, (group, scaler) in _NUMERIC_ROUTE.items():
            cols = by.get(kind, [])
            if not cols:
                continue
            sc = scaler or cfg.numeric_scaler
            fast = _numeric_fast_path(cur, cols, cfg, sc)
            if fast is not None:
                steps.append(Step(group, cols, list(fast)))
                continue
            imp = P.Imputer(cfg.numeric_imputer, add_indicator=cfg.add_missing_indicator).fit(cur, cols)
            imputed = imp.transform(cur.select(*cols))
            if sc == "power":
                m2 = P.PowerTransformer(cfg.power_method).fit(imputed, cols)
            elif sc in ("quantile_normal", "quantile_uniform"):
                m2 = P.QuantileTransformer(cfg.quantile_n_quantiles, sc.split("_")[1]).fit(imputed, cols)
            elif sc == "power_yj":
                m2 = P.PowerTransformer("yeo-johnson").fit(imputed, cols)
            elif sc == "power_bc":
                m2 = P.PowerTransformer("box-cox").fit(imputed, cols)
            elif sc == "log":
                m2 = P.Scaler("log_standard").fit(imputed, cols)
            else:
                m2 = P.Scaler(sc).fit(imputed, cols)
            steps.append(Step(group, cols, [imp, m2]))
        if by.get("binary"):
            cols = by["binary"]
            if cfg.binary_imputer == "most_frequent" and all(types[c] == "string" and c in vcounts for c in cols):
                imp = P.ImputerModel({c: _mode(vcounts[c]) for c in cols}, cols)
                enc = _inline_ordinal(cols, vcounts)
            else:
                imp = P.Imputer(cfg.binary_imputer).fit(df, cols)
                enc = P.fit_ordinal(imp.transform(df.select(*cols)), cols)
            steps.append(Step("binary", cols, [imp, enc]))
        for kind, group, enc_name in (("category_low", "cat_low", cfg.cat_low_encoder),
                                      ("category_high", "cat_high", cfg.cat_high_encoder)):
            cols = by.get(kind, [])
            if not cols:
                continue
            known = all(types[c] == "string" and c in vcounts for c in cols)
            if known and cfg.categorical_imputer == "most_frequent" and enc_name in ("onehot", "ordinal") \
                    and not cfg.onehot_max_categories and max(len(vcounts[c]) for c in cols) <= P.INLINE_CATEGORY_LIMIT:
                imp = P.ImputerModel({c: _mode(vcounts[c]) for c in cols}, cols)
                if enc_name == "onehot":
                    enc = P.OneHotModel({c: sorted(str(v) for v, _ in vcounts[c]) for c in cols},
                                        cfg.onehot_drop == "first", {}, cols)
                else:
                    enc = _inline_ordinal(cols, vcounts)
                steps.append(Step(group, cols, [imp, enc]))
                continue
            imp = P.Imputer(cfg.categorical_imputer).fit(df, cols)
            filled = imp.transform(df.select(*cols, *([target] if target else [])))
            if enc_name == "onehot":
                enc = P.OneHotEncoder(cfg.onehot_drop, cfg.onehot_max_categories).fit(filled, cols)
            elif enc_name == "target" and target:
                enc = P.fit_target_encoder(filled, cols, target)
            elif enc_name == "binary":
                enc = P.fit_binary_encoder(filled, cols)
            elif enc_name == "woe" and target:
                enc = P.fit_woe(filled, cols, target)
            elif enc_name == "leaveoneout" and target:
                enc = P.fit_leave_one_out(filled, cols, target)
            elif enc_name == "hashing":
                enc = P.fit_hashing(filled, cols)
            elif enc_name == "ordinal":
                enc = P.fit_ordinal(filled, cols)
            elif enc_name in ("target", "woe", "leaveoneout"):
                raise ValueError(f"encoder {enc_name!r} needs a target")
            else:
                raise ValueError(f"unknown encoder {enc_name!r}")
            steps.append(Step(group, cols, [imp, enc]))
        for c in by.get("periodic", []):
            steps.append(Step(f"periodic_{c}", [c], [P.fit_periodic(df, [c], cfg.periodic_periods)]))
        passthrough = [c for c in cfg.passthrough_cols if c in kinds]
        if not steps and not passthrough:
            if not kinds:
                raise ValueError("no columns to preprocess")
            passthrough = [next(iter(kinds))]
        return AutoPreprocessModel(steps, passthrough, list(keep))


def _mode(pairs):
    """Most frequent value; ties go to the smallest value."""
    return min(pairs, key=lambda vc: (-vc[1], vc[0]))[0] if pairs else None


def _inline_ordinal(cols, vcounts) -> P.MapModel:
    """Ordinal codes from already-known value counts (sorted levels, unknown −1)."""
    inline = {c: {str(v): (float(i),) for i, v in enumerate(sorted(str(x) for x, _ in vcounts[c]))} for c in cols}
    return P.MapModel({}, {c: [(c, "code")] for c in cols}, {c: -1.0 for c in cols}, inline, list(cols))


def _numeric_fast_path(df: DataFrame, cols, cfg: PreprocessConfig, scaler: str):
    """Mean imputation followed by standard / minmax / maxabs / none scaling in
    ONE aggregate: mean imputation keeps the mean, min, max and max |x|, and
    shrinks the population variance by the observed share."""
    if cfg.numeric_imputer != "mean" or cfg.add_missing_indicator:
        return None
    kind = "standard" if scaler == "auto" else scaler
    if kind not in ("standard", "minmax", "maxabs", "none"):
        return None
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        v = P._v(c)
        aggs += [F.avg(v).alias(f"{c}__m"), F.count(v).alias(f"{c}__nn"), F.var_pop(v).alias(f"{c}__v"),
                 F.min(v).alias(f"{c}__lo"), F.max(v).alias(f"{c}__hi"), F.max(F.abs(v)).alias(f"{c}__ma")]
    r = df.agg(*aggs).first()
    fills = {c: r[f"{c}__m"] for c in cols}
    imp = P.ImputerModel(fills, list(cols))
    params = {}
    for c in cols:
        m, nn, n = r[f"{c}__m"] or 0.0, r[f"{c}__nn"] or 0, r["_n"] or 1
        if kind == "standard":
            var = (r[f"{c}__v"] or 0.0) * nn / n
            sd = var ** 0.5
            params[c] = (m, sd if sd else 1.0)
        elif kind == "minmax":
            lo, hi = r[f"{c}__lo"], r[f"{c}__hi"]
            params[c] = (lo or 0.0, (hi - lo) if lo is not None and hi != lo else 1.0)
        elif kind == "maxabs":
            params[c] = (r[f"{c}__ma"] or 1.0,)
        else:
            params[c] = ()
    return imp, P.ScalerModel(kind, params, list(cols))


def auto_preprocess(df: DataFrame, target: str | None = None, config: PreprocessConfig | None = None,
                    key: str | None = None, keep=()) -> DataFrame:
    return AutoPreprocessor(config).fit(df, target, key=key, keep=keep).transform(df)


@dataclass
class ColPreprocessConfig:
    override_types: dict = field(default_factory=dict)
    numeric_imputer: str = "mean"
    numeric_scaler: str = "standard"
    cat_low_encoder: str = "onehot"
    cat_high_encoder: str = "ordinal"
    binary_encoder: str = "ordinal"
    binary_imputer: str = "most_frequent"
    categorical_imputer: str = "most_frequent"
    add_missing_indicator: bool = False
    onehot_drop: str | None = "first"
    onehot_max_categories: int | None = None
    quantile_n_quantiles: int = 1000


_GROUP_OF_KIND = {"numeric_normal": "numeric", "numeric_log": "numeric", "numeric_power": "numeric",
                  "numeric_outlier": "numeric", "category_low": "category_low", "category_high": "category_high",
                  "binary": "binary"}


def fit_column_preprocess(df: DataFrame, config: ColPreprocessConfig | None = None, target: str | None = None,
                          key: str | None = None, keep=()) -> AutoPreprocessModel:
    """E23 — group columns into numeric / category_low / category_high / binary /
    passthrough (per-column overrides win; unlisted kinds pass through); one
    imputer + scaler for all numerics, the configured encoders for the others.
    Nothing left to process raises."""
    cfg = config or ColPreprocessConfig()
    skip = set(keep) | ({key} if key else set()) | ({target} if target else set())
    cols = [c for c in df.columns if c not in skip]
    prof = {r["col_name"]: r["col_type"] for r in detect_column_types(df, key=key, columns=cols).collect()}
    groups = {g: [] for g in ("numeric", "category_low", "category_high", "binary", "passthrough")}
    for c in cols:
        g = cfg.override_types.get(c)
        if g not in groups:
            g = _GROUP_OF_KIND.get(prof.get(c), "passthrough")
        groups[g].append(c)
    if not any(groups.values()):
        raise ValueError("no columns to preprocess")
    auto = PreprocessConfig(numeric_scaler=cfg.numeric_scaler, numeric_imputer=cfg.numeric_imputer,
                            categorical_imputer=cfg.categorical_imputer, add_missing_indicator=cfg.add_missing_indicator,
                            onehot_drop=cfg.onehot_drop, onehot_max_categories=cfg.onehot_max_categories,
                            quantile_n_quantiles=cfg.quantile_n_quantiles, cat_low_encoder=cfg.cat_low_encoder,
                            cat_high_encoder=cfg.cat_high_encoder, passthrough_cols=groups["passthrough"])
    kinds = {}
    for c in groups["numeric"]:
        kinds[c] = "numeric_normal"
    for g in ("category_low", "category_high"):
        for c in groups[g]:
            kinds[c] = g
    for c in groups["binary"]:
        kinds[c] = "binary" if cfg.binary_encoder == "ordinal" else "passthrough_binary"
    for c in groups["passthrough"]:
        kinds[c] = "passthrough"
    spark = df.sparkSession
    profile = spark.createDataFrame([(c, k) for c, k in kinds.items()] or [("", "")], "col_name string, col_type string") \
        .where(F.col("col_name") != "")
    m = AutoPreprocessor(auto).fit(df, target, profile=profile, key=key, keep=keep)
    renamed = []
    for st in m.steps:
        st.group = {"num_normal": "numeric"}.get(st.group, st.group)
        renamed.append(st)
    m.steps = renamed
    m.passthrough = groups["passthrough"] + [c for c in groups["binary"] if cfg.binary_encoder != "ordinal"]
    return m
