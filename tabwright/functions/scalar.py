"""Scalar column functions (F1–F18).  All are JVM expressions — no Python UDFs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def log_transform(c, offset: float = 1.0) -> Column:
    """F1 — log1p(x + max(0, offset − 1))."""
    return F.log1p(_c(c) + F.lit(max(0.0, float(offset) - 1.0)))


def inverse_log_transform(c, offset: float = 1.0) -> Column:
    """F1 inverse — expm1(x) − max(0, offset − 1)."""
    return F.expm1(_c(c)) - F.lit(max(0.0, float(offset) - 1.0))


def periodic(c, period: float) -> tuple[Column, Column]:
    """F2 — (sin, cos) of 2πx/period."""
    a = F.lit(2 * math.pi) * _c(c) / F.lit(float(period))
    return F.sin(a), F.cos(a)


DATE_PARTS = ["year", "month", "day", "hour", "minute", "dayofweek", "dayofyear", "weekofyear",
              "quarter", "is_weekend", "is_month_start", "is_month_end"]


def date_part(c, part: str) -> Column:
    """F3 — one calendar part; dayofweek is Monday=0, weekofyear ISO."""
    x = _c(c)
    parts = {
        "year": F.year(x), "month": F.month(x), "day": F.dayofmonth(x), "hour": F.hour(x),
        "minute": F.minute(x), "dayofweek": F.weekday(x), "dayofyear": F.dayofyear(x),
        "weekofyear": F.weekofyear(x), "quarter": F.quarter(x),
        "is_weekend": (F.weekday(x) >= 5).cast("int"),
        "is_month_start": (F.dayofmonth(x) == 1).cast("int"),
        "is_month_end": (F.to_date(x) == F.last_day(x)).cast("int"),
    }
    if part not in parts:
        raise ValueError(f"unknown date part: {part}")
    return parts[part]


CYCLIC = {"month": ("month", 12), "hour": ("hour", 24), "dayofweek": ("dow", 7)}


def try_parse_timestamp(c) -> Column:
    """F5 — timestamp or NULL when the text does not parse."""
    return F.try_to_timestamp(_c(c).cast("string"))


def to_number(c) -> Column:
    """F6 — numeric coercion, bad values → NULL."""
    return F.nanvl(_c(c).try_cast("double"), F.lit(None).cast("double"))


def strip_non_alnum(c) -> Column:
    """F7 — lower-cased text without non-alphanumerics (name comparisons)."""
    return F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]", "")


# Molecule-string alphabet used by the type detector.
MOLECULE_ALPHABET_PATTERN = r"^[BCNOFPSIclbrnosp()=#@+\-\[\]\\/%0-9]{1,2000}$"
MOLECULE_ATOM_PATTERN = r"[BNOFPSClrIbcnosp]"


def looks_like_molecule(c) -> Column:
    """F8 — text uses only the molecule alphabet (1–2000 chars) and has an atom
    symbol; like a parser-backed check, 1–2 letter words ("F", "Br") are not
    taken as molecules."""
    x = _c(c).cast("string")
    short_word = (F.length(x) < 3) & x.rlike("^[A-Za-z]+$")
    return x.rlike(MOLECULE_ALPHABET_PATTERN) & x.rlike(MOLECULE_ATOM_PATTERN) & ~short_word


def has_polymer_marker(c) -> Column:
    """F9 — the string carries a '*' attachment point."""
    return _c(c).contains("*")


def cap_polymer(c) -> Column:
    """F9 — replace [*:n], [*] and bare * with [CH3], in that order."""
    x = F.regexp_replace(_c(c), r"\[\*:\d+\]", "[CH3]")
    x = F.regexp_replace(x, r"\[\*\]", "[CH3]")
    return F.regexp_replace(x, r"(?<!\[CH3)\*", "[CH3]")


def ionisation_state(pka_acidic, pka_basic, ph: float = 7.4) -> Column:
    """F10 — zwitterion / anion / cation / neutral / unknown from pKa values at pH."""
    a, b = _c(pka_acidic), _c(pka_basic)
    acid = a.isNotNull() & (a < F.lit(ph))
    base = b.isNotNull() & (b > F.lit(ph))
    return (F.when(a.isNull() & b.isNull(), F.lit("unknown"))
            .when(acid & base, F.lit("zwitterion"))
            .when(acid, F.lit("anion"))
            .when(base, F.lit("cation"))
            .otherwise(F.lit("neutral")))


def spin_arguments(multiplicity, charge) -> tuple[Column, Column]:
    """F11 — uhf = multiplicity − 1 and a validity flag (multiplicity ≥ 1, |charge| ≤ 10)."""
    m, q = _c(multiplicity), _c(charge)
    return m - 1, (m >= 1) & (q >= -10) & (q <= 10)


def desirability(pred, direction: str = "maximize", lo: float | None = None, hi: float | None = None) -> Column:
    """F12 — maximize: p; minimize: −p; range: exp(−½((p − centre)/half)²)."""
    p = _c(pred)
    if direction == "maximize":
        return p
    if direction == "minimize":
        return -p
    if direction == "range":
        if lo is None or hi is None:
            raise ValueError("range desirability needs both bounds")
        centre, half = (lo + hi) / 2.0, max((hi - lo) / 2.0, 1e-12)
        return F.exp(F.lit(-0.5) * F.pow((p - F.lit(centre)) / F.lit(half), 2))
    raise ValueError(f"unknown direction: {direction}")


def sigmoid(c) -> Column:
    """F13 — 1/(1+e^−x)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(c)))


def softmax(arr) -> Column:
    """F13 — softmax over an array column (max-shifted)."""
    a = _c(arr)
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def clip(c, lo=None, hi=None) -> Column:
    """F16 — least(greatest(c, lo), hi), NULL kept."""
    x = _c(c)
    if lo is not None:
        x = F.greatest(x, F.lit(lo))
    if hi is not None:
        x = F.least(x, F.lit(hi))
    return F.when(_c(c).isNull(), _c(c)).otherwise(x)


def array_charge_summary(arr) -> dict:
    """F17 — max, min, range, population std and mean |q| of a numeric array column."""
    a = _c(arr)
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / n
    var = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / n
    return {"max": F.array_max(a), "min": F.array_min(a), "range": F.array_max(a) - F.array_min(a),
            "std": F.sqrt(var), "mean_abs": F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.abs(x)) / n}


def json_field(c, path: str) -> Column:
    """F18 — one field of a JSON text column."""
    return F.get_json_object(_c(c), path)
