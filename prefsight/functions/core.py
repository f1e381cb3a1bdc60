"""Column-level helpers, all JVM-side expressions.  Scalar ones are compiled with
their stage; the lambdas over arrays (``dot``, ``sq_norm``, ``vec_sub``) are evaluated
element by element by Spark's array functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Calibration uses ten bins [lo, hi) on numpy.linspace(0, 1, 11).
# Three interior edges are not the decimal literals one would type, so the
# edges are taken from linspace itself rather than written by hand.
N_BINS = 10
BIN_EDGES = [float(x) for x in np.linspace(0.0, 1.0, N_BINS + 1)]

# Python's str.strip() removes Unicode whitespace plus the ASCII separators
# \x1c-\x1f; Spark's trim() removes only spaces.
_PY_STRIP_RE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(m) -> Column:
    m = col_(m)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-m))


def softplus_neg(m) -> Column:
    """-log(sigmoid(m)) in the overflow-free form max(-m, 0) + log1p(exp(-|m|))."""
    m = col_(m)
    return F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))


def safe_div(num, den, default=None) -> Column:
    """num / den, or ``default`` (NULL when None) where den is 0 or NULL.

    ANSI mode raises on division by zero; this keeps queries total."""
    num, den = col_(num), col_(den)
    fallback = F.lit(default) if default is not None else F.lit(None).cast("double")
    return F.when(den.isNull() | (den == 0), fallback).otherwise(num.cast("double") / den)


def ieee_div(num, den) -> Column:
    """num / den of doubles as IEEE 754 and the DuckDB twins have it: over zero infinite, 0 / 0 NaN.

    ANSI mode raises on division by zero."""
    num, den = col_(num), col_(den)
    return F.when(den == 0, num * F.pow(den, F.lit(-1.0))).otherwise(F.try_divide(num, den))


def py_strip(c) -> Column:
    """Python ``str.strip()`` with no arguments."""
    return F.regexp_replace(col_(c), _PY_STRIP_RE, "")


def hash_key(seed, *cols) -> Column:
    """Deterministic 60-bit non-negative key from md5(seed|c1|c2...).

    The DuckDB twin is ``('0x' || substr(md5(concat_ws('|', ...)), 1, 15))::BIGINT``.
    """
    parts = [F.lit(str(seed))] + [col_(c).cast("string") for c in cols]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def calibration_bin(p, close_top: bool = False) -> Column:
    """Bin index 0..9 for probability p using [lo, hi) bins; NULL when p is in
    no bin (p >= 1.0, p < 0 or NaN) -- such rows still count in the total.
    ``close_top=True`` makes the last bin [0.9, 1.0] so p == 1.0 is binned."""
    p = col_(p)
    expr = None
    for b in range(N_BINS):
        hi_ok = (p <= F.lit(BIN_EDGES[b + 1])) if (close_top and b == N_BINS - 1) \
            else (p < F.lit(BIN_EDGES[b + 1]))
        cond = (p >= F.lit(BIN_EDGES[b])) & hi_ok
        expr = F.when(cond, F.lit(b)) if expr is None else expr.when(cond, F.lit(b))
    return expr


def dot(a, b) -> Column:
    """Dot product of two equal-length numeric arrays (left-to-right sum)."""
    a, b = col_(a), col_(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def vec_sub(a, b) -> Column:
    a, b = col_(a), col_(b)
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def sq_norm(a) -> Column:
    a = col_(a)
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def lit_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def double_literal_sql(x: float) -> str:
    """DuckDB literal that parses to exactly the double ``x``."""
    if x == float("inf"):
        return "CAST('inf' AS DOUBLE)"
    return f"CAST({x!r} AS DOUBLE)" if "e" in repr(x) else f"{x!r}e0"
