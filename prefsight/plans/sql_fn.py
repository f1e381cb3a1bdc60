"""DuckDB expression snippets mirroring ``prefsight.functions``."""

from __future__ import annotations

from prefsight.functions.core import BIN_EDGES, N_BINS, double_literal_sql


def sigmoid(x: str) -> str:
    return f"(1.0e0 / (1.0e0 + exp(-({x}))))"


def softplus_neg(x: str) -> str:
    return f"(greatest(-({x}), 0.0e0) + ln(1.0e0 + exp(-abs({x}))))"


def bin_case(p: str) -> str:
    parts = []
    for b in range(N_BINS):
        lo, hi = double_literal_sql(BIN_EDGES[b]), double_literal_sql(BIN_EDGES[b + 1])
        parts.append(f"WHEN {p} >= {lo} AND {p} < {hi} THEN {b}")
    return "(CASE " + " ".join(parts) + " END)"


def hash_key(seed, *cols: str) -> str:
    inner = ", ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"(('0x' || substr(md5(concat_ws('|', {inner})), 1, 15))::BIGINT)"


def dbl(x: float) -> str:
    return double_literal_sql(float(x))


def list_lit(values) -> str:
    return "[" + ", ".join(dbl(v) for v in values) + "]"


# Python str.isspace() characters, spelled out for RE2 (whose \s is ASCII-only).
_PY_WS = (r"\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
          r"\x{202F}\x{205F}\x{3000}")


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_PY_WS}]+|[{_PY_WS}]+$', '', 'g')"


WS_SPLIT = r"[ \t\n\r\f\x0B]+"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS_SPLIT}'), lambda tk: length(tk) > 0)"
