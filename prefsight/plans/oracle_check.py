"""Side-by-side check of a registered query against its DuckDB oracle SQL.

Mirrors the driver's gate: row count, column names, and an order-insensitive
comparison of values (columns sorted by name, rows sorted)."""

from __future__ import annotations

import math

from prefsight.sources.tables import TABLE_NAMES


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(rows, key=repr)


_DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                  "BOOLEAN": "boolean", "FLOAT": "float", "SMALLINT": "smallint", "DATE": "date",
                  "TIMESTAMP": "timestamp_ntz", "HUGEINT": "hugeint", "TINYINT": "tinyint"}


def type_mismatches(sdf, rel) -> list:
    """Columns whose Spark and DuckDB types differ (by name)."""
    s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    bad = []
    for name, t in zip(rel.columns, rel.types):
        dt = _DUCK_TO_SPARK.get(str(t), str(t).lower())
        if s_types.get(name) != dt:
            bad.append((name, s_types.get(name), str(t)))
    return bad


def compare(spark, spec, sf_dir: str, con=None) -> dict:
    con = con or duck_connection(sf_dir)
    sdf = spec.run(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    out = {"name": spec.name, "spark_rows": len(s_rows)}
    if spec.sql is None:
        out["status"] = "rows-only"
        return out
    rel = con.sql(spec.sql)
    out["type_mismatches"] = type_mismatches(sdf, rel)
    o_cols = rel.columns
    o_rows = rel.fetchall()
    out["oracle_rows"] = len(o_rows)
    out["cols_match"] = sorted(s_cols) == sorted(o_cols)
    if not out["cols_match"]:
        out["status"] = f"COLS spark={sorted(s_cols)} oracle={sorted(o_cols)}"
        return out
    a, b = _rows(s_cols, s_rows), _rows(o_cols, o_rows)
    if a == b:
        out["status"] = "match"
    else:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out["status"] = "MISMATCH"
        out["examples"] = bad
    return out
