"""DuckDB CTEs for numeric oracles: eigenvalues by matrix squaring, training unrolled.

``gram`` tables have (run, i, row): row i of a symmetric matrix of each run as a list.
"""

from __future__ import annotations

import re

import numpy as np

from prefsight.operators import train as tr
from prefsight.plans import sql_fn as S


def gram_cte(name: str, pairs: str, weights: str, dim: int) -> str:
    """Rows of mean[p(1-p) d d^T] for every run; ``weights`` has (run, w list)."""
    return f"""
{name}_s AS MATERIALIZED (
  SELECT r.run, p.d, {S.sigmoid("list_dot_product(p.d, r.w)")} AS pr FROM {pairs} p, {weights} r),
{name} AS MATERIALIZED (
  SELECT run, i, list(v ORDER BY j) AS row FROM (
    SELECT run, i.range AS i, j.range AS j, avg(pr * (1 - pr) * d[i.range + 1] * d[j.range + 1]) AS v
    FROM {name}_s, range({dim}) i, range({dim}) j GROUP BY run, i.range, j.range) GROUP BY run, i)"""


def dominant_cte(name: str, gram: str, matrix: str, squarings: int) -> str:
    """(run, value): Rayleigh quotient of ``gram`` on the dominant space of ``matrix``.

    Squaring a matrix of unit trace again and again leaves the projector on the space
    of its largest eigenvalue."""
    ctes, last = [], matrix
    for k in range(squarings):
        new = f"{name}_{k}"
        ctes.append(f"""
{new}_q AS MATERIALIZED (
  SELECT x.run, x.i, list(list_dot_product(x.row, y.row) ORDER BY y.i) AS row
  FROM {last} x JOIN {last} y ON y.run = x.run GROUP BY x.run, x.i),
{new} AS MATERIALIZED (
  SELECT q.run, q.i, list_transform(q.row, lambda v: v / t.t) AS row FROM {new}_q q
  JOIN (SELECT run, sum(row[i + 1]) AS t FROM {new}_q GROUP BY run) t ON t.run = q.run)""")
        last = new
    ctes.append(f"""
{name} AS MATERIALIZED (
  SELECT a.run, sum(list_dot_product(a.row, g.row)) AS value FROM {last} a
  JOIN {gram} g ON g.run = a.run AND g.i = a.i GROUP BY a.run)""")
    return ",".join(ctes)


def spectrum_ctes(gram: str, squarings: int = 30) -> str:
    """``top`` and ``bottom`` (run, value): the largest and the least eigenvalue; ``moments``: trace and squared norm."""
    return f"""{dominant_cte("top", gram, gram, squarings)},
{gram}_flip AS MATERIALIZED (
  SELECT g.run, g.i, list_transform(g.row, lambda v, k: CASE WHEN k = g.i + 1 THEN t.value - v ELSE -v END) AS row
  FROM {gram} g JOIN top t ON t.run = g.run),{dominant_cte("bottom", gram, gram + "_flip", squarings)},
moments AS MATERIALIZED (
  SELECT run, sum(row[i + 1]) AS trace, sum(list_dot_product(row, row)) AS sq FROM {gram} GROUP BY run)"""


def training_ctes(pairs: str, runs: list[tuple[str, int]], dim: int, steps: int, lr: float, warmup: int,
                  start: str | None = None, tag: str = "") -> str:
    """The training loop of all update rules, a CTE of (run, j, w, m, v) per step, ending in ``weights``.

    ``start`` is a table (run, w list) of weights to start from, of runs of the first
    run's rule; ``tag`` precedes the names of the CTEs, so that loops can follow each other."""
    cfg = tr.OPTIMIZER_DEFAULTS
    starts = ", ".join(f"({i}, '{o}', {s}, {S.list_lit(np.random.default_rng(s).standard_normal(dim) * 0.01)})"
                       for i, (o, s) in enumerate(runs))
    ctes = [f"""
runs AS (SELECT * FROM (VALUES {starts}) x(run, optimizer, seed, start)),
s0 AS MATERIALIZED (SELECT run, optimizer, j.range AS j, start[j.range + 1] AS w, 0.0e0 AS m, 0.0e0 AS v
                    FROM runs, range({dim}) j)"""]
    if start:
        ctes = [f"""
s0 AS MATERIALIZED (SELECT run, '{runs[0][0]}' AS optimizer, j.range AS j, w[j.range + 1] AS w, 0.0e0 AS m, 0.0e0 AS v
                    FROM {start}, range({dim}) j)"""]
    (a1, a2), eps, decay = cfg["adamw"]["betas"], S.dbl(cfg["adamw"]["eps"]), S.dbl(cfg["adamw"]["weight_decay"])
    sgd, muon, lion = cfg["sgd"], cfg["muon"], cfg["lion"]
    l1, l2 = lion["betas"]
    for k in range(steps):
        rate = S.dbl(tr.lr_at(k, lr, warmup, steps))
        lion_rate = S.dbl(tr.lr_at(k, lr, warmup, steps) * lion["lr_scale"])
        c1, c2 = S.dbl(1 - a1 ** (k + 1)), S.dbl(1 - a2 ** (k + 1))
        first = "g" if k == 0 else f"{S.dbl(sgd['momentum'])} * m + g"
        ctes.append(f"""
w{k} AS MATERIALIZED (SELECT run, list(w ORDER BY j) AS w FROM s{k} GROUP BY run),
p{k} AS MATERIALIZED (SELECT r.run, p.d, list_dot_product(p.d, r.w) AS mg FROM {pairs} p, w{k} r),
g{k} AS MATERIALIZED (SELECT run, j.range AS j, avg(-(1 - {S.sigmoid('mg')}) * d[j.range + 1]) AS g
                      FROM p{k}, range({dim}) j GROUP BY run, j.range),
c{k} AS MATERIALIZED (SELECT g.run, g.j, CASE WHEN n.norm > {S.dbl(tr.GRAD_CLIP)} THEN g.g * ({S.dbl(tr.GRAD_CLIP)} / n.norm) ELSE g.g END AS g
                      FROM g{k} g JOIN (SELECT run, sqrt(sum(g * g)) AS norm FROM g{k} GROUP BY run) n ON n.run = g.run),
d{k} AS MATERIALIZED (
  SELECT s.run, s.optimizer, s.j, s.v, CASE WHEN s.optimizer = 'adamw' THEN s.w - {rate} * {decay} * s.w ELSE s.w END AS w, s.m,
         CASE WHEN s.optimizer = 'sgd' THEN c.g + {S.dbl(sgd['weight_decay'])} * s.w ELSE c.g END AS g
  FROM s{k} s JOIN c{k} c ON c.run = s.run AND c.j = s.j),
m{k} AS MATERIALIZED (
  SELECT run, optimizer, j, w, g,
         CASE optimizer WHEN 'sgd' THEN {first} WHEN 'muon' THEN {S.dbl(muon['momentum'])} * m + g
                        WHEN 'lion' THEN {S.dbl(l2)} * m + {S.dbl(1 - l2)} * g
                        ELSE {S.dbl(a1)} * m + {S.dbl(1 - a1)} * g END AS m,
         {S.dbl(a2)} * v + {S.dbl(1 - a2)} * g * g AS v,
         {S.dbl(l1)} * m + {S.dbl(1 - l1)} * g AS c FROM d{k}),
u{k} AS MATERIALIZED (
  SELECT *, g + {S.dbl(muon['momentum'])} * m AS u,
         sqrt(sum((g + {S.dbl(muon['momentum'])} * m) * (g + {S.dbl(muon['momentum'])} * m)) OVER (PARTITION BY run)) AS un FROM m{k}),
s{k + 1} AS MATERIALIZED (
  SELECT run, optimizer, j, m, v,
         CASE optimizer WHEN 'sgd' THEN w - {rate} * (g + {S.dbl(sgd['momentum'])} * m)
                        WHEN 'muon' THEN w - {rate} * u / greatest(un, 1e-12)
                        WHEN 'lion' THEN w - {lion_rate} * (sign(c) + {S.dbl(lion['weight_decay'])} * w)
                        ELSE w - {rate} * (m / {c1}) / (sqrt(v / {c2}) + {eps}) END AS w FROM u{k})""")
    ctes.append(f"""
weights AS MATERIALIZED (SELECT run, list(w ORDER BY j) AS w FROM s{steps} GROUP BY run)""")
    made = ",".join(ctes)
    return re.sub(r"\b([swpgcdmu]\d+|weights)\b(?=[\s),]|$)", lambda x: tag + x.group(0), made) if tag else made
