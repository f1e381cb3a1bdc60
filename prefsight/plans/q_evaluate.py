"""EVL-* queries over the v_margins / v_scores views."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefsight.operators import evaluate as ev
from prefsight.plans import sql_fn as S
from prefsight.plans.registry import query
from prefsight.sources import views as V

_P = S.sigmoid("margin")
_CAL_BASE = f"""
SELECT grp, margin, p, y, {S.bin_case('p')} AS bin FROM (
  SELECT grp, margin, {_P} AS p, {{y}} AS y FROM v_margins)
"""
_Y_CHOSEN = "1.0e0"
_Y_SIGN = "CASE WHEN margin > 0 THEN 1.0e0 ELSE 0.0e0 END"


def _cal_sql(y: str) -> list[tuple[str, str]]:
    return [("cal", _CAL_BASE.format(y=y)),
            ("per_bin", "SELECT grp, bin, count(*) AS c, avg(p) AS conf, avg(y) AS acc "
                        "FROM cal WHERE bin IS NOT NULL GROUP BY grp, bin"),
            ("tot", "SELECT grp, count(*) AS n, avg(CASE WHEN margin > 0 THEN 1.0e0 ELSE 0.0e0 END) "
                    "AS accuracy, avg((p - y) * (p - y)) AS brier, avg(margin) AS mean_margin, "
                    f"avg({S.softplus_neg('margin')}) AS loss FROM cal GROUP BY grp"),
            ("ece_t", "SELECT t.grp, t.n, t.accuracy, t.brier, t.mean_margin, t.loss, "
                      "coalesce(sum(abs(pb.conf - pb.acc) * pb.c), 0) / t.n AS ece, "
                      "coalesce(max(abs(pb.conf - pb.acc)), 0.0e0) AS mce "
                      "FROM tot t LEFT JOIN per_bin pb ON pb.grp = t.grp "
                      "GROUP BY t.grp, t.n, t.accuracy, t.brier, t.mean_margin, t.loss")]


@query("evl_accuracy", """
SELECT grp, coalesce(avg(CASE WHEN margin > 0 THEN 1.0e0 ELSE 0.0e0 END), 0.0e0) AS accuracy
FROM v_margins GROUP BY grp
""", rnd=["accuracy"])
def evl_accuracy(t):
    """EVL-1: share of pairs with margin > 0, per group."""
    return ev.accuracy(V.v_margins(t), ["grp"])


@query("evl_ece", "SELECT grp, n, ece FROM ece_t", rnd=["ece"], extra_ctes=_cal_sql(_Y_CHOSEN))
def evl_ece(t):
    """EVL-2: 10-bin expected calibration error, label = chosen (1), one pass."""
    return ev.expected_calibration_error(V.v_margins(t), ["grp"])


@query("evl_reliability", f"""
SELECT grp, bin, count(*) AS n, avg(p) AS mean_conf, avg(y) AS mean_acc,
       abs(avg(p) - avg(y)) AS gap
FROM ({_CAL_BASE.format(y=_Y_CHOSEN)}) c WHERE bin IS NOT NULL GROUP BY grp, bin
""", rnd=["mean_conf", "mean_acc", "gap"])
def evl_reliability(t):
    """EVL-3: reliability table (group, bin) -> n, mean confidence, accuracy, gap."""
    return ev.reliability_table(V.v_margins(t), ["grp"])


@query("evl_brier", "SELECT grp, brier FROM ece_t", rnd=["brier"], extra_ctes=_cal_sql(_Y_CHOSEN))
def evl_brier(t):
    """EVL-4: Brier score per group (label = chosen)."""
    return ev.brier_score(V.v_margins(t), ["grp"])


@query("evl_mce", "SELECT grp, mce FROM ece_t", rnd=["mce"], extra_ctes=_cal_sql(_Y_CHOSEN))
def evl_mce(t):
    """EVL-5: maximum calibration error per group."""
    return ev.max_calibration_error(V.v_margins(t), ["grp"])


@query("evl_report", "SELECT grp, n, accuracy, ece, brier, mce, mean_margin, loss FROM ece_t",
       rnd=["accuracy", "ece", "brier", "mce", "mean_margin", "loss"],
       extra_ctes=_cal_sql(_Y_SIGN))
def evl_report(t):
    """EVL-9: the full evaluation row per group with the reference's sign labels."""
    return ev.calibration_report(V.v_margins(t), ["grp"], label_mode="sign")


@query("evl_batch_calibration", f"""
WITH b AS (SELECT grp, pair_id // 64 AS batch_id, avg(margin) AS bm FROM v_margins GROUP BY 1, 2),
c AS (SELECT grp, bm, {S.sigmoid('bm')} AS p, 1.0e0 AS y FROM b),
cb AS (SELECT *, {S.bin_case('p')} AS bin FROM c),
pb AS (SELECT grp, bin, count(*) AS c, avg(p) AS conf, avg(y) AS acc FROM cb
       WHERE bin IS NOT NULL GROUP BY grp, bin),
tot AS (SELECT grp, count(*) AS n, avg((p - y) * (p - y)) AS brier FROM cb GROUP BY grp)
SELECT t.grp, t.n AS batches, coalesce(sum(abs(pb.conf - pb.acc) * pb.c), 0) / t.n AS ece,
       t.brier, coalesce(max(abs(pb.conf - pb.acc)), 0.0e0) AS mce
FROM tot t LEFT JOIN pb ON pb.grp = t.grp WHERE t.n >= 10 GROUP BY t.grp, t.n, t.brier
""", rnd=["ece", "brier", "mce"])
def evl_batch_calibration(t):
    """EVL-10: callback calibration, one probability per batch of 64 pairs."""
    m = V.v_margins(t).withColumn("batch_id", F.floor(F.col("pair_id") / 64).cast("bigint"))
    return ev.batch_calibration(m, ["grp"], "batch_id")


@query("evl_auc", """
WITH s AS (
  SELECT model_id, r_a AS s, 1 AS lab FROM v_scores
  UNION ALL SELECT model_id, r_b AS s, 0 AS lab FROM v_scores),
r AS (SELECT model_id, lab, rank() OVER (PARTITION BY model_id ORDER BY s) AS rk,
             count(*) OVER (PARTITION BY model_id, s) AS ties FROM s),
a AS (SELECT model_id, sum(CASE WHEN lab = 1 THEN rk + (ties - 1) / 2.0e0 END) AS r1,
             CAST(sum(lab) AS DOUBLE) AS n1, CAST(sum(1 - lab) AS DOUBLE) AS n0
      FROM r GROUP BY model_id)
SELECT model_id, (r1 - n1 * (n1 + 1.0e0) / 2.0e0) / (n1 * n0) AS auc FROM a
""", rnd=["auc"])
def evl_auc(t):
    """EVL-6: Mann-Whitney AUC of chosen vs rejected rewards per model."""
    return ev.auc(V.v_scores(t), "r_a", "r_b", "pair_id", ["model_id"])


@query("evl_margin_corr", """
SELECT s.model_id, coalesce(corr(s.margin, (o.o_totalprice % 1000.0e0) / 250.0e0 - 2.0e0), 0.0e0)
       AS margin_correlation
FROM v_scores s JOIN orders o ON o.o_orderkey = s.pair_id GROUP BY s.model_id
""", rnd=["margin_correlation"])
def evl_margin_corr(t):
    """EVL-7: correlation of model margins with an annotated margin column."""
    truth = t.orders.select(F.col("o_orderkey").alias("pair_id"),
                            ((F.col("o_totalprice") % 1000.0) / 250.0 - 2.0).alias("true_margin"))
    j = V.v_scores(t).join(truth, "pair_id")
    return ev.margin_correlation(j, "margin", "true_margin", ["model_id"])


_GRID = ev.temperature_grid()


@query("evl_temperature", f"""
WITH g AS (SELECT unnest({S.list_lit(_GRID)}) AS temperature),
l AS (SELECT m.grp, g.temperature, avg({S.softplus_neg('m.margin / g.temperature')}) AS loss
      FROM v_margins m, g GROUP BY m.grp, g.temperature)
SELECT grp, arg_min(temperature, loss) AS temperature, min(loss) AS loss FROM l GROUP BY grp
""", rnd=["temperature", "loss"])
def evl_temperature(t):
    """EVL-8: temperature scaling by a bounded grid search in one pass."""
    return ev.fit_temperature(V.v_margins(t), ["grp"], grid=_GRID)


def _refine_sql(prev: str, name: str) -> str:
    """One refinement round in SQL: 21 points on [lo, hi] per group."""
    return f"""
{name}_pts AS (SELECT b.grp, b.lo, b.hi, k.range AS k, b.lo + (b.hi - b.lo) * k.range / 20 AS t
               FROM {prev} b, range(21) k),
{name}_l AS (SELECT p.grp, p.lo, p.hi, p.k, p.t, avg({S.softplus_neg('m.margin / p.t')}) AS loss
             FROM v_margins m JOIN {name}_pts p ON p.grp = m.grp GROUP BY p.grp, p.lo, p.hi, p.k, p.t),
{name} AS (SELECT grp, arg_min(t, (loss, k)) AS temperature, min(loss) AS loss,
                  arg_min(lo + (hi - lo) * greatest(k - 1, 0) / 20, (loss, k)) AS lo,
                  arg_min(lo + (hi - lo) * least(k + 1, 20) / 20, (loss, k)) AS hi
           FROM {name}_l GROUP BY grp)"""


@query("evl_temperature_refined", f"""
WITH g AS (SELECT unnest({S.list_lit(_GRID)}) AS temperature,
                  generate_subscripts({S.list_lit(_GRID)}, 1) - 1 AS k),
c AS (SELECT m.grp, g.k, avg({S.softplus_neg('m.margin / g.temperature')}) AS loss
      FROM v_margins m, g GROUP BY m.grp, g.k),
cb AS (SELECT grp, arg_min(k, (loss, k)) AS k FROM c GROUP BY grp),
b0 AS (SELECT grp, {S.list_lit(_GRID)}[greatest(k - 1, 0) + 1] AS lo,
              {S.list_lit(_GRID)}[least(k + 1, {len(_GRID) - 1}) + 1] AS hi FROM cb),
{_refine_sql('b0', 'r1').strip()},
{_refine_sql('r1', 'r2').strip()}
SELECT grp, temperature, loss FROM r2
""", rnd=["temperature", "loss"])
def evl_temperature_refined(t):
    """EVL-8 with two refinement rounds per group (three passes in all)."""
    return ev.fit_temperature_refined(V.v_margins(t), ["grp"], grid=_GRID, rounds=2)
