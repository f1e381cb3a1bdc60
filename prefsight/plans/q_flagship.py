"""Flagship query: per-group calibration and margin profile in one result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefsight.operators import evaluate as ev
from prefsight.operators import margins as mg
from prefsight.plans.registry import round_doubles
from prefsight.session import ensure_checkpoint_dir
from prefsight.sources import views as V
from prefsight.sources.tables import Tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    t = Tables(spark, sf_dir)
    m = V.v_margins(t)
    cal = ev.calibration_report(m, ["grp"], label_mode="chosen")
    stats = mg.margin_statistics(m, ["grp"]).drop("n")
    return round_doubles(cal.join(stats, "grp"))
