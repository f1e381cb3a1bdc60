"""Developer tool: write the physical plans of selected queries to PLANS.md.

usage: python tools_explain.py [sf_dir]
"""
import contextlib
import io
import sys

from prefsight.plans.registry import load_all
from prefsight.session import build_session

SHOW = {
    "evl_report": "one-pass calibration: a single HashAggregate (partial + final) per group",
    "pol_best_of_n": "max_by over a struct key: partial aggregation per prompt, no window",
    "act_select": "top-k as TakeOrderedAndProject",
    "mrg_stats": "exact quartiles from range-partitioned positions, joined back",
    "rwd_margin": "models inlined as a literal array: Generate, no join",
    "evl_temperature": "41 temperatures as conditional aggregates of ONE pass, then min_by",
    "txt_vocab": "token counts partial-aggregated, top-V TakeOrderedAndProject",
    "cnv_transcript": "pure projection over a join of two transcript aggregates",
    "str_calibration_batch": "the streaming monitor's batch twin: one aggregate per window",
}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session()
    reg = load_all()
    out = ["# Physical plans of selected queries", "",
           f"Generated by `tools_explain.py` on `{sf}` (`local[8]`, AQE on). AQE may re-plan "
           "joins at run time (e.g. to broadcast after a small aggregate).", ""]
    for name, why in SHOW.items():
        df = reg[name].run(spark, sf)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        out += [f"## {name}", "", why, "", "```", buf.getvalue().strip(), "```", ""]
    with open("PLANS.md", "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
