"""Developer tool: compare registered queries with their oracle SQL.

usage: python tools_check.py [sf_dir] [name ...]"""
import sys
import time

from prefsight.plans.oracle_check import compare, duck_connection
from prefsight.plans.registry import load_all
from prefsight.session import build_session

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = build_session(partitions=8)
reg = load_all()
con = duck_connection(sf)
bad = 0
for n in (names or sorted(reg)):
    t0 = time.time()
    try:
        r = compare(spark, reg[n], sf, con)
    except Exception as e:  # report and continue
        r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
    r["sec"] = round(time.time() - t0, 2)
    if r["status"] not in ("match", "rows-only"):
        bad += 1
    print(r, flush=True)
print("BAD", bad)
