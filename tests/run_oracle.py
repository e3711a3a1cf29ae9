"""Run chosen queries against their SQL: python tests/run_oracle.py [scale] [name part ...]."""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/tests", 1)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

import oracle  # noqa: E402

from statloom.queries import QUERIES, SQL  # noqa: E402
from statloom.session import build_session  # noqa: E402

scale, *wanted = sys.argv[1:] or ["0.01"]
sf_dir = f"/root/testdata/sf{scale}"
spark = build_session(**{"spark.ui.showConsoleProgress": "false"})
con = oracle.connect(sf_dir)
bad = 0
for name, fn in QUERIES.items():
    if wanted and not any(w in name for w in wanted):
        continue
    start = time.time()
    try:
        df = fn(spark, sf_dir)
        result = oracle.difference(df, SQL[name], con) if name in SQL else f"rows only: {len(df.collect())}"
        ok = result is None or result.startswith("rows only")
    except Exception as error:
        result, ok = "".join(traceback.format_exception_only(error))[:900], False
    bad += not ok
    print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {result or ''}", flush=True)
print("failures:", bad)
