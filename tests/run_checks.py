"""Command-line form of the check: ``python tests/run_checks.py [name part] …`` with timings."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import importlib  # noqa: E402

from oracle import connect, difference  # noqa: E402

from flowbench.session import build_session  # noqa: E402


def main() -> int:
    entry = importlib.import_module("__spark_entry__")
    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("checks", "local[8]", 8, {"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, checks = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in checks:
                problem = difference(spark, con, sf_dir, fn, checks[name])
            else:
                n = len(fn(spark, sf_dir).collect())
                problem = None if n else "no rows"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1200]}"
        kind = "sql" if name in checks else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {kind} {name}", flush=True)
        if problem:
            bad += 1
            print("     " + problem, flush=True)
    print(f"{bad} failed")
    spark.stop()
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
