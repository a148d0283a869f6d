"""python tests/check.py SF_DIR [name ...] compares registered queries with their oracle SQL."""

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import __spark_entry__ as entry  # noqa: E402
from oracle import connect, difference  # noqa: E402

from plumbline.session import build_session  # noqa: E402


def main() -> None:
    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        began = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                verdict = difference(df, con, oracles[name]) or "ok"
            else:
                verdict = f"rows only: {df.count()}"
        except Exception as error:
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not (verdict == "ok" or verdict.startswith("rows only"))
        print(f"{name:28s} {time.time() - began:6.2f}s {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
