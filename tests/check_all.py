"""Run every registered query (or those named) against its SQL check and report times.

Usage: python tests/check_all.py [folder] [query ...]
"""

import os
import sys
import time

sys.path[:0] = [__file__.rsplit("/tests/", 1)[0], __file__.rsplit("/", 1)[0]]

import __spark_entry__ as contract
from checking import compare, oracle
from subscope.session import session


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = session(
        "check", "local[8]",
        spark__sql__shuffle__partitions=os.environ.get("CHECK_PARTITIONS", "8"),
        spark__sql__session__timeZone=os.environ.get("CHECK_TIMEZONE", "UTC"),
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = oracle(folder), contract.oracle_sql(), 0
    for name, query in contract.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in sqls:
                problem = compare(df, con, sqls[name])
                note = "sql"
            else:
                n = len(df.collect())
                problem, note = ("" if n else "no rows"), f"rows only: {n}"
        except Exception as error:
            problem, note = f"{type(error).__name__}: {str(error)[:1500]}", ""
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {note} {problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
