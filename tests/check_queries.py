"""Run registered queries against their SQL on one folder: check_queries.py [folder] [name ...]."""

from __future__ import annotations

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

import __spark_entry__ as entry  # noqa: E402
from compare import connect, differences  # noqa: E402

from fleetledger import build_session  # noqa: E402


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    settings = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    spark = build_session(master="local[8]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(folder), entry.oracle_sql(), 0
    for name in names:
        start = time.time()
        try:
            result = entry.queries()[name](spark, folder)
            if name in oracle:
                found = differences(result, con, oracle[name])
            else:
                found = [] if result.collect() else ["no rows"]
        except Exception as error:  # noqa: BLE001 - report every query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.2f}s", *found, sep="\n     " if found else " ")
    print(f"{bad} of {len(names)} failed")
    spark.stop()


if __name__ == "__main__":
    main()
