"""Run every query against its check: ``python tests/check_all.py FOLDER [name...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import connect, difference  # noqa: E402

from riskloom.plans import catalog  # noqa: E402
from riskloom.session import build_session  # noqa: E402


def main() -> int:
    folder, wanted = sys.argv[1], sys.argv[2:]
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session("check", "local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), 0
    checks = catalog.checks()
    for name, run in catalog.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            df = run(spark, folder)
            if name in checks:
                outcome = difference(df, con, checks[name]) or "ok"
            else:
                outcome = f"ok rows={len(df.collect())} (no check)"
        except Exception as error:  # noqa: BLE001 - report and go on
            outcome = f"{type(error).__name__}: {str(error)[:600]}"
            if wanted:
                traceback.print_exc()
        failed += not outcome.startswith("ok")
        print(f"{time.time() - started:6.1f}s {name}: {outcome}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(bool(main()))
