"""``python tests/llm/run_llm.py SF_DIR [NAME ...]``: run the queries and compare those that have SQL."""

from __future__ import annotations

import os
import sys
import time
import traceback

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(os.path.dirname(HERE)), os.path.dirname(HERE)]

from compare import differences  # noqa: E402

from verisift.llm.queries import QUERIES  # noqa: E402
from verisift.session import get_session  # noqa: E402


def main(sf_dir: str, wanted: list[str]) -> int:
    spark = get_session("checks", "8", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    failed = 0
    for name, (build, sql) in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            problems = differences(df, sql, sf_dir) if sql else []
            if sql is None:
                df.toPandas().to_parquet(f"/tmp/{name}.parquet")
        except Exception:  # noqa: BLE001 - report every query
            problems = [traceback.format_exc()[-3000:]]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} [{'sql' if sql else 'rows'}] {time.time() - start:.1f}s")
        for p in problems:
            print("     ", p, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
