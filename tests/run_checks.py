"""``python tests/run_checks.py SF_DIR [MODULE_OR_NAME ...]``: compare registered queries with their SQL."""

from __future__ import annotations

import importlib
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import differences  # noqa: E402

from verisift.session import get_session  # noqa: E402


def main(sf_dir: str, wanted: list[str]) -> int:
    names = ["source", "text", "sentiment", "corpus", "metric", "audit", "verdict", "model"]
    spark = get_session("checks", "8", spark__ui__showConsoleProgress="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    failed = 0
    for part in names:
        try:
            module = importlib.import_module(f"verisift.catalog.{part}_queries")
        except ModuleNotFoundError:
            print("no module", part)
            continue
        for query in module.QUERIES:
            if wanted and part not in wanted and query.name not in wanted:
                continue
            start = time.time()
            try:
                df = query.build(spark, sf_dir)
                if query.sql is None:
                    n = len(df.collect())
                    problems, kind = ([] if n else ["no rows"]), f"rows={n}"
                else:
                    problems, kind = differences(df, query.sql, sf_dir), "sql"
            except Exception as error:  # noqa: BLE001 - report every query
                problems, kind = [repr(error)[:1500]], "error"
                if os.environ.get("TRACE"):
                    traceback.print_exc()
            failed += bool(problems)
            print(f"{'FAIL' if problems else 'ok  '} {query.name} [{kind}] {time.time() - start:.2f}s", flush=True)
            for p in problems:
                print("     ", p)
    print("failed:", failed)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
