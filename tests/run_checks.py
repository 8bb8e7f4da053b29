"""Run registered queries against their SQL: python tests/run_checks.py [prefix ...] [--sf DIR]."""

from __future__ import annotations

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from harness import compare, connect  # noqa: E402

from plumbline.catalog import load_all  # noqa: E402
from plumbline.session import get_spark  # noqa: E402


def main(argv: list[str]) -> int:
    sf = "/root/testdata/sf0.001"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    queries, oracles = load_all()
    spark, con = get_spark("checks"), connect(sf)
    bad = 0
    for name, fn in sorted(queries.items()):
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                err = compare(df, con, oracles[name])
            else:
                err = None if df.count() >= 0 else "no rows"
        except Exception as e:  # report and go on
            err = f"{type(e).__name__}: {str(e)[:900]}"
        took = time.time() - t0
        if err:
            bad += 1
        print(f"{'FAIL' if err else 'ok  '} {took:6.2f}s {'' if name in oracles else '(rows) '}{name} {err or ''}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
