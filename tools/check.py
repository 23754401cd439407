"""Compare registered queries with their SQL: python tools/check.py [--sf DIR] [name-prefix ...]."""
from __future__ import annotations

import math
import os
import sys
import threading
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from vacancia.catalog import load_all  # noqa: E402
from vacancia.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
         "timestamp": "TIMESTAMP"}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def key(row):
    return tuple((x is not None, str(type(x).__name__ == "str"), x if not isinstance(x, bool) else int(x)) if not isinstance(x, (list, dict)) else str(x) for x in row)


def main(argv):
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    spark = build_session("check")
    bad = 0
    for name, q in load_all().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t0 = time.time()
        def stop():
            spark.sparkContext.cancelAllJobs()
            con.interrupt()
        timer = threading.Timer(float(os.environ.get("LIMIT", "60")), stop)
        timer.start()
        try:
            df = q.run(spark, sf)
            cols = sorted(df.columns)
            types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            got = [tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
            t1 = time.time()
            if not q.sql:
                print(f"rows  {name}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
                if not got:
                    bad += 1
                continue
            rel = con.sql(q.oracle())
            names, want_types = list(rel.columns), dict(zip(rel.columns, map(str, rel.types)))
            sel = ", ".join(f'"{c}"' for c in sorted(names))
            want = [tuple(norm(v) for v in r) for r in con.sql(f"SELECT {sel} FROM ({q.oracle()}) _o").fetchall()]
            issues = []
            if sorted(names) != cols:
                issues.append(f"columns {cols} vs {sorted(names)}")
            else:
                for c in cols:
                    if KINDS.get(types[c]) != want_types[c]:
                        issues.append(f"type {c}: {types[c]} vs {want_types[c]}")
                if len(got) != len(want):
                    issues.append(f"rows {len(got)} vs {len(want)}")
                a, b = sorted(got, key=lambda r: str(r)), sorted(want, key=lambda r: str(r))
                if a != b:
                    sa, sb = set(map(str, a)), set(map(str, b))
                    issues.append("only spark " + str(sorted(sa - sb)[:3])[:900])
                    issues.append("only sql   " + str(sorted(sb - sa)[:3])[:900])
            if not got:
                issues.append("no rows")
            bad += bool(issues)
            print(f"{'FAIL' if issues else 'ok  '}  {name}: {len(got)} rows spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s", flush=True)
            for i in issues:
                print("      " + i, flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR   {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
        finally:
            timer.cancel()
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
