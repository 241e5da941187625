"""Compare a registered query with its oracle SQL; also a command line tool.

python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("glasswork")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="glasswork-tests-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=lambda t: [str(x) for x in t])


def difference(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    df = fn(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = _rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(bad)} of {len(mine)} rows differ, first {bad[0]}" if bad else None


def main(argv):
    import __spark_entry__ as entry

    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf, argv = argv[at + 1], argv[:at] + argv[at + 2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    oracles, failed = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if argv and name not in argv and not any(a.endswith("*") and name.startswith(a[:-1]) for a in argv):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = difference(spark, con, fn, oracles[name], sf_dir)
            else:
                problem = None if fn(spark, sf_dir).count() > 0 else "no rows"
        except Exception:
            problem = traceback.format_exc(limit=-3)[-1500:]
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name:36s} {'sql ' if name in oracles else 'rows'} {time.time() - start:6.2f}s {problem or ''}",
              flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
