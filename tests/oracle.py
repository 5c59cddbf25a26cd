"""Compare registered queries with their DuckDB oracles: python -m tests.oracle SF_DIR [name ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from eventloom.plans import load
from eventloom.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "~nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def compare(spark, con, q, sf_dir: str) -> str:
    df = q.build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if not q.sql:
        return f"rows-only ({len(got)})" if got else "EMPTY"
    res = con.execute(q.sql)
    names = [d[0] for d in res.description]
    types = [str(d[1]) for d in res.description]
    want = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}"
    if not got:
        return "EMPTY"
    order = sorted(range(len(names)), key=lambda i: names[i])
    pos = [df.columns.index(names[i]) for i in order]
    a = sorted("|".join(canon(r[i]) for i in pos) for r in got)
    b = sorted("|".join(canon(r[i]) for i in order) for r in want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    odd = [f"{n}:{t}" for n, t in zip(names, types) if t in ("HUGEINT",) or t.startswith("DECIMAL")]
    if bad:
        return f"VALUES {len(bad)}/{len(a)} differ, e.g.\n   spark {bad[0][0][:300]}\n   duck  {bad[0][1][:300]}"
    return f"ok ({len(a)})" + (f" TYPES {odd}" if odd else "")


def main() -> None:
    sf_dir, only = sys.argv[1], sys.argv[2:]
    module = [o[1:] for o in only if o.startswith("@")]
    only = [o for o in only if not o.startswith("@")]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.python.sql.dataFrameDebugging.enabled": "false", "spark.sql.codegen.cache.maxEntries": "5000"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name, q in load().items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        if module and q.build.__module__.rsplit(".", 1)[-1] not in module:
            continue
        t = time.time()
        try:
            out = compare(spark, con, q, sf_dir)
        except Exception as ex:  # report every query, then go on
            out = f"ERROR {type(ex).__name__}: {str(ex)[:700]}"
        print(f"{name:34s} {time.time() - t:6.1f}s {out}", flush=True)


if __name__ == "__main__":
    main()
