"""Compare named queries with their SQL twins in DuckDB; also usable from the shell:

    python tests/oracle_check.py 0.01 name [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(sorted((k, _norm(v)) for k, v in value.asDict().items()))
    if isinstance(value, dict):
        return tuple(sorted((k, _norm(v)) for k, v in value.items()))
    if type(value).__name__ == "Decimal":
        return round(float(value), 6) + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, fn, sql: str | None):
    """-> (ok, message)."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    timing = f"spark {time.time() - start:.1f}s"
    if sql is None:
        return True, f"{len(got)} rows, {timing} (no SQL twin)"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 50000 else []
        return False, f"{len(got)} rows vs {len(want)}; e.g. {extra}"
    for a, b in zip(got, want):
        if a != b and not all(
                x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 1e-5)
                for x, y in zip(a, b)):
            return False, f"{sorted(names)}: spark {a} vs sql {b}"
    return True, f"{len(got)} rows, {timing}"


def main(argv) -> int:
    from mineralis.plans import all_queries, all_sql
    from mineralis.session import local_session

    sf_dir = f"/root/testdata/sf{argv[0]}"
    fns, sqls = all_queries(), all_sql()
    names = []
    for arg in argv[1:] or ["@"]:   # "@module" means every query of that module, "@" every query
        names += [arg] if not arg.startswith("@") else [
            n for n, f in fns.items() if arg == "@" or f.__module__.endswith("." + arg[1:])]
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            ok, message = compare(spark, con, sf_dir, fns[name], sqls.get(name))
        except Exception as exc:  # report and go on to the next query
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {message} [{time.time() - start:.1f}s]", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
