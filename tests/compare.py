"""Run registered queries against their SQL in DuckDB: rows, names and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, int):
        return repr(value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def kinds(names, types):
    wide = {
        "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
        "BOOLEAN": "boolean", "HUGEINT": "hugeint",
    }
    return {n: wide.get(str(t), str(t)) for n, t in zip(names, types)}


def differences(spark, con, name, run, sql, sf) -> list[str]:
    df = run(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return [] if got else ["no rows"]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = kinds(names, [d[1] for d in cur.description])
    want = rows_of(names, cur.fetchall())
    out = []
    if sorted(df.columns) != sorted(names):
        out.append(f"columns {sorted(df.columns)} against {sorted(names)}")
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if mine != types:
        out.append(f"types {set(mine.items()) ^ set(types.items())}")
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lack = [r for r in want if r not in set(got)][:3]
        out.append(f"{len(got)} rows against {len(want)}; extra {extra}; lacking {lack}")
    return out


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tabscope.session import local_session

    sf = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name, run in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            faults = differences(spark, con, name, run, oracle.get(name), sf)
        except Exception as exc:  # noqa: BLE001
            faults = [f"{type(exc).__name__}: {str(exc)[:1500]}"]
        mark = "ok" if not faults else "BAD"
        kind = "" if name in oracle else " (rows only)"
        print(f"{mark} {name}{kind} {time.time() - started:.1f}s", *faults, sep="\n   " if faults else " ", flush=True)
