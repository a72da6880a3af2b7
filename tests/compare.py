"""Run catalog queries against DuckDB on the same parquet files.

python tests/compare.py [--sf DIR] [name-prefix …]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(directory: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{directory}/{t}.parquet')")
    return con


def norm(v):
    import datetime
    import decimal
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def kind(t: str) -> str:
    if t in ("int", "bigint", "smallint", "tinyint"):
        return "int"
    return {"double": "float", "float": "float"}.get(t, t.split("<")[0].split("(")[0])


def duck_kind(t: str) -> str:
    if t in ("INTEGER", "BIGINT", "SMALLINT", "TINYINT"):
        return "int"
    return {"DOUBLE": "float", "FLOAT": "float", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz"}.get(
        t, "array" if t.endswith("[]") else t.lower())


def compare(spark, con, name, directory):
    from planlens.catalog import QUERIES, SQL
    df = QUERIES[name](spark, directory)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        return len(got), "rows-only" if got else "EMPTY"
    rel = con.execute(SQL[name])
    dcols, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if cols != dcols:
        return len(got), f"COLUMNS {cols} vs {dcols}"
    if got == want:
        spark_kinds = {c: kind(t) for c, t in df.dtypes}
        duck_kinds = {d[0]: duck_kind(str(ty)) for d, ty in zip(rel.description, con.sql(SQL[name]).types)}
        odd = {c: (k, duck_kinds[c]) for c, k in spark_kinds.items() if k != duck_kinds[c]}
        if odd:
            return len(got), f"TYPES {odd}"
        return len(got), "ok" if got else "EMPTY"
    if len(got) != len(want):
        return len(got), f"COUNT {len(got)} vs {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return len(got), f"VALUES {len(bad)} differ, cols {cols}, first: {bad[0]}"


def main() -> None:
    import importlib
    args = sys.argv[1:]
    directory = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        directory, args = args[1], args[2:]
    from planlens.session import session
    importlib.import_module("planlens.catalog")
    from planlens.catalog import QUERIES
    spark, con = session("local[8]", 8), duck(directory)
    bad = 0
    for name in QUERIES:
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            n, state = compare(spark, con, name, directory)
        except Exception as e:  # noqa: BLE001
            n, state = -1, f"ERROR {type(e).__name__}: {str(e)[:700]}"
        bad += state not in ("ok", "rows-only")
        print(f"{name:40s} {n:7d} {time.time() - t:6.2f}s {state}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
