"""Run registered queries and their SQL side by side: python tests/compare.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def data_dir(sf: str) -> str:
    return f"/root/testdata/sf{sf}"


def duck(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, cell(x)) for k, x in v.items())
    return v


def rows_of(table):
    cols = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in cols]
    return cols, sorted([tuple(cell(v) for v in r) for r in zip(*data)], key=repr)


KIND = {"int32": "int64", "large_string": "string", "string": "string"}


def compare(spark, con, name, fn, sql, folder):
    df = fn(spark, folder)
    got = df.toArrow()
    if sql is None:  # only queries of the training-data operators, which are tested against brute force; every other query states its result in SQL
        return f"rows {got.num_rows}", got.num_rows > 0 and (name.startswith("op") or name == "pipeline")
    want = con.sql(sql).to_arrow_table() if hasattr(con.sql("select 1"), "to_arrow_table") else con.sql(sql).arrow()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    if gc != wc:
        return f"columns {gc} != {wc}", False
    if len(gr) != len(wr):
        return f"rows {len(gr)} != {len(wr)}", False
    bad = [(a, b) for a, b in zip(gr, wr) if a != b]
    if bad:
        return f"{len(bad)} of {len(gr)} differ, first\n   got  {str(bad[0][0])[:600]}\n   want {str(bad[0][1])[:600]}", False
    note = ""
    for c in gc:
        a, b = str(got.schema.field(c).type), str(want.schema.field(c).type)
        if KIND.get(a, a) != KIND.get(b, b):
            note += f" type {c}: {a} vs {b}"
    if not gr:
        return "EMPTY", False
    return f"ok {len(gr)}{note}", not note


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    from tessera.plans.session import session
    import __spark_entry__ as entry

    spark = session()
    folder = data_dir(sf)
    con = duck(folder)
    oracles = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            text, ok = compare(spark, con, name, fn, oracles.get(name), folder)
        except Exception as e:
            text, ok = f"ERROR {type(e).__name__} {str(e)[:300]}", False
            if "-v" in os.environ.get("CMP", ""):
                traceback.print_exc()
        print(f"{'PASS' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {text}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
