"""Compare registered queries with their checking SQL, the way the driver does."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

from veriframe.bindings import RAW_TABLES


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in RAW_TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    out = {}
    for name in frame.columns:
        column = frame[name]
        if pd.api.types.is_float_dtype(column) or pd.api.types.is_integer_dtype(column):
            out[name] = column.astype("float64").map(lambda v: "null" if pd.isna(v) else f"{v:.6g}" if abs(v) > 1e15 else repr(round(v, 6) + 0.0))
        else:
            out[name] = column.map(lambda v: "null" if v is None or v is pd.NaT or (isinstance(v, float) and pd.isna(v)) or v is pd.NA else str(v))
    flat = pd.DataFrame(out, index=frame.index)
    return flat.sort_values(list(flat.columns)).reset_index(drop=True)


def compare(spark_frame, oracle_frame):
    """None when equal, else a short text."""
    if sorted(spark_frame.columns) != sorted(oracle_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(oracle_frame.columns)}"
    if len(spark_frame) != len(oracle_frame):
        return f"rows {len(spark_frame)} vs {len(oracle_frame)}"
    a, b = canonical(spark_frame), canonical(oracle_frame)
    for name in a.columns:
        bad = a[name] != b[name]
        if bad.any():
            first = bad.idxmax()
            return f"{name}: {int(bad.sum())} differ\n   spark  {a.loc[first].to_dict()}\n   oracle {b.loc[first].to_dict()}"
    return None


def main(sf_dir, wanted):
    import __spark_entry__ as entry
    from veriframe.session import build_session

    spark = build_session("oracle", "local[8]", 8, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in queries:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            start = time.time()
            mine = queries[name](spark, sf_dir).toPandas()
            spent = time.time() - start
            if name in oracles:
                start = time.time()
                theirs = con.execute(oracles[name]).df()
                problem = compare(mine, theirs)
                print(f"{'ok  ' if problem is None else 'DIFF'} {name} rows={len(mine)} {spent:.1f}s oracle {time.time() - start:.1f}s", problem or "", flush=True)
            else:
                problem = None
                print(f"rows {name} rows={len(mine)} {spent:.1f}s", flush=True)
        except Exception as error:  # report and go on with the other queries
            problem = str(error)
            print(f"ERR  {name} {problem[:900]}", flush=True)
        failed += problem is not None
    print("failed", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
