"""Run queries next to their SQL twins and compare values.

``python tests/oracle.py [sf_dir] [name ...]``
"""

import os
import sys
import time
import traceback

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(pdf):
    pdf = pdf[sorted(pdf.columns)]
    rows = []
    for r in pdf.itertuples(index=False):
        row = []
        for v in r:
            if v is None or v is pd.NA or v != v or str(v) == "NaT":
                row.append("~")
            elif isinstance(v, (bool, np.bool_)):
                row.append(str(bool(v)))
            elif isinstance(v, (float, np.floating, int, np.integer)):
                row.append(repr(float(v)))
            else:
                row.append(str(v))
        rows.append(tuple(row))
    return sorted(rows)


def compare(spark_df, con, sql):
    a, b = spark_df.toPandas(), con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} != {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    ca, cb = canonical(a), canonical(b)
    bad = [(x, y) for x, y in zip(ca, cb) if x != y]
    if bad:
        return f"{len(bad)} of {len(ca)} rows differ, first: {sorted(a.columns)} {bad[0]}"
    types = {c: (a[c].dtype, b[c].dtype) for c in a.columns if a[c].dtype.kind != b[c].dtype.kind}
    return f"ok {len(a)} rows" + (f" (types {types})" if types else "")


def main():
    import __spark_entry__ as entry

    from tidemark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("oracle", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    built, sqls = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(built)
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = built[n](spark, sf)
            result = compare(df, con, sqls[n]) if n in sqls else f"ok rows-only {len(df.toPandas())} rows"
        except Exception as e:
            result = "FAILED " + "".join(traceback.format_exception_only(type(e), e))[:700]
        bad += not result.startswith("ok")
        print(f"{n:28s} {time.time() - t:6.2f}s {result}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
