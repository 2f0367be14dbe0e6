"""Compare registered queries with their SQL on the driver tables.

Usage: python tests/oracle.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(df):
    import numpy as np
    import pandas as pd

    df = df[sorted(df.columns)].copy()
    for col in df.columns:
        s = df[col]
        if pd.api.types.is_float_dtype(s):
            df[col] = s.astype(float)
        elif pd.api.types.is_integer_dtype(s) or pd.api.types.is_bool_dtype(s):
            df[col] = s.astype("float64")
        elif pd.api.types.is_datetime64_any_dtype(s):
            df[col] = s.dt.strftime("%Y-%m-%d %H:%M:%S.%f").fillna("none")
        else:
            probe = s.dropna()
            first = probe.iloc[0] if len(probe) else None
            if hasattr(first, "year"):
                df[col] = pd.to_datetime(s).dt.strftime("%Y-%m-%d %H:%M:%S.%f").fillna("none")
            elif isinstance(first, (bool, np.bool_, int, float, np.number)):
                df[col] = pd.to_numeric(s.map(lambda v: None if v is None else float(v)))
            else:
                df[col] = s.map(lambda v: "none" if v is None or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark_pdf, duck_pdf):
    """None when equal, else a short reason."""
    import numpy as np

    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = _norm(spark_pdf), _norm(duck_pdf)
    for col in a.columns:
        x, y = a[col], b[col]
        if x.dtype == float and y.dtype == float:
            bad = ~((x == y) | (x.isna() & y.isna()))
            if bad.any():
                i = int(np.argmax(bad.values))
                return f"{col}: {int(bad.sum())} differ, first {x[i]!r} vs {y[i]!r}"
        elif not (x.astype(str) == y.astype(str)).all():
            bad = x.astype(str) != y.astype(str)
            i = int(np.argmax(bad.values))
            return f"{col}: {int(bad.sum())} differ, first {x[i]!r} vs {y[i]!r}"
    return None


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--types", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from tidemark.plans import load_all

    qs = load_all()
    picked = [n for n in qs if not args.names or any(n == a or n.startswith(a) for a in args.names)]
    sf_dir = f"{DATA}/sf{args.sf}"
    spark, con = session(), connect(sf_dir)
    failed = 0
    for n in picked:
        t0 = time.time()
        try:
            df = qs[n].run(spark, sf_dir)
            pdf = df.toPandas()
            t1 = time.time()
            if qs[n].sql is None:
                print(f"rows  {n}: {len(pdf)} rows {t1 - t0:.1f}s", flush=True)
                continue
            rel = con.sql(qs[n].sql)
            why = compare(pdf, rel.df())
            t2 = time.time()
            floats = [c for c in pdf.columns if pdf[c].dtype == float]
            empty = [c for c in pdf.columns if pdf[c].isna().all()]
            note = f" all-null {empty}" if empty and len(pdf) else ""
            status = "ok   " if why is None else "DIFF "
            failed += why is not None
            print(f"{status} {n}: {len(pdf)} rows spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s {why or ''}{note}", flush=True)
            if args.types:
                print("   ", dict(df.dtypes), dict(zip(rel.columns, map(str, rel.types))))
        except Exception as e:
            failed += 1
            print(f"ERROR {n}: {str(e)[:600]}", flush=True)
    print(f"{len(picked)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
