"""Run registered Spark queries next to their DuckDB oracle and compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = pd.to_datetime(df[c]).dt.tz_localize(None).astype("datetime64[us]")
        elif pd.api.types.is_extension_array_dtype(df[c]) and pd.api.types.is_integer_dtype(df[c]):
            df[c] = df[c].astype("float64" if df[c].isna().any() else "int64")
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: repr(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v)
    return df


def _hash(df: pd.DataFrame) -> str:
    rows = sorted(repr(tuple(None if (isinstance(v, float) and v != v) else v for v in row))
                  for row in df.itertuples(index=False))
    return hashlib.sha1("\n".join(rows).encode()).hexdigest()


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> tuple[bool, str]:
    a, b = _norm(spark_pdf), _norm(duck_pdf)
    if list(a.columns) != list(b.columns):
        return False, f"columns {list(a.columns)} vs {list(b.columns)}"
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}"
    ha, hb = _hash(a), _hash(b)
    if ha == hb:
        return True, "hash equal"
    sa = a.sort_values(list(a.columns), na_position="first").reset_index(drop=True)
    sb = b.sort_values(list(b.columns), na_position="first").reset_index(drop=True)
    for c in a.columns:
        x, y = sa[c], sb[c]
        if pd.api.types.is_float_dtype(x) and pd.api.types.is_float_dtype(y):
            d = (x - y).abs()
            if (d.fillna(0) > 1e-6).any() or (x.isna() != y.isna()).any():
                i = int(d.fillna(0).idxmax())
                return False, f"value diff in {c}: max {d.max()} at {sa.iloc[i].to_dict()} vs {sb.iloc[i].to_dict()}"
        elif not x.equals(y):
            diff = (x.astype(str) != y.astype(str))
            if diff.any():
                i = int(diff.idxmax())
                return False, f"diff in {c} ({x.dtype} vs {y.dtype}): {sa.iloc[i].to_dict()} vs {sb.iloc[i].to_dict()}"
    return False, "values within 1e-6 but hash differs (dtype or rounding)"


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from sensorcast.session import get_spark
    spark = get_spark(cpus="*", shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            spdf = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:400]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"ROWS {name}: {len(spdf)} rows (no oracle) {t1 - t0:.1f}s")
            continue
        try:
            dpdf = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        ok, msg = compare(spdf, dpdf)
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {name}: {len(spdf)} rows; {msg}; {t1 - t0:.1f}s")
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
