"""Run registered Spark queries against their DuckDB oracle SQL.

Mirrors the verification contract: same row count, same column names,
compatible types, equal order-insensitive value hash.  Floats are rounded
to 6 significant digits before hashing.

    python tests/oracle_harness.py [--sf-dir DIR] [name ...]
"""

from __future__ import annotations

import argparse
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == 0:
            return "0"
        return f"{v:.6g}"
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def table_hash(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def spark_rows(df):
    rows = df.collect()
    return list(df.columns), [tuple(r) for r in rows], [f.dataType.simpleString() for f in df.schema]


def duck_rows(con, sql):
    rel = con.sql(sql)
    cols = list(rel.columns)
    types = [str(t) for t in rel.types]
    return cols, rel.fetchall(), types


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    s_cols, s_rows, s_types = spark_rows(fn(spark, sf_dir))
    t1 = time.time()
    d_cols, d_rows, d_types = duck_rows(con, sql)
    t2 = time.time()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        d_index = [d_cols.index(c) for c in s_cols]
        d_rows_aligned = [tuple(r[i] for i in d_index) for r in d_rows]
        hs, hd = table_hash(s_cols, s_rows), table_hash(s_cols, d_rows_aligned)
        if hs != hd:
            problems.append(f"hash spark={hs} duck={hd}")
            s_set = sorted("|".join(_norm(x) for x in r) for r in s_rows)
            d_set = sorted("|".join(_norm(x) for x in r) for r in d_rows_aligned)
            only_s = sorted(set(s_set) - set(d_set))[:3]
            only_d = sorted(set(d_set) - set(s_set))[:3]
            problems.append(f"cols={s_cols}\n  only spark: {only_s}\n  only duck: {only_d}")
        types = dict(zip(d_cols, d_types))
        problems += [f"type {c}: spark={st} duck={types[c]}" for c, st in zip(s_cols, s_types)
                     if not _type_ok(st, types[c])]
    return problems, len(s_rows), t1 - t0, t2 - t1


_FAMILY = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "smallint": "SMALLINT", "float": "FLOAT", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def _type_ok(spark_type: str, duck_type: str) -> bool:
    want = _FAMILY.get(spark_type)
    return want is None or want == duck_type


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    import __spark_entry__ as E
    from vigilo.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck_connect(args.sf_dir)
    queries, oracle = E.queries(), E.oracle_sql()
    names = args.names or list(queries)
    failed = 0
    for name in names:
        if name not in oracle:
            df = queries[name](spark, args.sf_dir)
            n = df.count()
            print(f"ROWS  {name}: {n} rows (no oracle)")
            continue
        try:
            problems, n, ts, td = compare(spark, con, name, queries[name], oracle[name], args.sf_dir)
        except Exception as exc:  # report and continue
            problems, n, ts, td = [f"error: {type(exc).__name__}: {str(exc)[:800]}"], -1, 0, 0
        status = "OK  " if not problems else "FAIL"
        failed += bool(problems)
        print(f"{status}  {name}: {n} rows spark={ts:.1f}s duck={td:.1f}s")
        for p in problems:
            print("      " + p)
    print(f"{failed} failed of {len(names)}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
