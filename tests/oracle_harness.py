"""Side-by-side check of a registered Spark query against its DuckDB oracle SQL.

Mirrors the round check: same column names, same row count, same multiset of
rows. Floats are compared exactly and, separately, with a relative tolerance
so a failure says whether it is a rounding or a logic difference.
"""

from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, str(v)) for v in row)


def _close(a, b, rel=1e-9):
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        if a == b:
            return True
        try:
            return abs(float(a) - float(b)) <= rel * max(1.0, abs(float(a)), abs(float(b)))
        except (TypeError, ValueError):
            return False
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y, rel) for x, y in zip(a, b))
    return a == b


def _family(t: str) -> str:
    t = t.lower()
    if t in ("tinyint", "smallint", "int", "integer", "bigint", "hugeint", "long"):
        return "int"
    if t in ("float", "double", "real"):
        return "float"
    if t in ("string", "varchar"):
        return "str"
    if t in ("boolean", "bool"):
        return "bool"
    if t in ('"null"', "null"):
        return "null"
    return t


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(_norm(v) for v in r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = [tuple(_norm(v) for v in r) for r in rel.fetchall()]
    out = {"spark_cols": s_cols, "duck_cols": d_cols, "spark_rows": len(s_rows), "duck_rows": len(d_rows)}
    fam_s = {c: _family(t) for c, t in spark_df.dtypes}
    fam_d = {c: _family(str(t)) for c, t in zip(d_cols, rel.types)}
    type_diffs = {c: (fam_s[c], fam_d.get(c)) for c in fam_s if fam_d.get(c) not in (fam_s[c], "null")}
    if type_diffs:
        out["type_diffs"] = type_diffs
    if sorted(s_cols) != sorted(d_cols):
        out["status"] = "column-mismatch"
        return out
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_index = {c: i for i, c in enumerate(d_cols)}
    s_sorted = sorted((tuple(r[i] for i in order) for r in s_rows), key=_key)
    d_sorted = sorted((tuple(r[d_index[s_cols[i]]] for i in order) for r in d_rows), key=_key)
    if len(s_sorted) != len(d_sorted):
        out["status"] = "rowcount-mismatch"
        return out
    exact = s_sorted == d_sorted
    close = all(_close(a, b) for ra, rb in zip(s_sorted, d_sorted) for a, b in zip(ra, rb))
    out["status"] = "exact" if exact else ("close" if close else "value-mismatch")
    if not close:
        for ra, rb in zip(s_sorted, d_sorted):
            if not all(_close(a, b) for a, b in zip(ra, rb)):
                out["first_diff"] = {"cols": [s_cols[i] for i in order], "spark": ra, "duck": rb}
                break
    return out


def main(names=None, sf_dir="/root/testdata/sf0.01"):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tessera.session import get_spark
    spark = get_spark("local[8]", 8)
    # small buckets so the split-group path of the running totals is exercised
    spark.conf.set("tessera.prefix.rowsPerBucket", os.environ.get("ROWS_PER_BUCKET", "2000"))
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    results = {}
    for name in names or list(qs):
        try:
            df = qs[name](spark, sf_dir)
            if name in sqls:
                res = compare(df, con, sqls[name])
            else:
                res = {"status": "rows-only", "spark_rows": df.count()}
        except Exception as exc:  # report and continue
            res = {"status": "error", "error": repr(exc)[:600]}
        results[name] = res
        print(name, res, flush=True)
    return results


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    main(args or None, sf)


def show_diffs(name, sf_dir="/root/testdata/sf0.01", limit=5):
    """Print the first differing rows of one query (debug helper)."""
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tessera.session import get_spark
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    df = entry.queries()[name](spark, sf_dir)
    cols = df.columns
    s_rows = sorted((tuple(_norm(v) for v in r) for r in df.collect()), key=_key)
    rel = con.sql(entry.oracle_sql()[name])
    idx = [rel.columns.index(c) for c in cols]
    d_rows = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=_key)
    shown = 0
    for a, b in zip(s_rows, d_rows):
        if a != b:
            print("spark", a)
            print("duck ", b)
            shown += 1
            if shown >= limit:
                break
