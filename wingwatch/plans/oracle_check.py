"""Local stand-in for the driver's correctness gate.

Runs a catalogue query on Spark and its oracle SQL on DuckDB over the same
Parquet tables, then compares column names, row counts and order-insensitive
values.  Used by the tests and by hand (``python -m wingwatch.plans.oracle_check``).
"""

from __future__ import annotations

import datetime as dt
import math
import sys

import duckdb

from wingwatch.sources.tables import TABLE_NAMES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, (dt.datetime,)):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
                 "smallint": "SMALLINT", "float": "FLOAT", "tinyint": "TINYINT"}


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from wingwatch.plans.catalog import ORACLE, QUERIES

    sdf = QUERIES[name](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    res = {"name": name, "spark_rows": len(s_rows), "spark_cols": sorted(s_cols)}
    if name not in ORACLE:
        res["status"] = "rows-only"
        return res
    con = con or duck(sf_dir)
    rel = con.execute(ORACLE[name])
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    d_types = dict(zip(d_cols, (str(t) for t in con.sql(ORACLE[name]).types)))
    s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in sdf.schema.fields}
    res["duck_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLUMNS differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
        return res
    type_diff = {c: (s_types[c], d_types.get(c)) for c in s_types if s_types[c] != d_types.get(c)}
    if type_diff:
        res["status"] = f"TYPES differ: {type_diff}"
        return res
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if len(a) != len(b):
        res["status"] = "ROWCOUNT differs"
        return res
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["status"] = f"VALUES differ ({sum(1 for x, y in zip(a, b) if x != y)} rows), e.g. {bad}"
        return res
    res["status"] = "ok"
    return res


def main(argv: list[str]) -> int:
    from wingwatch.plans.catalog import QUERIES, load_all
    from wingwatch.session import get_session

    load_all()
    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("--")] or sorted(QUERIES)
    for a in argv:
        if a.startswith("--sf="):
            sf_dir = a.split("=", 1)[1]
    spark = get_session("local[8]")
    con = duck(sf_dir)
    failed = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        ok = r["status"] in ("ok", "rows-only")
        failed += not ok
        print(f"{'PASS' if ok else 'FAIL'} {n}: {r['status']} rows={r.get('spark_rows')}/{r.get('duck_rows')}",
              flush=True)
    print(f"{len(names) - failed}/{len(names)} passed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
