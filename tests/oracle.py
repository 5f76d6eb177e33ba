"""Run registered queries against their DuckDB oracle (driver-style compare)."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kinframe.sources.tables import TABLE_NAMES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm_type(t) -> str:
    s = str(t)
    return {"large_string": "string", "large_list<item: string>": "list<item: string>"}.get(s, s)


def _norm_val(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm_val(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm_val(v.tolist())
    return v


def _rows(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_norm_val(c[i]) for c in cols) for i in range(table.num_rows)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, key, fn, sql, sf_dir, con):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    st = sdf.toArrow()
    t1 = time.time()
    res = {"key": key, "spark_rows": st.num_rows, "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    dt = con.sql(sql).to_arrow_table() if hasattr(con.sql(sql), "to_arrow_table") else con.sql(sql).arrow()
    if hasattr(dt, "read_all"):
        dt = dt.read_all()
    res["oracle_rows"] = dt.num_rows
    sn = {f.name: _norm_type(f.type) for f in st.schema}
    dn = {f.name: _norm_type(f.type) for f in dt.schema}
    if sorted(sn) != sorted(dn):
        res["status"] = f"NAMES spark={sorted(sn)} oracle={sorted(dn)}"
        return res
    tdiff = {k: (sn[k], dn[k]) for k in sn if sn[k] != dn[k]}
    if st.num_rows != dt.num_rows:
        res["status"] = f"ROWS {st.num_rows} vs {dt.num_rows}"
        return res
    a, b = _rows(st), _rows(dt)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["status"] = f"VALUES first diffs {bad}"
        return res
    res["status"] = "ok" if not tdiff else f"TYPES {tdiff}"
    return res


def main(argv):
    from kinframe.session import build_local
    import __spark_entry__ as E

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    only = set(argv[1:])
    spark = build_local(8, 8)
    con = duck(sf_dir)
    qs, oc = E.queries(), E.oracle_sql()
    bad = 0
    for k in sorted(qs):
        if only and k not in only:
            continue
        try:
            r = compare(spark, k, qs[k], oc.get(k), sf_dir, con)
        except Exception as e:  # report and continue
            r = {"key": k, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"== {len(qs)} keys, {len(oc)} with oracle, {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
