"""Run queries on Spark and their checks on DuckDB and compare the rows.

``python tests/compare.py [name-part ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BASE = ("region nation customer supplier part orders lineitem events documents "
        "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in BASE:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_value(x) for x in v) + "]"
    return str(v)


def rows_of(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(_value(v) for v in row) for row in zip(*cols))


def compare(spark, con, name, query, sql, sf_dir):
    got = query(spark, sf_dir).toArrow()
    if sql is None:
        return True, f"{got.num_rows} rows (no check)"
    want = con.sql(sql).to_arrow_table()
    gn, g = rows_of(got)
    wn, w = rows_of(want)
    types = {n: (str(got.schema.field(n).type), str(want.schema.field(n).type))
             for n in gn if n in wn and str(got.schema.field(n).type) != str(want.schema.field(n).type)
             and {str(got.schema.field(n).type), str(want.schema.field(n).type)} != {"timestamp[us, tz=UTC]", "timestamp[us]"}}
    note = f" types {types}" if types else ""
    if gn != wn:
        return False, f"columns {gn} != {wn}"
    if g != w:
        gs, ws = set(g), set(w)
        only_g = sorted(gs - ws)[:2]
        only_w = sorted(ws - gs)[:2]
        return False, f"rows {len(g)} vs {len(w)} cols {gn}\n  spark only ({len(gs-ws)}): {only_g}\n  duck only ({len(ws-gs)}): {only_w}"
    return True, f"{len(g)} rows" + note


def main(argv):
    import __spark_entry__ as entry
    from tenderspark.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    checks = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if argv and not any(part in name for part in argv):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, name, fn, checks.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
