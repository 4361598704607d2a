"""Compare registered queries with their cross-check SQL on one data folder."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from evidquarry.sources.tables import TABLES


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_norm(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(row[i]) for i in order) for row in rows)


def compare(spark, con, folder, name, runner, sql):
    started = time.time()
    frame = runner(spark, folder)
    got = [tuple(r) for r in frame.collect()]
    took = time.time() - started
    if sql is None:
        return True, f"rows-only {len(got)} rows {took:.1f}s"
    started = time.time()
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    sql_took = time.time() - started
    if sorted(columns) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} vs {sorted(columns)}"
    left, right = rows_of(frame.columns, got), rows_of(columns, want)
    if left != right:
        a, b = set(left), set(right)
        return False, (
            f"{len(left)} vs {len(right)} rows; only spark {sorted(a - b)[:2]}; "
            f"only sql {sorted(b - a)[:2]}"
        )[:1500]
    return True, f"{len(got)} rows {took:.1f}s sql {sql_took:.1f}s" + (" EMPTY" if not got else "")


def main(argv):
    from evidquarry.plans import ORACLES, QUERIES
    from evidquarry.session import build_session

    folder = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    spark = build_session(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = []
    for name in QUERIES:
        module = QUERIES[name].module
        if wanted and not any(name.startswith(w) or module == w for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, folder, name, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # report and go on to the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        if not ok:
            bad.append(name)
        print(("ok   " if ok else "FAIL ") + name + "  " + note, flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
