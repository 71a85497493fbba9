"""Side-by-side run of registered queries and their SQL."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    return value


def _sorted(rows):
    return sorted((tuple(_plain(v) for v in r) for r in rows), key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def compare(spark, con, query, sql, sf_dir) -> str:
    """Empty text when both sides give the same columns, types and rows."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = [tuple(r) for r in df.select(*names).collect()]
    result = con.execute(sql)
    described = {d[0]: str(d[1]) for d in result.description}
    if sorted(described) != names:
        return f"columns {names} against {sorted(described)}"
    order = [list(described).index(n) for n in names]
    theirs = [tuple(r[i] for i in order) for r in result.fetchall()]
    types = dict(df.dtypes)
    wrong = {n: (types[n], described[n]) for n in names if SAME_TYPE.get(types[n], types[n]) != described[n]}
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)} {wrong or ''}"
    a, b = _sorted(ours), _sorted(theirs)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0][0]} against {bad[0][1]} {wrong or ''}"[:1500]
    return f"types differ: {wrong}" if wrong else ""


def main() -> None:
    import __spark_entry__ as entry

    from prefmill.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        note = ""
        try:
            problem = compare(spark, con, query, sqls[name], sf_dir) if name in sqls else ""
            note = "" if name in sqls else f"no SQL, {query(spark, sf_dir).count()} rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        print(f"{'ok  ' if not problem else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {problem}{note}", flush=True)
    print(f"{failed} failed")
    spark.stop()


if __name__ == "__main__":
    main()
