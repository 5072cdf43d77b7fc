"""Run a Spark query and its check SQL side by side and compare the rows."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs between both results; empty when they are equal."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    expected = cur.fetchall()
    rows = spark_df.collect()
    out = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} vs {sorted(names)}"]
    for name, kind in spark_df.dtypes:
        if KINDS.get(kind, kind) != types[name]:
            out.append(f"type of {name}: {kind} vs {types[name]}")
    order = sorted(names)
    pos = [names.index(n) for n in order]

    def key(t):
        return tuple((v is None, str(type(v)), v if v is not None else 0) for v in t)

    a = sorted((tuple(r[n] for n in order) for r in rows), key=key)
    b = sorted((tuple(r[i] for i in pos) for r in expected), key=key)
    if len(a) != len(b):
        out.append(f"rows {len(a)} vs {len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        out.append(f"{len(bad)} of {len(a)} rows differ, first: {bad[0]}")
    return out


def main() -> None:
    import __spark_entry__ as entry
    from polyphon.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    checks = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in checks:
                diff = differences(df, con, checks[name])
                n = "-"
            else:
                diff, n = [], df.count()
        except Exception as e:  # noqa: BLE001
            diff, n = [f"{type(e).__name__}: {str(e)[:1500]}"], "-"
        failed += bool(diff)
        print(f"{'ok  ' if not diff else 'FAIL'} {name} {time.time() - t:.1f}s {'' if name in checks else f'rows only: {n}'}", *diff, sep="\n     " if diff else " ", flush=True)
    print("failed", failed)
    con.close()
    spark.stop()


if __name__ == "__main__":
    main()
