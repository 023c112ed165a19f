"""Runs registered queries next to their checking SQL.

    python tests/compare.py [sf dir] [query ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return round(float(v), 6) if abs(v) < 2**53 else v
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, query, sql, sf_dir):
    """None when both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    ours = _rows(df.columns, df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = _rows(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    kinds = {n: str(t) for n, t, *_ in found.description}
    for name, kind in df.dtypes:
        want = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}.get(kind)
        if want != kinds[name]:
            return f"type of {name}: {kind} and {kinds[name]}"
    if ours != theirs:
        a, b = set(ours) - set(theirs), set(theirs) - set(ours)
        return f"rows {len(ours)} and {len(theirs)}; only here {list(a)[:2]}; only there {list(b)[:2]}"
    return None if ours else "no rows"


def main(args):
    from conftest import make_session
    from parley.registry import load
    sf_dir = args[0] if args else "/root/testdata/sf0.001"
    spark, con = make_session(), connect(sf_dir)
    queries, oracle = load()
    bad = 0
    for name in args[1:] or queries:
        began = time.time()
        try:
            if name in oracle:
                result = difference(spark, con, queries[name], oracle[name], sf_dir)
            else:
                n = len(queries[name](spark, sf_dir).collect())
                result = None if n else "no rows"
                name += f" (rows only: {n})"
        except Exception as error:
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += result is not None
        print(f"{'ok ' if result is None else 'BAD'} {time.time() - began:6.2f}s {name} {result or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
