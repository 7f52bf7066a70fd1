"""Run registered queries against their oracle: python tests/check.py [sf] [name ...]"""

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import duckdb  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from clientscope.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def normal(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if hasattr(v, "as_tuple"):
        return normal(float(v))
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, name):
    """None when equal, else a message."""
    df = queries()[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. {got[:1]} / {want[:1]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; spark {bad[0][0]} duckdb {bad[0][1]} cols {sorted(df.columns)}"
    kinds = dict(df.dtypes)
    for c, t in zip(rel.columns, rel.types):
        k, t = kinds[c], str(t)
        family = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}
        if family.get(k, t) != t:
            print(f"  type note {name}.{c}: {k} / {t}")
    return None if got else "no rows"


if __name__ == "__main__":
    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    names = sys.argv[2:] or list(queries())
    if len(names) == 1 and names[0].endswith("*"):
        names = [n for n in queries() if n.startswith(names[0][:-1])]
    failed = 0
    for n in names:
        t = time.time()
        try:
            message = compare(spark, con, sf, n)
        except Exception as e:  # noqa: BLE001
            message = f"{type(e).__name__}: {str(e)[:600]}"
        failed += message is not None
        kind = "O" if n in oracle_sql() else "R"
        if message or time.time() - t > 4:
            print(f"{n} [{kind}] {time.time() - t:.1f}s {message or 'ok'}", flush=True)
    print(f"{len(names)} queries, {failed} failed, {sum(n not in oracle_sql() for n in names)} rows-only")
