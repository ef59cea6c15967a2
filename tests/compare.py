"""Compare a query with its SQL on one scale: columns, kinds of types, rows."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KIND = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    return str(x) if hasattr(x, "isoformat") else x


def differences(spark, query, sql, con, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} against {sorted(rel.columns)}"
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    off = {c: (k, kinds[c]) for c, k in df.dtypes if k in KIND and KIND[k] != kinds[c]}
    if off:
        return f"types {off}"
    ours = Counter(tuple(_value(r[c]) for c in names) for r in df.collect())
    at = [rel.columns.index(c) for c in names]
    theirs = Counter(tuple(_value(r[k]) for k in at) for r in rel.fetchall())
    if ours != theirs:
        return f"{sum(ours.values())} rows against {sum(theirs.values())}; only ours {list((ours - theirs).items())[:3]}, only theirs {list((theirs - ours).items())[:3]}"
    return None
