"""Runs a registered query and its SQL and compares them the way a reader would."""

from __future__ import annotations

import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(_cell(v) for v in x)
    return x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def compare(spark, name, query, sql, sf_dir):
    """None if equal, else a short account of the difference."""
    import duckdb

    df = query(spark, sf_dir)
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right = _rows(names, cur.fetchall())
    if left[0] != right[0]:
        return f"{name}: columns {left[0]} / {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{name}: {len(left[1])} / {len(right[1])} rows"
    wrong = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return f"{name}: {len(wrong)} of {len(left[1])} rows differ, e.g. {wrong[0]}" if wrong else None
