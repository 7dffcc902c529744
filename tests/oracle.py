"""Compare a query with its SQL in DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        if hasattr(x, "as_tuple"):
            return round(float(x), 6)
        return x

    out = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)) if isinstance(x, str) else "", x if x is not None else 0) for x in r))


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = rows(list(rel.columns), rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows: {mine[:2]} {theirs[:2]}"
    for a, b in zip(mine, theirs, strict=True):
        if any(x != y and not (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 1e-5) for x, y in zip(a, b, strict=True)):
            return f"{a} and {b}"
    return ""
