"""Compares a query with its DuckDB twin on the same tables."""

import math
from pathlib import Path

import duckdb


def rows(df) -> tuple[list[str], list[tuple]]:
    df = df.select(*sorted(df.columns))
    return df.columns, sorted((tuple(norm(x) for x in r) for r in df.collect()), key=repr)


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return x


def twin(sql: str, sf: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in found.fetchall()), key=repr)
