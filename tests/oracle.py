"""Spark results against DuckDB's, as multisets of rows with close numbers."""

import math
from pathlib import Path

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in NAMES:
        at = Path(folder, f"{name}.parquet")
        if not at.exists():
            continue
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
    return con


def rows_of_duck(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    cur = duck(folder).execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), [tuple(r[i] for i in order) for r in cur.fetchall()]


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, [tuple(r[n] for n in names) for r in df.select(*names).collect()]


def _key(row):
    return tuple((v is None, f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12)
    return type(a) is type(b) and a == b


def assert_same(df, folder: str, sql: str) -> int:
    names, got = rows_of_spark(df)
    wanted_names, wanted = rows_of_duck(folder, sql)
    assert names == wanted_names
    assert len(got) == len(wanted)
    for g, w in zip(sorted(got, key=_key), sorted(wanted, key=_key), strict=True):
        assert all(map(same, g, w)), (g, w)
    return len(got)
