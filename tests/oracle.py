"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/**/*.parquet' if p.is_dir() else ''}')")
    return con


def _plain(v):  # noqa: ANN001, ANN202
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows_of(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    cols = [table[n].to_pylist() for n in names]
    return sorted((tuple(map(_plain, r)) for r in zip(*cols)), key=repr)


def kinds_of(table: pa.Table) -> dict[str, str]:
    def kind(t: pa.DataType) -> str:
        return "int" if pa.types.is_integer(t) else "float" if pa.types.is_floating(t) else "text" if pa.types.is_string(t) or pa.types.is_large_string(t) else str(t)

    return {f.name: kind(f.type) for f in table.schema}


def differences(spark, con, query, sql: str, sf_dir: str) -> str:  # noqa: ANN001
    """Empty if the query and its SQL agree in columns, kinds of types and rows."""
    mine = query(spark, sf_dir).toArrow()
    theirs = con.sql(sql).to_arrow_table()
    if kinds_of(mine) != kinds_of(theirs):
        return f"columns: {kinds_of(mine)} and {kinds_of(theirs)}"
    a, b = rows_of(mine), rows_of(theirs)
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; only here {only[0]}, only there {only[1]}"
    return "" if a else "no rows"
