"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    con.close()
    return names, rows


def _cell(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, int):
        return str(value)
    return str(value)


def _normal(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def _kinds(names: list[str], rows) -> dict[str, str]:
    kinds = {}
    for i, name in enumerate(names):
        kinds[name] = next((type(r[i]).__name__ for r in rows if r[i] is not None), "none")
    return kinds


def differences(df: DataFrame, sql: str, sf_dir: str) -> list[str]:
    """Human-readable differences; empty when names, types and rows agree."""
    spark_rows = [tuple(r) for r in df.collect()]
    names, rows = oracle_rows(sql, sf_dir)
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    ours, theirs = _kinds(df.columns, spark_rows), _kinds(names, rows)
    out = [f"{n}: {ours[n]} != {theirs[n]}" for n in names if ours[n] != theirs[n]]
    a, b = _normal(df.columns, spark_rows), _normal(names, rows)
    if len(a) != len(b):
        out.append(f"{len(a)} rows != {len(b)} rows")
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        out.append(f"{len(only_a)} rows only in Spark, {len(only_b)} only in SQL")
        out += [f"  spark {str(x)[:400]}" for x in only_a[:3]] + [f"  sql   {str(x)[:400]}" for x in only_b[:3]]
    return out
