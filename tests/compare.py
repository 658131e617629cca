"""Compare a Spark result with the DuckDB result of its check."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


_KINDS = {
    "bigint": "int64", "long": "int64", "int": "int32", "integer": "int32", "double": "double",
    "string": "text", "varchar": "text", "boolean": "bool", "timestamp_ntz": "ts", "timestamp": "ts",
    "date": "date", "float": "float",
}


def kind(name: str) -> str:
    return _KINDS.get(name.lower(), name.lower())


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else a short description."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: kind(str(d[1])) for d in cursor.description}
    want_cols, want = rows_of(names, cursor.fetchall())
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    own = {f.name: kind(f.dataType.simpleString()) for f in spark_df.schema.fields}
    odd = {n: (own[n], kinds[n]) for n in own if own[n] != kinds[n] and "[" not in kinds[n]}
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} rows differ ({got_cols}), e.g. {bad[0]} kinds {odd}"
    if odd:
        return f"types {odd}"
    return None
