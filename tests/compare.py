"""Compare a Spark frame with DuckDB rows: names, types and values, in any row order."""

from __future__ import annotations

from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "tinyint": "TINYINT",
}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    return 0.0 if isinstance(value, float) and value == 0 else value


def differences(df, con, sql: str) -> list[str]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    own = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    found = []
    if own != kinds:
        found.append(f"schema: {own} != {kinds}")
        return found
    order = sorted(own)
    got = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in expected)
    if got != want:
        extra, absent = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        found.append(f"{len(got)} rows against {len(want)}; only here {extra}; only there {absent}")
    return found
