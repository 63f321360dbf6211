"""Row-for-row comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "int",
         "double": "float", "float": "float", "string": "text", "varchar": "text", "boolean": "bool", "bool": "bool"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        return ("decimal", str(v))
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))


def differences(df, con, sql: str) -> list[str]:
    """Empty when names, kinds, row count and every value agree."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: KINDS.get(str(d[1]).lower(), str(d[1]).lower()) for d in cur.description}
    theirs = cur.fetchall()
    ours = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    out = []
    for c, t in df.dtypes:
        a, b = KINDS.get(t, t), kinds[c]
        if a != b and not (a.startswith("timestamp") and b.startswith("timestamp")):
            out.append(f"type of {c}: {t} != {b}")
    if len(ours) != len(theirs):
        return [*out, f"rows {len(ours)} != {len(theirs)}"]
    _, a = canonical(df.columns, ours)
    cols, b = canonical(names, theirs)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        out.append(f"{len(bad)} of {len(a)} rows differ; {cols}; first: {bad[0][0]} != {bad[0][1]}")
    return out
