"""Run a registered query on Spark and its SQL twin on DuckDB, and compare them as sets of rows."""

from __future__ import annotations

import math
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    return repr(value)


def as_rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


# Spark type names and what DuckDB calls them
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(df, con, sql: str) -> str | None:
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    types = {c[0]: str(c[1]) for c in found.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    for field in df.schema:
        if TYPES[field.dataType.simpleString()] != types[field.name]:
            return f"type of {field.name}: {field.dataType.simpleString()} against {types[field.name]}"
    ours, theirs = as_rows(df.columns, df.collect()), as_rows(names, found.fetchall())
    if not ours:
        return "no rows"
    if ours == theirs:
        return None
    only_ours, only_theirs = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return f"{sum(ours.values())} against {sum(theirs.values())} rows; only here {only_ours}; only there {only_theirs}"
