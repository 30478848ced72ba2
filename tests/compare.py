"""Compare a Spark result with a DuckDB result, exactly and order-insensitively."""

from __future__ import annotations

import datetime
import decimal

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


DUCK_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
              "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when columns, types, row counts and all values are equal."""
    result = con.execute(sql)
    duck = {d[0]: str(d[1]) for d in result.description}
    duck_rows = result.fetchall()
    found = []
    if sorted(duck) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(duck)}"]
    for name, kind in spark_df.dtypes:
        if DUCK_TYPES.get(kind, kind) != duck[name]:
            found.append(f"type of {name}: {kind} != {duck[name]}")
    left = _rows(spark_df.columns, spark_df.collect())
    right = _rows(list(duck), duck_rows)
    if len(left) != len(right):
        found.append(f"rows {len(left)} != {len(right)}")
    bad = [(a, b) for a, b in zip(left, right, strict=False) if a != b]
    if bad:
        found.append(f"{len(bad)} rows differ, first {bad[0]}")
    return found
