"""Compare registered queries with their reference SQL on given tables.

Run as a script: python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "FLOAT": "float", "BOOLEAN": "boolean"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    keys = frame.map(lambda v: (v is None, repr(float(v)) if isinstance(v, float) else repr(v)))
    order = keys.apply(tuple, axis=1).sort_values(kind="stable").index if len(frame) else frame.index
    return frame.loc[order].reset_index(drop=True)


def differences(spark_df, connection, sql: str) -> list[str]:
    """What differs in schema, row count or values; empty if nothing does."""
    result = connection.execute(sql)
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    expected = canonical(result.fetchdf())
    types = dict(spark_df.dtypes)
    if types != kinds:
        return [f"schema: spark {types} sql {kinds}"]
    actual = canonical(spark_df.toPandas())
    if len(actual) != len(expected):
        return [f"rows: spark {len(actual)} sql {len(expected)}"]
    wrong = []
    for column in actual.columns:
        for i, (a, e) in enumerate(zip(actual[column], expected[column])):
            if a != e:
                wrong.append(f"{column}[{i}]: spark {str(a)[:200]!r} sql {str(e)[:200]!r}")
                break
    return wrong


if __name__ == "__main__":
    import __spark_entry__ as entry
    from varlex.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    chosen = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        started = time.time()
        try:
            found = query(spark, sf_dir)
            if name in sql:
                wrong = differences(found, connection, sql[name])
                note = "ok" if not wrong else "DIFFERS " + " ; ".join(wrong)
            else:
                wrong, note = [], f"rows only: {found.count()}"
        except Exception as error:  # noqa: BLE001
            wrong, note = [1], f"ERROR {type(error).__name__} {str(error)[:600]}"
        bad += bool(wrong)
        print(f"{name:28s} {time.time() - started:6.2f}s {note}", flush=True)
    print("failed:", bad)
