"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _value(value):
    return repr(value) if isinstance(value, float) else str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, sf_dir: str, query, sql: str) -> list[str]:
    """Differences between the two results; empty when they are equal."""
    df = query(spark, sf_dir)
    mine = _rows(df.columns, df.collect())
    connection = duck(sf_dir)
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    types = dict(zip(names, [str(column[1]) for column in result.description]))
    other = _rows(names, result.fetchall())
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} / {sorted(names)}")
    for name, kind in df.dtypes:
        if name in types and types[name] != KINDS.get(kind, kind.upper()):
            problems.append(f"type of {name}: {kind} / {types[name]}")
    if not mine:
        problems.append("no rows")
    if len(mine) != len(other):
        problems.append(f"rows {len(mine)} / {len(other)}")
    if mine != other:
        only = [r for r in mine if r not in set(other)][:3]
        missing = [r for r in other if r not in set(mine)][:3]
        problems.append(f"only Spark {only}; only SQL {missing}")
    return problems


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from trialgrid.session import build_session

    directory = sys.argv[1]
    wanted = sys.argv[2:]
    session = build_session("oracle", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    session.sparkContext.setLogLevel("OFF")
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            found = compare(session, directory, query, oracles[name])
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - started:.1f}s", *found, flush=True)
    print("failing:", bad)
