"""Run registered queries beside their SQL and compare the rows."""

from __future__ import annotations

import os
from glob import glob

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def sql_rows(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(value):
        if isinstance(value, bool) or value is None:
            return str(value)
        if isinstance(value, (int, float)):
            return f"{float(value):.6f}"
        return str(value)

    return [names[i] for i in order], sorted(tuple(plain(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql, show=3):
    """Empty if both sides give the same rows, else a short report."""
    ours = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    theirs = canonical(*sql_rows(con, sql))
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} vs {theirs[0]}"
    if ours[1] == theirs[1]:
        return "" if ours[1] else "no rows"
    only_ours = sorted(set(ours[1]) - set(theirs[1]))[:show]
    only_theirs = sorted(set(theirs[1]) - set(ours[1]))[:show]
    return f"{len(ours[1])} vs {len(theirs[1])} rows\n  spark only: {only_ours}\n  sql only: {only_theirs}"
