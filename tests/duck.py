"""Comparison of a query with its SQL in DuckDB."""

import glob
import os

import duckdb


def compare(spark_rows, columns, sql, sf):
    """Rows of a query and of its SQL in DuckDB, as sorted lists of equal text."""
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(columns)
    order = sorted(columns)
    theirs = sorted((tuple(str(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    ours = sorted((tuple(str(r[c]) for c in order) for r in spark_rows), key=repr)
    return ours, theirs
