"""Rows of Spark and of SQL in one comparable form."""

from __future__ import annotations

import math
import os


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "NULL"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, float) or type(x).__name__ == "Decimal":
            return f"{float(x) + 0.0:.6g}"
        return str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def tables(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con
