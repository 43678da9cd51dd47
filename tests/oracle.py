"""Runs a query and its oracle over one folder of tables and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):  # decimals
        return int(v) if v == int(v) else round(float(v), 6)
    return v


def rows(found, names) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in found), key=repr)


def differences(spark, con, query, sql, sf_dir) -> str:
    df = query(spark, sf_dir)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, have = rows(got.fetchall(), names), rows([tuple(r) for r in df.collect()], df.columns)
    if want == have:
        return ""
    odd = [x for x in have if x not in want][:2], [x for x in want if x not in have][:2]
    return f"{len(have)} and {len(want)} rows; only here {odd[0]}, only there {odd[1]}"
