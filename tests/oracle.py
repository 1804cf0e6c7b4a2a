"""Side-by-side runs of a query and its DuckDB statement."""

import math
import os
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir: str = SF_DIR):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if Path(path).is_dir() else path}'")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in found))


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, query, sql, sf_dir: str = SF_DIR):
    df = query(spark, sf_dir)
    relation = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == kinds
    mine, other = rows(df.columns, [tuple(r) for r in df.collect()]), rows(relation.columns, relation.fetchall())
    assert mine == other, next(((a, b) for a, b in zip(mine, other) if a != b), (len(mine), len(other)))
    return len(mine)
