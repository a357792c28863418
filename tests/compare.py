"""Side-by-side comparison of a query with its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([value(x) for x in v])
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def agree(spark, query, sql, sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    wanted = connection.sql(sql)
    found = query(spark, sf_dir)
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(wanted.columns, wanted.fetchall())
