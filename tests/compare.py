"""Whole results of a Spark query and of SQL in comparable form."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        table, ext = os.path.splitext(name)
        if ext == ".parquet":
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def _plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return sorted(df.columns), _rows(df.columns, df.collect())


def sql_rows(con, sql):
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    return sorted(columns), _rows(columns, cursor.fetchall())


def sql_types(con, sql):
    return {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
