"""Order-insensitive comparison of a Spark result with DuckDB SQL."""

import glob
import os

import duckdb


def _cell(value):
    if value is None:
        return "<null>"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value)
    return str(value)


# DuckDB type of each Spark type the results use.
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def spark_rows(df):
    names = sorted(df.columns)
    types = dict(df.dtypes)
    return [(n, TYPES.get(types[n], types[n])) for n in names], sorted(tuple(_cell(v) for v in row) for row in df.select(*names).collect())


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = sorted(tuple(_cell(row[i]) for i in order) for row in result.fetchall())
    return [(names[i], str(result.description[i][1])) for i in order], rows
