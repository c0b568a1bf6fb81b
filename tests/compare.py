"""Order-insensitive comparison of a Spark result with DuckDB's."""

import glob
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def connect(sf: str = SF):
    con = duckdb.connect(config={"max_temp_directory_size": "2GB"})
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _plain(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    kind = type(x).__name__
    if "bool" in kind:
        return bool(x)
    if "int" in kind:
        return int(x)
    if "float" in kind:
        return None if x != x else int(x) if x == int(x) and abs(x) < 1e15 else round(float(x), 9)
    return x


def rows(df: pd.DataFrame, columns: list[str]) -> list[str]:
    return sorted(repr([_plain(x) for x in r]) for r in df[columns].astype(object).values.tolist())


def assert_same(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> None:
    columns = sorted(spark_df.columns)
    assert columns == sorted(duck_df.columns)
    assert rows(spark_df, columns) == rows(duck_df, columns)
