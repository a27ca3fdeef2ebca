"""Every registered query against its DuckDB SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tablewise.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (not isinstance(value, (list, np.ndarray)) and pd.isna(value)):
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, float, np.integer, np.floating)):
        return f"{float(value):.6g}"
    return str(value)[:40]


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_lineitem_is_looked_at(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    for name in TABLES:
        if name != "lineitem":
            (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    lines = lines.withColumns({"l_tax": F.when(F.col("l_orderkey") % 2 == 0, F.col("l_tax")), "l_linestatus": F.lit("O"), "l_partkey": F.monotonically_increasing_id()})
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = lambda name: {r["column"] for r in QUERIES[name](spark, str(tmp_path)).where("table = 'lineitem'").collect()}
    assert found("null_ranking") == {"l_tax"} and found("column_issues") == {"l_tax", "l_linestatus", "l_partkey"}
    assert found("pk_candidates") == found("unique_columns") == {"l_partkey"}
    assert found("column_confidence") == set(lines.columns)
    assert QUERIES["mart_archetypes"](spark, str(tmp_path)).where("table = 'lineitem'").count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 8
