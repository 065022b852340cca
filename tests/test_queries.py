"""Every registered format query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from bitloom import queries

DATA = "/root/testdata/sf0.001"


def plain(rows):
    show = lambda v: round(float(v), 6) if isinstance(v, float) else str(v) if not isinstance(v, (int, type(None))) else v
    return sorted(([show(v) for v in r] for r in rows), key=repr)


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    want = tables.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert plain(got) == plain(want)


def test_repeated_structs_of_long_orders(spark, tables, tmp_path):
    """Orders of more lines, and line numbers higher, than a byte counts."""
    made = f"SELECT * REPLACE (l_orderkey // 1000 AS l_orderkey, CAST(l_linenumber * 100 AS INTEGER) AS l_linenumber) FROM '{DATA}/lineitem.parquet'"
    tables.execute(f"COPY ({made}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got = queries.QUERIES["repeated_structs"](spark, str(tmp_path)).collect()
    want = duckdb.execute(queries.ORACLES["repeated_structs"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet'")).fetchall()
    assert plain(got) == plain(want)


def test_parsed_approximate_keeps_sketches_out_of_its_shuffles(spark):
    """What is dealt by key holds counts alone, and no task gets all values of a flag for exact percentiles."""
    plan = queries.QUERIES["parsed_approximate"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    by_key = [line for line in plan.splitlines() if "Aggregate(keys=[" in line and "partkey" in line.split("keys=[")[1].split("]")[0]]
    assert by_key and not any("approx" in line or "percentile" in line for line in by_key)
    assert "percentile(" not in plan


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(queries.ORACLES) <= set(__spark_entry__.queries())
