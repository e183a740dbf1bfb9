"""Every registered query against its SQL on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from notaflow.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "null"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(cell, v)) + "]"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.number)):
        return "null" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return str(v)[:19].replace(" 00:00:00", "")
    return str(v)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    if name in catalog.SQL:
        want = duck.execute(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


@pytest.mark.parametrize("name", ["pair_core", "invoice_numbers"])
def test_numbers_like_years_and_amounts_between_cents(spark, name, tmp_path):
    c = duckdb.connect()
    c.execute("CREATE TABLE orders AS SELECT CAST(k AS BIGINT) AS o_orderkey, 1::BIGINT AS o_custkey, TIMESTAMP '1995-01-01' AS o_orderdate FROM unnest([43419, 202511, 2025119, 2030002, 20251193]) t(k)")
    c.execute("""CREATE TABLE lineitem AS SELECT CAST(k AS BIGINT) AS l_orderkey, p AS l_extendedprice, s AS l_discount, t AS l_tax
        FROM (VALUES (43419, 5145.75::DOUBLE, 0.03::DOUBLE, 0.02::DOUBLE), (43419, 38908.18, 0.04, 0.02), (202511, 10.0, 0, 0), (2025119, 20.0, 0, 0), (2030002, 30.0, 0, 0), (20251193, 40.0, 0, 0)) v(k, p, s, t)""")
    for t in ("orders", "lineitem"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got, want = catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), c.execute(catalog.SQL[name]).df()
    exact = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None)))
    assert exact(got) == exact(want)


def test_company_in_mail_with_suppliers_beyond_the_own_ones(spark, tmp_path):
    c = duckdb.connect()
    c.execute("CREATE TABLE orders AS SELECT k AS o_orderkey FROM range(0, 315) t(k)")
    c.execute("CREATE TABLE supplier AS SELECT k AS s_suppkey FROM unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 4000000000, NULL]) t(k)")
    for t in ("orders", "supplier"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got, want = catalog.QUERIES["company_in_mail"](spark, str(tmp_path)).toPandas(), c.execute(catalog.SQL["company_in_mail"]).df()
    assert len(got) == 315
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
