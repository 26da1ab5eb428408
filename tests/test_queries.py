"""Every registered query of the star schema against its SQL, on the smallest tables."""

import math
import os

import pytest

from cladeworks.plans import catalogue

DATA = os.environ.get("CLADEWORKS_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got
    if name in catalogue.ORACLES:
        found = duck.sql(catalogue.ORACLES[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["item_id", "class_id", "membership_type", "source", "is_primary"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append([sorted(map(str, catalogue.QUERIES[q](spark, DATA).collect())) for q in ("membership_all", "group_split", "duplicate_mapping")])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]
