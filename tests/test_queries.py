"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from tokenloom.plans.fixtures import TABLES
from tokenloom.plans.registered import CHECKS, QUERIES
from tools.check import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())
    assert set(QUERIES) - set(CHECKS) == {"tokenize_bpe"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert len(got)
    if name in CHECKS:
        assert compare(got, tables.execute(CHECKS[name]).df()) == "ok"


@pytest.mark.parametrize("name", ["batch_schedule", "batch_resume", "step_manifest"])
def test_schedules_lie_in_many_partitions(spark, name):
    rows = QUERIES[name](spark, SF_DIR)
    filled = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(filled) >= 4 and max(r["count"] for r in filled) <= 0.6 * sum(r["count"] for r in filled)


def test_entry(spark):
    assert entry(spark).columns == ["split", "shard", "n_tokens", "digest"]
