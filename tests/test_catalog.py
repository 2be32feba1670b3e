"""Every query with SQL gives the SQL's rows; the others give rows and keep their invariants."""

import pytest

import __spark_entry__ as entry
from loomgene.plans import catalog
from tests.compare import duck, rows_of, rows_of_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duckdb_tables():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, duckdb_tables, name):
    assert rows_of(catalog.QUERIES[name](spark, FOLDER)) == rows_of_sql(duckdb_tables, catalog.ORACLE[name])


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_phased_genotypes_keep_what_was_called(spark):
    from pyspark.sql import functions as F

    from loomgene import fixtures as fx

    calls = fx.calls(spark, FOLDER).select("chrom", "pos", "sample", F.col("a1").alias("c1"), F.col("a2").alias("c2"))
    for name in ("phased_genotypes", "phased_with_panel"):
        p = catalog.QUERIES[name](spark, FOLDER)
        both = p.join(calls, ["chrom", "pos", "sample"])
        assert p.count() == calls.count() == both.count()
        bad = both.where("c1 is not null and c2 is not null and (least(a1, a2) <> least(c1, c2) or greatest(a1, a2) <> greatest(c1, c2))")
        assert bad.count() == 0 and p.where("a1 is null or a2 is null or a1 > 1 or a2 > 1").count() == 0


def test_em_matches_sum_to_all_rows(spark):
    r = catalog.QUERIES["em_matches"](spark, FOLDER).first()
    assert r.match + r.mismatch == pytest.approx(spark.read.parquet(f"{FOLDER}/events.parquet").count(), abs=1e-3)
