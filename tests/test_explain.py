"""Plans of the queries: no product of two sides, columns pruned at the scan."""

import pytest

from loomgene.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if not n.startswith(("vcf_round", "streamed", "phased"))))
def test_no_product_of_two_sides(spark, name):
    plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_scans_are_pruned(spark):
    plan = catalog.QUERIES["site_quality"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan
