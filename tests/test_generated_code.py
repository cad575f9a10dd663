"""The JVM never compiles a method of more than 8,000 bytes; one that is longer is interpreted for every row."""

import pytest

from tallyframe.plans import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["canonical_rows", "quarantine_split", "lineage_explode"])
def test_generated_methods_can_be_compiled(spark, query):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the whole plan is generated at once
    try:
        plan = queries.QUERIES[query](spark, FOLDER)._jdf.queryExecution().executedPlan()
        stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
        assert stages.size() > 1
        assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) <= 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
