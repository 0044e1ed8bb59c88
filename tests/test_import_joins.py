from pyspark.sql import functions as F

from graphloom.operators import code
from graphloom.plans import registry


def test_nothing_that_grows_is_broadcast(spark, sf_dir):
    plan = registry.QUERIES["resolve_imports"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_files_of_one_task_are_parsed_by_several(spark):
    name = F.concat(F.lit("m"), "id", F.lit(".py"))
    nodes, _ = code.extract(spark.range(0, 200, 1, 1).select(name.alias("path"), F.lit("def f(): pass\n").alias("text")))
    assert nodes.count() == 400 and len(nodes.inputFiles()) > 1
