from pyspark.sql import functions as F

from tessel.plans import REGISTRY, PlanNode, PlanRule, apply_rules, executed_operators, optimized, plan_tree, probe_fields
from tessel.session import BASE, PROFILES, use_profile


def test_rules_replace_only_full_matches():
    scan, other = PlanNode("Scan", ("order_id", "x")), PlanNode("Scan", ("x",))
    plan = PlanNode("BroadcastHashJoin", ("order_id",), (scan, other))
    out = apply_rules(plan)
    assert out.names() == ["NativeBroadcastHashJoin", "NativeScan", "Scan"]
    assert apply_rules(out) == out and apply_rules(plan, []) == plan
    assert PlanRule(REGISTRY["AmountProject"]).apply(plan) == plan and len(REGISTRY) == 5


def test_trees_and_window_plans(spark):
    df = spark.range(100).groupBy((F.col("id") % 3).alias("g")).agg(F.count("*").alias("n"))
    df.collect()
    names = executed_operators(df)
    assert names.count("HashAggregate") == 2 and "AdaptiveSparkPlan" in names[0]
    assert plan_tree(df).output == ("g", "n")
    assert "Window" in optimized(spark.range(5).selectExpr("rank() over (order by id)"))


def test_probe(spark):
    found = probe_fields(spark, "org.apache.spark.sql.Row$", {"MODULE$": None, "none": None})
    assert found == {"MODULE$": True, "none": False}


def test_profiles(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    use_profile(spark, "no_broadcast")
    df = spark.range(10).join(spark.range(10), "id")
    df.collect()
    assert "SortMergeJoin" in executed_operators(df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert BASE["spark.sql.ansi.enabled"] == "true" and set(PROFILES) >= {"default", "merge_join", "no_broadcast"}


MEMORY = """
import sys; sys.path.insert(0, {root!r})
from tessel.session import session
spark = session("small", master="local[2]", spark__driver__memory="600m", spark__ui__enabled="false", spark__sql__shuffle__partitions="48", spark__sql__adaptive__coalescePartitions__enabled="false")
spark.sparkContext.setLogLevel("ERROR")
from pyspark.sql import functions as F
df = spark.range(0, 3_000_000, 1, 4).select(F.xxhash64("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
ordered = df.orderBy("k")
first = next(ordered.toLocalIterator())
n = sum(r.n for r in ordered.groupBy(F.spark_partition_id()).agg(F.count("t").alias("n")).collect())
groups = df.groupBy("k").agg(F.first("t").alias("t"), F.count("*").alias("n")).where("n = 1").count()
print("RESULT", n, groups, first.k < 0)
"""


def test_sort_and_aggregate_finish_in_little_memory():
    """A sort and an aggregate of some hundred megabytes with a heap of 600 MB spill and finish; a consumer that stops at the first row
    leaves nothing behind that the next query would lack."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", MEMORY.format(root=root)], capture_output=True, text=True, timeout=400)
    assert "RESULT 3000000 3000000 True" in out.stdout, out.stderr[-3000:]
