"""Trees of digests: order doesn't count, repeats and nulls do, and a changed row is found in its branch alone."""

from pyspark.sql import functions as F

from docquarry.operators import digest_tree as T


def test_roots_and_branches(spark, tmp_path):
    rows = [(i % 90 if i % 10 else None, f"t{i}", None if i % 7 else i) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, t string, v int")
    root = lambda x: [(r.n, r.digest) for r in T.digest_tree(x, "k").where("level = 0").collect()]
    assert root(df) == root(df.repartition(5).select("v", "t", "k")) and root(df)[0][0] == 120
    assert root(df) != root(df.union(df.limit(1))) and root(df) != root(df.fillna(0, ["v"])) and root(df.limit(0)) == []
    later = df.where("t <> 't5'").withColumn("v", F.when(F.col("t") == "t11", 1).otherwise(F.col("v"))).union(spark.createDataFrame([(7777, "new", 1), (3, "t3", None)], df.schema))
    a, b = T.write_by_leaf(df, str(tmp_path / "a"), "k"), T.write_by_leaf(later, str(tmp_path / "b"), "k")
    assert sorted(map(tuple, T.changed_rows(a, b, "k").collect())) == [(3, "changed"), (5, "changed"), (11, "changed"), (7777, "added")]
    assert T.changed_rows(a, a, "k").count() == 0
    leaves = T.differing_leaves(T.digest_tree(df, "k"), T.digest_tree(df.where("t <> 't5'"), "k"))
    assert leaves.count() == 1 and leaves.first().node == df.where("t = 't5'").select(T.leaf_of("k")).first()[0]
    read = T.rows_of_leaves(a, leaves)
    scan = next(x for x in read._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x)
    assert "_branch" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0] and read.count() >= 1


def test_no_build_is_dealt_to_a_fixed_number_of_tasks(spark, small):
    from docquarry.plans import indexed

    found = indexed.build_orders(spark, small)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "REPARTITION_BY_NUM" not in plan
    assert found.first().roots == 1
