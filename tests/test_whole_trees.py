"""Trees of any depth and size are walked whole."""

from loamspark.operators import graph


def test_deep_tree_and_cycle(spark):
    deep = [("n0", None, 0), *((f"n{i}", f"n{i - 1}", i) for i in range(1, 105))]
    spark.createDataFrame([*deep, ("n1", "n2", 7)], "id string, parent_id string, position int").coalesce(1).createOrReplaceTempView("deep_nodes")
    got = {r["id"]: r for r in graph.flatten(spark, "deep_nodes").collect()}
    assert len(got) == 105 and got["n104"]["depth"] == 104
    assert got["n2"]["path"] == "000000/000001/000002"


def test_row_limit_does_not_bind(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        rows = [("r", None, 0), *((f"c{i}", "r", i) for i in range(200))]
        spark.createDataFrame(rows, "id string, parent_id string, position int").createOrReplaceTempView("wide_nodes")
        assert graph.flatten(spark, "wide_nodes").count() == 201
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_no_rows(spark):
    spark.createDataFrame([], "id string, parent_id string, position int").createOrReplaceTempView("no_nodes")
    assert graph.flatten(spark, "no_nodes").collect() == []
