"""Settlements with ceilings and revived references on literal rows."""

from pyspark.sql import functions as F

from loamspark.operators import changes, history


def test_a_ceiling_may_be_settled_again(spark):
    log = spark.createDataFrame([("a", 1, "ceiling"), ("a", 2, "done"), ("a", 3, "failed"), ("b", 1, "ceiling"), ("b", 2, "ceiling"), ("c", 1, "running"), (None, 1, "done")], "k string, n int, s string")
    got = history.settled_or_stopped(log, "k", "n", "s", F.col("s").isin("done", "failed"), F.col("s") == "ceiling")
    assert sorted((str(r["k"]), r["n"], r["s"]) for r in got.collect()) == [("None", 1, "done"), ("a", 2, "done"), ("b", 2, "ceiling")]
    assert history.settled_or_stopped(log.limit(0), "k", "n", "s", F.lit(True), F.lit(False)).count() == 0


def test_references_are_revived(spark):
    old = spark.createDataFrame([("x", 1, "h", True), ("x", 2, "h", True), ("y", 1, "h", False)], "system string, id int, hash string, missing boolean")
    new = spark.createDataFrame([("x", 1, "new"), ("z", 9, "new"), ("z", 9, "new")], "system string, id int, hash string")
    got = changes.revived(old, new, ["system", "id"])
    assert sorted(map(tuple, got.collect())) == [("x", 1, "new", False), ("x", 2, "h", True), ("y", 1, "h", False), ("z", 9, "new", False)]
    assert changes.revived(old, new.limit(0), ["system", "id"]).count() == 3
