"""Neighbourhoods, trees and ancestors of edge tables, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import kept


def both_ways(edges: DataFrame) -> DataFrame:
    """node, to, relation, label: each edge (relation, source, target, label, inverse) from both ends, with the label that reads that way."""
    there = edges.select(F.col("source").alias("node"), F.col("target").alias("to"), "relation", "label")
    return there.unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("to"), "relation", F.col("inverse").alias("label")))


def touching(edges: DataFrame) -> DataFrame:
    """node, n: how many edges (source, target) touch each node, from either end; an edge from a node to itself touches it once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("n"))


def ring(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """node, depth, relation, via, label: the nodes within ``depth`` steps of the start nodes (themselves left out), how near they are, and the edge and node that they are reached by first.

    Of equally near ways the one with the least relation, then the least node, stays; label reads from via to node. edges has relation, source, target, label, inverse. A
    step joins the frontier alone, one row for each new node, so a walk never revisits; it is written before the next, so each step reads the edges once.
    """
    links = both_ways(edges)
    way = {"relation": edges.schema["relation"].dataType, "via": edges.schema["source"].dataType, "label": edges.schema["label"].dataType}
    frontier = kept(start.select("node").distinct().select("node", F.lit(0).alias("depth"), *[F.lit(None).cast(t).alias(n) for n, t in way.items()]), "ring")
    seen = frontier
    for d in range(1, depth + 1):
        step = frontier.select(F.col("node").alias("via")).join(links.withColumnRenamed("node", "via"), "via").join(seen.select(F.col("node").alias("to")), "to", "left_anti")
        least = step.groupBy("to").agg(F.min(F.struct("relation", "via", "label")).alias("way"))
        frontier = kept(least.select(F.col("to").alias("node"), F.lit(d).alias("depth"), "way.*"), "ring")
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def flatten(spark: SparkSession, view: str | DataFrame, root: str = "parent_id is null") -> DataFrame:
    """id, depth, path of a tree (a table or its name; id, parent_id, position) in pre-order by path; each level is one join, written before the next.

    Trees may have any depth and number of rows. A node that is its own ancestor is left out where it comes again.
    """
    nodes = spark.table(view) if isinstance(view, str) else view
    width = max(6, nodes.agg(F.max(F.length(F.col("position").cast("string")))).first()[0] or 0)  # wide enough for every position
    at = F.lpad(F.col("position").cast("string"), width, "0")
    children = nodes.where("parent_id is not null").select("parent_id", F.col("id").alias("child"), at.alias("at"))
    level = kept(nodes.where(root).select("id", F.lit(0).alias("depth"), at.alias("path"), F.array("id").alias("line")), "tree")
    levels = []
    while not level.isEmpty():
        levels.append(level.drop("line"))
        step = level.join(children, F.col("parent_id") == F.col("id")).where(~F.coalesce(F.array_contains("line", F.col("child")), F.lit(False)))
        level = kept(step.select(F.col("child").alias("id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit("/"), "at").alias("path"), F.concat("line", F.array("child")).alias("line")), "tree")
    return reduce(DataFrame.unionByName, levels, level.drop("line"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """id, ancestor, distance of every node (id, parent_id): one join for each level, so few steps on wide trees; a node that comes again ends its line."""
    parents = nodes.where("parent_id is not null").select(F.col("id").alias("ancestor"), F.col("parent_id").alias("next"))
    level = kept(parents.select(F.col("ancestor").alias("id"), F.col("next").alias("ancestor"), F.lit(1).alias("distance"), F.array("ancestor", "next").alias("line")), "ancestors")
    levels = []
    while not level.isEmpty():
        levels.append(level.drop("line"))
        step = level.join(parents, "ancestor").where(~F.array_contains("line", F.col("next")))
        level = kept(step.select("id", F.col("next").alias("ancestor"), (F.col("distance") + 1).alias("distance"), F.concat("line", F.array("next")).alias("line")), "ancestors")
    return reduce(DataFrame.unionByName, levels, level.drop("line"))
