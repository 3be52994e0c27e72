"""Connected components of an edge table by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise


def _stars(e: DataFrame, large: bool) -> DataFrame:
    """e: distinct (u, v), u > v. Large star: each vertex links its greater neighbours to the least one it knows; small
    star: its lesser neighbours and itself."""
    rev = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
    sides = e.unionByName(rev) if large else e
    least = materialise(sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if large:
        out = lookup(rev, least, ["u"], "inner", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = lookup(e, least, ["u"], "inner", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _forest(e: DataFrame) -> bool:
    """Whether every vertex on the greater side has one edge, to a vertex that is on no greater side: stars, hence done."""
    if e.groupBy("u").count().filter("count > 1").head(1):
        return False
    return not e.select(F.col("v").alias("u")).distinct().join(e.select("u"), "u", "left_semi").head(1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for every node that has an edge the least node of its component. Self edges and nulls don't count.
    Takes about log of the longest path rounds; each is written to the shared folder."""
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialise(e, "edges")
    while not _forest(e):
        e = materialise(_stars(e, large=True), "large-star")
        e = materialise(_stars(e, large=False), "small-star")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) after more edges (a, b): only the classes that they connect are looked at again."""
    if not edges.head(1):
        return labels
    ends = edges
    for x in ("a", "b"):
        of = labels.select(F.col("node").alias(f"_n{x}"), F.col("label").alias(f"_l{x}"))
        ends = ends.join(of, F.col(x) == F.col(f"_n{x}"), "left").withColumn(x, F.coalesce(f"_l{x}", x)).select("a", "b")
    top = materialise(components(ends).select(F.col("node").alias("_t"), F.col("label").alias("_top")), "joined-classes")
    fresh = top.join(labels.select(F.col("label").alias("_k")).distinct(), F.col("_t") == F.col("_k"), "left_anti").select(F.col("_t").alias("node"), F.col("_top").alias("label"))
    return labels.join(top, F.col("label") == F.col("_t"), "left").select("node", F.coalesce("_top", "label").alias("label")).unionByName(fresh)
