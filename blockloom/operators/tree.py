"""Blueprint trees as tables: walks, statistics, distinct chunks."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def walk(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id", ordinal: str = "ordinal") -> DataFrame:
    """nodes with depth and path (ordinals from the root): ordered by path they stand in preorder. One join a level; each
    takes only the nodes of the level above, so all levels together touch a node twice."""
    level = nodes.filter(F.col(parent).isNull()).withColumns({"depth": F.lit(0), "path": F.array(F.col(ordinal).cast("int"))})
    out = level
    rest = nodes.filter(F.col(parent).isNotNull())
    for depth in count(1):
        up = level.select(F.col(node).alias(parent), F.col("path").alias("_p"))
        level = rest.join(up, parent).withColumns({"depth": F.lit(depth), "path": F.concat("_p", F.array(F.col(ordinal).cast("int")))}).select(*out.columns)
        if not level.head(1):
            break
        out = out.unionByName(level)
    return out


def in_blueprint_order(refs: DataFrame, order: list[str], by: str = "version_id") -> DataFrame:
    """refs with pos, its place in the walk of its version. Versions are walked independently."""
    return refs.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


def distinct_chunks(refs: DataFrame, by: tuple[str, ...] = ("version_id",), pos: str = "pos") -> DataFrame:
    """A row for each hash of a version: the length it was first seen with, and where (first_pos)."""
    return refs.groupBy(*by, "hash").agg(F.min_by("length", pos).alias("length"), F.min(pos).alias("first_pos"))


def blueprint_stats(nodes: DataFrame, refs: DataFrame, by: str = "version_id") -> DataFrame:
    """containers, blobs, chunk_refs, distinct_chunks, blob_bytes of each version."""
    n = nodes.groupBy(by).agg(F.count_if(F.col("kind") == "container").alias("containers"), F.count_if(F.col("kind") == "blob").alias("blobs"), F.coalesce(F.sum(F.when(F.col("kind") == "blob", F.col("size"))), F.lit(0)).cast("long").alias("blob_bytes"))
    per = refs.groupBy(by, "hash").agg(F.count("*").alias("c"))
    r = per.groupBy(by).agg(F.sum("c").alias("chunk_refs"), F.count("*").alias("distinct_chunks"))
    return n.join(r, by, "left").select(by, "containers", "blobs", F.coalesce("chunk_refs", F.lit(0)).alias("chunk_refs"), F.coalesce("distinct_chunks", F.lit(0)).alias("distinct_chunks"), "blob_bytes")


def container_counters(events: DataFrame, by: str = "version_id") -> DataFrame:
    """Opened and opaque containers, counted from rows: accumulators would count a retried task twice."""
    return events.groupBy(by).agg(F.count_if(F.col("event") == "container").alias("containers"), F.count_if(F.col("event") == "opaque").alias("opaque_containers"))
