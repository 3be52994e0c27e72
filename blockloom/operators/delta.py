"""Moving from one version to another: what is missing, what is reused, what it costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .tree import distinct_chunks


def missing_blocks(needed: DataFrame, *have: DataFrame) -> DataFrame:
    """hash, length, first_pos of what no source has; ordered by first_pos it is the order of the blueprint.
    needed: (hash, length, pos). Only hashes are compared, payloads stay where they are."""
    out = distinct_chunks(needed, by=())
    for h in have:
        out = out.join(h.select("hash"), "hash", "left_anti")
    return out


def reused_blocks(needed: DataFrame, have: DataFrame) -> DataFrame:
    return distinct_chunks(needed, by=()).join(have.select("hash"), "hash", "left_semi")


def fetch(request: DataFrame, blocks: DataFrame) -> DataFrame:
    """Frames for a request (seq, hash): each hash as often as it is asked for; one that no store has fails the query."""
    found = request.join(blocks.select("hash", "length", "payload"), "hash", "left")
    missing = F.raise_error(F.concat(F.lit("unknown block: "), F.lower(F.hex("hash"))))
    return found.select("seq", "hash", "length", F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(missing).alias("payload"))


def transfer_metrics(needed: DataFrame, have: DataFrame, size: int | None = None, blueprint_bytes: int = 0) -> DataFrame:
    """One row for a move: blocks needed, missing and reused, bytes of each, bytes on the wire and what is saved."""
    once = distinct_chunks(needed, by=()).join(have.select("hash").distinct().withColumn("_have", F.lit(1)), "hash", "left")
    gone = F.col("_have").isNull()
    m = once.agg(
        F.count("*").alias("blocks_needed"), F.count_if(gone).alias("blocks_missing"), F.count_if(~gone).alias("blocks_reused"),
        F.coalesce(F.sum(F.col("length").cast("long")), F.lit(0)).alias("distinct_bytes"), F.coalesce(F.sum(F.when(gone, F.col("length").cast("long"))), F.lit(0)).alias("block_bytes"),
    )
    total = needed.agg(F.coalesce(F.sum(F.col("length").cast("long")), F.lit(0)).alias("size")) if size is None else m.select(F.lit(size).cast("long").alias("size"))
    m = m.crossJoin(total)  # one row by one row
    m = m.withColumn("transferred_bytes", F.col("block_bytes") + blueprint_bytes).withColumn("wire_bytes", F.col("block_bytes") + scalars.framing_overhead(F.col("blocks_missing")) + blueprint_bytes)
    return m.withColumns({"saved_fraction": scalars.saved_fraction(F.col("transferred_bytes"), F.col("size")), "wire_saved_fraction": scalars.saved_fraction(F.col("wire_bytes"), F.col("size")), "compression_ratio": scalars.compression_ratio(F.col("wire_bytes"), F.col("block_bytes"))})
