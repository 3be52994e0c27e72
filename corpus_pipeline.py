"""From documents to packed training windows: five stages, each of them one operator of blockloom.llm over all that the
stage before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm import lines, mixing, neardup, packing, quality
from blockloom.llm.common import materialise, table

#: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: quality.stage(docs)),
    ("line_dedup", lambda spark, docs, sf_dir: lines.stage(docs)),
    ("near_dedup", lambda spark, docs, sf_dir: neardup.stage(docs)),
    ("mix_sources", lambda spark, docs, sf_dir: mixing.mix(docs)),
    ("pack_windows", lambda spark, docs, sf_dir: packing.stage(docs)),
]

#: Tokens and signatures are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each is written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, f in first:
        docs = materialise(f(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
