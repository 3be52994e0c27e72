"""Pieces that several operators share: reading tables, scratch tables in the shared folder, skew-safe lookups."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space and \\t \\n \\v \\f \\r.
WS_CHARS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key counts as hot when it holds more than 1/HOT_PARTS of all rows, so there are fewer than HOT_PARTS hot keys.
HOT_PARTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset (tests, a local session) one of our own."""
    path, set_ = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    if not path and set_.isDefined():
        path = set_.get()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="blockloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows of whole texts go to Python workers in batches of this size, so that neither side holds much of a partition.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return a scan of it: lineage ends at files that survive
    the loss of any executor, and what several branches read is computed once. Folders lie under
    <shared>/blockloom-<application id>/ and can be deleted once the application's results are written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/blockloom-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def writing(uri: str):
    """A stream to uri that appears there only when it is whole; a second attempt at a task writes the same bytes again."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{os.getpid()}-{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, path)


def boxed(docs: DataFrame, text: str = "text") -> DataFrame:
    """_row, the whole row as one struct, beside _t, its text (null: empty): whatever else docs has, no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))


def unboxed(df: DataFrame, docs: DataFrame, changed: dict[str, Column] | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """The columns of docs again, those in `changed` anew, and `more` of df (in place of columns of docs so named)."""
    changed = changed or {}
    cols = [(changed[c] if c in changed else F.col("_row").getField(c)).alias(c) for c in docs.columns if c not in more]
    return df.select(*cols, *more)


def with_text(docs: DataFrame, text: Column) -> dict[str, Column]:
    """A new text, and n_chars after it where docs has one."""
    return {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def doc_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """A key for a row of documents that is never null: repeated rows share it, rows that share only the id do not."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("dk"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th")]


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str, weight: str, total: int) -> DataFrame:
    """left join right (how: inner or left_semi) where right has one row for each key and `weight` tells how many rows
    of left it meets. Keys with more than total/HOT_PARTS rows (fewer than HOT_PARTS by that very bound, so safe to
    broadcast) are joined without a shuffle; in what remains no key holds more than 1/HOT_PARTS of the rows. A left of up to
    2 * HOT_PARTS rows is one small task's work whatever its keys, and is joined plainly."""
    if total <= 2 * HOT_PARTS:
        return left.join(right.drop(weight), keys, how)
    hot = F.col(weight) * HOT_PARTS > total
    heavy = right.filter(hot).drop(weight)
    light = right.filter(~hot).drop(weight)
    a = left.join(F.broadcast(heavy), keys, how)
    b = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return a.unionByName(b)
