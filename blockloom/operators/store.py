"""The block store: each distinct block once, by SHA-256, in Parquet partitioned by the hash's first byte."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..model import ChunkParams

PREFIX = "p"
#: Hashes of a request that are broadcast (32 bytes each); more are joined by a shuffle.
ASKED = 500_000


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """One row for each hash: hash, length, payload (of any copy, they are equal). Copies meet after a map-side pass."""
    return blocks.groupBy("hash").agg(F.first("length").alias("length"), F.first("payload").alias("payload"))


def put_is_new(blocks: DataFrame, order: str) -> DataFrame:
    """blocks with is_new: true for the first put of a hash in that order, as a store that starts empty answers."""
    first = blocks.groupBy("hash").agg(F.min(order).alias("_first"))
    return blocks.join(first, "hash").withColumn("is_new", F.col(order) == F.col("_first")).drop("_first")


def store_stats(blocks: DataFrame) -> DataFrame:
    """chunk_count and stored_bytes over distinct hashes; only (hash, length) is read and shuffled."""
    once = blocks.groupBy("hash").agg(F.first("length").alias("length"))
    return once.agg(F.count("*").alias("chunk_count"), F.coalesce(F.sum(F.col("length").cast("long")), F.lit(0)).alias("stored_bytes"))


class BlockStore:
    """A store bound to one set of chunk parameters: path/params.json, path/blocks.

    A hash is uniform, so its first byte spreads any corpus over 256 folders and a join on it never skews. Appends are
    committed by Spark's output committer; two writers that race may both write a block, so every read takes a hash once."""

    def __init__(self, spark: SparkSession, path: str, params: ChunkParams, force: bool = False) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._of("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        wanted = {"formatVersion": 1, "hashAlgorithm": model.HASH_ALGORITHM, "chunkMin": params.min, "chunkAvg": params.avg, "chunkMax": params.max}
        have = self._params()
        if have and have != wanted:
            if not force:
                raise ValueError(f"the store was written with {have}, not {wanted}; open it with force=True to start anew")
            self._fs.delete(self._of("blocks"), True)
            have = None
        if not have:  # at once, so that the guard holds for a store that is still empty
            spark.createDataFrame([(json.dumps(wanted),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/params.json")

    def _of(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _params(self) -> dict | None:
        return json.loads(self.spark.read.text(f"{self.path}/params.json").first()[0]) if self._fs.exists(self._of("params.json")) else None

    def blocks(self) -> DataFrame:
        if not self._fs.exists(self._of("blocks")):
            return self.spark.createDataFrame([], model.BLOCKS)
        return self.spark.read.schema(f"{model.BLOCKS}, {PREFIX} string").parquet(f"{self.path}/blocks")

    def append(self, blocks: DataFrame) -> int:
        """Write the blocks whose hash is not there yet; returns how many. The stored side of the anti join is hashes only."""
        new = distinct_blocks(blocks.select("hash", "length", "payload")).join(self.blocks().select("hash"), "hash", "left_anti")
        before = self.count()
        new.withColumn(PREFIX, F.hex(F.substring("hash", 1, 1))).write.mode("append").partitionBy(PREFIX).parquet(f"{self.path}/blocks")
        return self.count() - before

    def import_from(self, other: DataFrame) -> int:
        return self.append(other)

    def count(self) -> int:
        return self.blocks().select("hash").distinct().count()

    def stats(self) -> DataFrame:
        return store_stats(self.blocks())

    def contains(self, hashes: DataFrame) -> DataFrame:
        return hashes.join(self.blocks().select("hash").distinct(), "hash", "left_semi")

    def find(self, hashes: DataFrame) -> DataFrame:
        """hash, length, payload of those hashes that are there, each once. Only they leave the scan: a request of up to ASKED
        hashes is broadcast to it (and its prefixes prune folders), a larger one meets the blocks by hash before copies are
        dropped, so other payloads are never grouped."""
        asked = hashes.select("hash").distinct().withColumn(PREFIX, F.hex(F.substring("hash", 1, 1)))
        n = asked.limit(ASKED + 1).count()
        stored = self.blocks()
        if PREFIX not in stored.columns:
            return stored.select("hash", "length", "payload")
        if n <= ASKED:
            folders = [r[0] for r in asked.select(PREFIX).distinct().collect()]  # 256 at most
            stored, asked = stored.filter(F.col(PREFIX).isin(folders)), F.broadcast(asked)
        return distinct_blocks(stored.join(asked, [PREFIX, "hash"], "left_semi"))

    def get(self, hashes: DataFrame) -> DataFrame:
        """hash, length, payload of each hash asked for; one that is not there fails the query."""
        found = hashes.select("hash").distinct().join(self.find(hashes), "hash", "left")
        return found.withColumn("payload", F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("block not in store: "), F.lower(F.hex("hash"))))))


def store_import(blocks: DataFrame, other: DataFrame) -> DataFrame:
    """The blocks of `other` that `blocks` lacks."""
    return distinct_blocks(other).join(blocks.select("hash"), "hash", "left_anti")


def composite(*sources: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """hash, length, payload from the first source that has the hash; of those that are wanted, where that is said: other payloads
    are dropped before anything is grouped."""
    if wanted is not None:
        asked = wanted.select("hash").distinct()
        asked = F.broadcast(asked) if asked.limit(ASKED + 1).count() <= ASKED else asked
        sources = tuple(s.join(asked, "hash", "left_semi") for s in sources)
    ranked = [s.select("hash", F.struct(F.lit(i).alias("source"), "length", "payload").alias("x")) for i, s in enumerate(sources)]
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    return out.groupBy("hash").agg(F.min_by("x", F.col("x.source")).alias("x")).select("hash", "x.length", "x.payload", "x.source")


def write_pack(blocks: list[tuple[bytes, bytes]], folder: str) -> None:
    """An append-only pack: data.pack holds payloads one after the other, index.bin a record of hash, int64 offset and
    int32 length (big endian) for each."""
    os.makedirs(folder, exist_ok=True)
    at = os.path.getsize(f"{folder}/data.pack") if os.path.exists(f"{folder}/data.pack") else 0
    with open(f"{folder}/data.pack", "ab") as pack, open(f"{folder}/index.bin", "ab") as index:
        for hash_, payload in blocks:
            pack.write(payload)
            index.write(hash_ + at.to_bytes(8, "big") + len(payload).to_bytes(4, "big"))
            at += len(payload)


def replay_index(index: bytes, pack_size: int) -> list[tuple[bytes, int, int]]:
    """The records that the pack vouches for: a partial last record is dropped, and from the first one that points past the
    end of the pack on everything is torn."""
    out = []
    for i in range(0, len(index) // 44 * 44, 44):
        offset, length = int.from_bytes(index[i + 32 : i + 40], "big"), int.from_bytes(index[i + 40 : i + 44], "big")
        if offset < 0 or offset + length > pack_size:
            break
        out.append((index[i : i + 32], offset, length))
    return out


def read_pack(spark: SparkSession, folder: str, partitions: int = 8) -> DataFrame:
    """The blocks of such a pack, read by range in tasks; the folder must be one that all executors see."""
    with open(f"{folder}/index.bin", "rb") as f:
        records = replay_index(f.read(), os.path.getsize(f"{folder}/data.pack"))

    def load(batches):
        import pyarrow as pa

        with open(f"{folder}/data.pack", "rb") as pack:
            for b in batches:
                for h, offset, length in zip(*(b.column(c).to_pylist() for c in ("hash", "offset", "length"))):
                    pack.seek(offset)
                    yield pa.RecordBatch.from_arrays([pa.array([h], pa.binary()), pa.array([length], pa.int32()), pa.array([pack.read(length)], pa.binary())], ["hash", "length", "payload"])

    return spark.createDataFrame(records, "hash binary, offset long, length int").repartition(partitions).mapInArrow(load, model.BLOCKS)


def first_version_wins(files: DataFrame) -> DataFrame:
    """Files with `rank` by path among those of the same id; all but rank 1 collide."""
    return files.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("path")))
