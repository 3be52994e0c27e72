"""The data model: table schemas, chunk parameters, limits and closed domains."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum, IntEnum

from pyspark.sql import types as T

HASH = T.BinaryType()  # 32 bytes of SHA-256; Spark orders binary unsigned
HASH_ALGORITHM = "SHA-256"
CHUNK_REF = T.StructType([T.StructField("hash", HASH), T.StructField("length", T.IntegerType())])

STORE_PARAMS = "format_version int, hash_algorithm string, chunk_min int, chunk_avg int, chunk_max int"
VERSIONS = (
    "id string, file_name string, size long, sha256 string, blueprint_sha256 string, blueprint_bytes long, block_refs long, "
    "distinct_blocks long, containers long, opaque_containers long, ingested_at string, file_modified string"
)
#: path: ordinals from the root; rows in path order are the preorder walk.
NODES = "version_id string, path array<int>, depth int, kind string, format int, meta binary, size long"
BLOCK_REFS = "version_id string, path array<int>, seq int, hash binary, length int"
BLOCKS = "hash binary, length int, payload binary"
FRAMES = "seq int, hash binary, length int, payload binary"
MEMBERS = "version_id string, name string, size long, part_index int"


class ContainerFormat(IntEnum):
    """Format ids of blueprints; an unknown id is a ValueError."""

    ZIP = 0
    CAB = 1
    SEVEN_Z = 2


class RepackMode(Enum):
    ORIGINAL = "original"
    ZIP = "zip"
    EXTRACT = "extract"


@dataclass(frozen=True)
class ChunkParams:
    """min >= 64, avg >= min, max >= avg."""

    min: int
    avg: int
    max: int

    def __post_init__(self) -> None:
        if self.min < 64 or self.avg < self.min or self.max < self.avg:
            raise ValueError(f"chunk sizes out of order: {self.min}, {self.avg}, {self.max}")

    @classmethod
    def of(cls, desired: int, hard_max: int) -> ChunkParams:
        """The average is a power of two between 1024 and hard_max; a block is a quarter to four times of it."""
        if hard_max < 1024:
            raise ValueError(f"the block limit {hard_max} is under 1024")
        avg = 1 << (max(1024, min(desired, hard_max)).bit_length() - 1)
        return cls(min(avg, max(64, avg // 4)), avg, min(hard_max, max(4 * avg, avg + 1)))


@dataclass(frozen=True)
class DecomposeLimits:
    """7z archives over max_seven_z bytes stay closed; one of exactly that size is opened."""

    max_seven_z: int = 512 << 20

    def __post_init__(self) -> None:
        if self.max_seven_z < 0:
            raise ValueError("the 7z limit is negative")


MAX_DEPTH, MIN_CONTAINER = 6, 22
