"""Mixing sources to target weights by systematic sampling: documents of a source stand in a row, each as long as its
expected copies; a comb of integer marks, shifted by one random offset, is laid over the row, and a document is emitted
once for each mark on it. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_PARTS, WORD, boxed, materialise, unboxed

WEIGHTS, MAX_UPSAMPLING, SEED = (5, 2, 1), 3, "mix-1"


def _size_bin(size: Column) -> Column:
    """Eight bins an octave of sizes, in ascending order."""
    bits = F.length(F.bin(size))
    top = F.when(bits >= 4, F.call_function("shiftright", size, bits - 4)).otherwise(size) % 8
    return (bits * 8 + top).cast("int")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_upsampling: int = MAX_UPSAMPLING) -> DataFrame:
    """(source, source_size, ...) with weight and target. Weights repeat over the sources by code point, null last. The
    targets share all sizes by weight; none passes max_upsampling times its source's size, and what it can't take is
    shared among the others by weight until none is above. This is a water level: sort by size/weight; the capped
    sources are the prefix whose cap lies under the level that the rest would have. One row a source."""
    one = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    s = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(one) - 1) % n + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * max_upsampling)
    whole = Window.partitionBy(F.lit(1))
    up = Window.partitionBy(F.lit(1)).orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"_all": F.sum("source_size").over(whole), "_caps": F.coalesce(F.sum("cap").over(up), F.lit(0)), "_w": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(up), F.lit(0))})
    capped = F.col("cap") * F.col("_w") < (F.col("_all") - F.col("_caps")) * F.col("weight")  # even with the ones before it capped, it would pass its cap
    s = s.withColumn("_c", capped)
    left = F.col("_all") - F.sum(F.when(F.col("_c"), F.col("cap")).otherwise(0)).over(whole)
    free = F.sum(F.when(F.col("_c"), 0).otherwise(F.col("weight"))).over(whole)
    target = F.when(F.col("_c"), F.col("cap").cast("double")).otherwise((F.col("weight") * left).cast("double") / free.cast("double"))
    return s.withColumn("target", target).drop("_all", "_caps", "_w", "_c", "cap")


def _cut_at_hot_ids(rows: DataFrame) -> DataFrame:
    """rows with _z, _s and _t, which part the bin of a hash prefix further where an id has over 1/HOT_PARTS of all rows (so there
    are fewer than HOT_PARTS such ids, and they fit a literal). Rows before, of and after a hot id are bins of their own, in
    that order (_z); rows of a hot id are dealt by size and text (_s), and those that are equal in that as well by
    their place in the written table (_t): those are interchangeable."""
    by_id = rows.groupBy("_h").agg(F.count("*").alias("n"))
    total = rows.count()
    hot = sorted(r["_h"] for r in by_id.filter(F.col("n") * HOT_PARTS > F.lit(max(total, HOT_PARTS * HOT_PARTS))).select("_h").collect())
    if not hot:
        return rows.withColumns({"_z": F.lit(""), "_s": F.lit(0).cast("long"), "_t": F.lit(0).cast("long")})
    hot_ids = F.array(*map(F.lit, hot))
    is_hot = F.array_contains(hot_ids, F.col("_h"))
    after = F.coalesce(F.array_max(F.filter(hot_ids, lambda x: x < F.col("_h"))), F.lit(""))
    z = F.when(is_hot, F.col("_h")).otherwise(F.concat(after, F.when(after != "", "~").otherwise("")))
    same = F.xxhash64("size", "_th")
    return rows.withColumns({"_z": z, "_s": F.when(is_hot, F.pmod(same, F.lit(4096))).otherwise(0).cast("long"), "_t": F.when(is_hot, F.pmod(F.xxhash64("_m"), F.lit(256))).otherwise(0).cast("long")})


def plan_mix(sized: DataFrame, seed: str = SEED) -> DataFrame:
    """sized has doc_id, source, size and th, a hash of the text, and whatever else goes along (names with _ in front are taken).
    Adds source_size, target and copies.

    Every document of a source has the same expected copies, so the prefix sum is its rank times that. The rank comes
    from counts of bins (source, size class, 12 bits of a hash of the id, and more bits for ids that a great part of all rows
    share): windows run over the classes of a source, the bins of a class and the rows of a bin, never over the rows of a
    source or of an id. Ordered by size bin, every size class is sampled in proportion, so the words
    taken stay near the target. Ties on the hash are ordered by size and text; rows that are equal in those stand beside
    each other in any order (they are equal in all that counts). A null id hashes as 'null'; an empty source or a
    total of 0 takes nothing."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    keys = {"_k": F.coalesce(F.col("source"), F.lit("")), "_null": F.col("source").isNull()}
    rows = sized.withColumns(keys | {"_b": _size_bin(F.col("size")), "_h": h, "_th": F.col("th"), "_m": F.monotonically_increasing_id()}).drop("th")
    rows = _cut_at_hot_ids(materialise(rows, "mix-sizes").withColumn("_x", F.substring("_h", 1, 3)))
    cell = ["_k", "_null", "_b", "_x", "_z", "_s", "_t"]
    bins = materialise(rows.groupBy(*cell).agg(F.count("*").alias("_n"), F.sum("size").alias("_size")), "mix-bins")
    classes = materialise(bins.groupBy("_k", "_null", "_b").agg(F.sum("_n").alias("_n"), F.sum("_size").alias("_size")), "mix-classes")
    t = targets(classes.groupBy("_k", "_null").agg(F.sum("_size").alias("source_size")).withColumn("source", F.when(~F.col("_null"), F.col("_k"))))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col("_k")).cast("binary")), 1, 6), 16, 10).cast("double") / F.lit(16777216.0)
    # documents before a bin: those of smaller size classes, and of bins with smaller hashes in its own
    smaller = Window.partitionBy("_k", "_null").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_k", "_null", "_b").orderBy("_x", "_z", "_s", "_t").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("_class", F.coalesce(F.sum("_n").over(smaller), F.lit(0))).select("_k", "_null", "_b", "_class")
    classes = classes.join(t.withColumn("_u", u).drop("source", "weight"), ["_k", "_null"])
    bins = bins.withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0))).drop("_n", "_size").join(classes, ["_k", "_null", "_b"])
    bins = bins.withColumn("_before", F.col("_class") + F.col("_in")).drop("_class", "_in")
    inside = Window.partitionBy(*cell).orderBy("_h", "doc_id", "size", "_th")
    out = rows.withColumn("_r", F.row_number().over(inside)).join(bins, cell)
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = (F.col("_before") + F.col("_r")).cast("double")
    copies = F.floor(rank * e + F.col("_u")) - F.floor((rank - 1) * e + F.col("_u"))
    return out.withColumn("copies", copies).drop(*cell, "_h", "_th", "_m", "_r", "_u", "_before")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op3(docs: DataFrame) -> DataFrame:
    """A row for each document: its size, its source's size and target, the words the mix takes of it. Null and empty texts have
    size 0 and take none; a null source is a source; repeated rows and rows without an id are documents like others; an
    empty table gives no row; other columns don't matter."""
    p = plan_mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")))
    return p.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The mixture itself: each document as many times as it is emitted, with the columns of docs, which go through the plan
    as one struct. Edge cases as in op3; a document of which none is taken does not appear."""
    keyed = boxed(docs).select("_row", F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"), n_words(F.col("_t")).alias("size"), F.xxhash64("_t").alias("th"))
    plan = plan_mix(keyed.withColumnRenamed("_row", "row")).filter("copies > 0").withColumnRenamed("row", "_row")
    return unboxed(plan.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))), docs)


SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM s),
p AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(cap) OVER u, 0) AS caps, sum(weight) OVER () - coalesce(sum(weight) OVER u, 0) AS ws FROM w
  WINDOW u AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * ws < (total - caps) * weight AS capped FROM p),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (weight * (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)))::DOUBLE / (sum(weight) FILTER (NOT capped) OVER ())::DOUBLE END AS target,
  ('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 6))::BIGINT::DOUBLE / 16777216.0 AS u FROM c),
b AS (SELECT *, len(bin(size)) AS bits FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bits * 8 + (CASE WHEN bits >= 4 THEN size >> (bits - 4) ELSE size END) % 8, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), doc_id)::DOUBLE AS r FROM b),
x AS (SELECT r.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(r * e + u) - floor((r - 1) * e + u)) * size)::BIGINT AS taken, (floor(r * e + u) - floor((r - 1) * e + u))::BIGINT AS copies FROM x
"""
