"""Line dedup: explode normalised lines, hash them, count distinct documents for each hash, drop lines over the
threshold, reassemble by position. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, boxed, doc_key, lookup, lower_az, materialise, unboxed, with_text

MIN_DOCS, MIN_POINTS = 10, 1


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_points: int = MIN_POINTS, text: str = "text") -> DataFrame:
    """docs with _n_lines, _n_dropped and _clean (the lines that stay, joined by \\n).

    A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys of at least min_points code points
    in at least min_docs documents lose all their lines. A null text is one empty line; blank lines have no key and stay.
    Documents count by id, so repeated rows count once; all rows without an id count as one document. Only digests are shuffled to count; a hot line is
    counted by partial sums and found again by a broadcast of fewer than HOT_PARTS keys."""
    return unboxed(_drop_lines(docs, min_docs, min_points, text), docs, more=("_n_lines", "_n_dropped", "_clean"))


def _drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_points: int = MIN_POINTS, text: str = "text") -> DataFrame:
    """boxed() rows with _n_lines, _n_dropped, _clean."""
    keyed = boxed(docs, text).withColumn("doc_id", F.col("_row.doc_id"))
    rows = keyed.select(*doc_key(text="_t"), F.posexplode(F.split("_t", "\n", -1)).alias("pos", "line"))
    key = F.btrim(lower_az(F.col("line")), F.lit(WS_CHARS))
    rows = materialise(rows.withColumn("k", key).filter(F.length("k") >= max(1, min_points)).select("dk", "th", "pos", F.unhex(F.md5("k")).alias("h")), "lines")
    common = rows.groupBy("h", "dk").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n")).filter(F.col("n_docs") >= min_docs)
    common = materialise(common.select("h", "n"), "common-lines")
    drops = lookup(rows, common, ["h"], "left_semi", "n", rows.count())
    drops = drops.groupBy("dk", "th").agg(F.collect_set("pos").alias("_drop"))
    out = keyed.withColumns({c: e for c, e in zip(("dk", "th"), doc_key(text="_t"))}).join(drops, ["dk", "th"], "left")
    lines = F.split("_t", "\n", -1)
    out = out.withColumn("_l", lines).withColumn("_n_lines", F.size("_l").cast("long"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), F.col("_drop"))
    clean = F.when(F.col("_drop").isNull(), F.col("_t")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_l", i)), "\n"))
    return out.withColumns({"_n_dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("long"), "_clean": clean}).select("_row", "_n_lines", "_n_dropped", "_clean")


def op7(docs: DataFrame) -> DataFrame:
    d = line_dedup(docs.select("doc_id", "text"))
    return d.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.encode("_clean", "UTF-8"), 256).alias("kept_sha256"))


def stage(docs: DataFrame) -> DataFrame:
    """Documents without their dropped lines; one that has no line left goes."""
    d = _drop_lines(docs).filter((F.col("_n_dropped") == 0) | (F.col("_n_dropped") < F.col("_n_lines")))
    return unboxed(d, docs, with_text(docs, F.col("_clean")))


_STRIP = r"'^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'"
SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents),
k AS (SELECT doc_id, pos, x, translate(regexp_replace(x, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
c AS (SELECT k FROM k WHERE len(k) >= {MIN_POINTS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
f AS (SELECT doc_id, pos, x, k.k IN (SELECT k FROM c) AS bad FROM k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (bad))::BIGINT AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (NOT bad), '')) AS kept_sha256 FROM f GROUP BY doc_id
"""
