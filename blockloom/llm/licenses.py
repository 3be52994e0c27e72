"""License scans by diagonal voting: all rolling word k-grams of all texts are hashed and joined to the positions they
have in templates; hits with the same offset (a diagonal) vote together, neighbouring diagonals are merged, and spans
are verified by their longest chain in template order. DataFrame functions only; one pass over the texts, only votes and
counts are shuffled."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_key, lower_az, materialise
from .license_texts import BASE, LONG

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a gram: of the base phrases, which have as few, and of the other templates.
K_BASE, K = 2, 4
#: Share of a template's k-grams, and of its span's, that must stand in order on merged diagonals; diagonals are merged up to
#: the 1/NEAR of the template's k-grams apart.
MIN_SHARE, NEAR = 0.8, 8


def words_of(text: str) -> list[str]:
    return re.findall(WORDS, text.lower())  # templates are ASCII


TEMPLATES = (*((label, True, words_of(t)) for label, t in BASE), *((label, False, words_of(t)) for label, t in LONG))


def _rows(templates=TEMPLATES) -> list[tuple]:
    """(gram, k, template, label, base, tpos, n_grams) of all templates: as many rows as they have words at most, whatever the corpus."""
    out = []
    for t, (label, base, w) in enumerate(templates):
        k = K_BASE if base else K
        out += [(" ".join(w[i : i + k]), k, t, label, base, i, len(w) - k + 1) for i in range(len(w) - k + 1)]
    return out


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(_rows(templates), "tgram string, k int, template int, label string, base boolean, tpos int, n_grams int")


def _hits(w: str, k: int, hashes: list[int]) -> Column:
    """Of the rolling k-grams of the words array those whose hash a template has: (pos, k, hash, gram)."""
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(i.alias("pos"), F.lit(k).alias("k"), F.xxhash64(*[F.get(w, i + j) for j in range(k)]).alias("hash")))
    known = F.filter(grams, lambda x: x["hash"].isin(hashes))
    told = F.transform(known, lambda x: F.struct(x["pos"].alias("pos"), x["k"].alias("k"), x["hash"].alias("hash"), F.concat_ws(" ", *[F.get(w, x["pos"] + j) for j in range(k)]).alias("gram")))
    return F.when(F.size(w) >= k, told).otherwise(F.slice(told, 1, 0))


def scan(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((doc_id, dk, th, n_words) of each row, votes): the texts are read and cut into words once."""
    spark = docs.sparkSession
    t = template_grams(spark, templates)
    t = t.withColumn("hash", F.when(F.col("k") == K, F.xxhash64(*[F.split_part("tgram", F.lit(" "), F.lit(j + 1)) for j in range(K)])).otherwise(F.xxhash64(*[F.split_part("tgram", F.lit(" "), F.lit(j + 1)) for j in range(K_BASE)])))
    hashes = {k: sorted({r.hash for r in t.filter(F.col("k") == k).select("hash").collect()}) for k in (K_BASE, K)}  # of the templates alone
    w = docs.select("doc_id", *doc_key(text=text), F.regexp_extract_all(lower_az(F.coalesce(F.col(text), F.lit(""))), F.lit(WORDS), 0).alias("w"))
    w = w.select("doc_id", "dk", "th", F.size("w").cast("long").alias("n_words"), F.concat(*[_hits("w", k, hashes[k]) for k in (K_BASE, K)]).alias("hits"))
    w = materialise(w, "license-words")
    hits = w.select("dk", "th", F.explode("hits").alias("x")).select("dk", "th", "x.*")
    hits = hits.join(F.broadcast(t), ["k", "hash"]).filter(F.col("gram") == F.col("tgram"))
    votes = hits.groupBy("dk", "th", "template", "label", "base", "n_grams", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set(F.struct("pos", (-F.col("tpos")).alias("down"))).alias("at"))
    return w.drop("hits"), materialise(votes, "votes")


def _chain(at: Column) -> Column:
    """The most votes that stand in order, in the text and in the template: at is sorted by pos, of equal ones the last tpos first;
    the state holds the least last tpos of a chain of each length."""

    def step(tails: Column, x: Column) -> Column:
        tpos = -x["down"]
        n = F.size(F.filter(tails, lambda y: y < tpos))
        return F.concat(F.slice(tails, 1, n), F.array(tpos), F.slice(tails, n + 2, F.greatest(F.size(tails) - n - 1, F.lit(0))))

    return F.size(F.aggregate(at, F.array().cast("array<int>"), step))


def verified_spans(votes: DataFrame) -> DataFrame:
    """(dk, th, template, label, base, start, end, share): word positions from 0, end exclusive.

    A base phrase needs all votes on one diagonal. Votes of another template on diagonals that lie at most 1/NEAR of its
    length apart (words put in or left out shift the diagonal) are one span; share is the longest chain of votes in template
    order against the k-grams of the template or of the span, whichever are more: what is missing, out of order or put in
    between counts against it. Spans under MIN_SHARE are dropped."""
    exact = votes.filter(F.col("base") & (F.size("at") == F.col("n_grams")))
    exact = exact.select("dk", "th", "template", "label", "base", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n_grams") + K_BASE - 1).alias("end"), F.lit(1.0).alias("share"))
    by = Window.partitionBy("dk", "th", "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal", 1, -(2**30)).over(by) > F.floor(F.col("n_grams") / NEAR)).cast("int")
    loose = votes.filter(~F.col("base")).withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by))
    loose = loose.groupBy("dk", "th", "template", "label", "base", "n_grams", "run").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    first, last = F.element_at("at", 1)["pos"], F.element_at("at", -1)["pos"]
    long = F.greatest(F.col("n_grams"), last - first + 1)
    loose = loose.withColumn("long", long).filter(F.size("at") >= MIN_SHARE * F.col("long"))
    loose = loose.select("dk", "th", "template", "label", "base", first.alias("start"), (last + K).alias("end"), (_chain(F.col("at")).cast("double") / F.col("long")).alias("share"))
    return exact.unionByName(loose.filter(F.col("share") >= MIN_SHARE))


def license_spans(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> DataFrame:
    """(dk, th, template, label, base, start, end, share) of each document (common.doc_key); equal rows are one. A hash that hits
    is confirmed on the words themselves, so a collision never votes. Null and short texts have no span; a text's votes are
    one group for each template and diagonal, however long it is."""
    return verified_spans(scan(docs, templates, text)[1])


def op5(docs: DataFrame) -> DataFrame:
    """A row for each document: words, places of base phrases, labels and a score. Null and empty texts have no words, no labels and
    score 0; repeated rows get the same answer; an empty table gives no row; other columns don't matter."""
    d, votes = scan(docs.select("doc_id", "text"))
    s = verified_spans(votes)
    base = F.col("base")
    s = s.groupBy("dk", "th").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    return d.join(s, ["dk", "th"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _values() -> str:
    return ", ".join(f"('{gram}', {k}, {t}, '{label}', {str(base).lower()}, {tpos}, {n})" for gram, k, t, label, base, tpos, n in _rows())


SQL = rf"""
WITH t(gram, k, template, label, base, tpos, n_grams) AS (VALUES {_values()}),
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM w),
g AS (SELECT doc_id, i - 1 AS pos, {K_BASE} AS k, w[i] || ' ' || w[i + 1] AS gram FROM i UNION ALL SELECT doc_id, i - 1, {K}, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FROM i),
h AS (SELECT doc_id, pos, t.* FROM g JOIN t ON g.gram = t.gram AND g.k = t.k),
v AS (SELECT doc_id, template, label, base, n_grams, pos - tpos AS diagonal, list((pos, -tpos)) AS ats FROM h GROUP BY ALL),
e AS (SELECT doc_id, label, base, diagonal AS start, 1.0::DOUBLE AS share FROM v WHERE base AND len(ats) = n_grams),
f AS (SELECT *, (diagonal - lag(diagonal, 1, -1073741824) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > n_grams // {NEAR})::INT AS fresh FROM v WHERE NOT base),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM f),
m AS (SELECT doc_id, label, base, n_grams, list_sort(flatten(list(ats))) AS ats FROM r GROUP BY doc_id, template, label, base, n_grams, run),
c AS (SELECT *, greatest(n_grams, ats[-1][1] - ats[1][1] + 1) AS long, list_transform(ats, lambda x: [(-x[2])::BIGINT]) AS downs FROM m),
l AS (SELECT doc_id, label, base, len(list_reduce(list_prepend([]::BIGINT[], downs), lambda a, x: list_concat(list_filter(a, lambda y: y < x[1]), x, a[len(list_filter(a, lambda y: y < x[1])) + 2:])))::DOUBLE / long AS share FROM c WHERE len(ats) >= {MIN_SHARE} * long),
s AS (SELECT * FROM e UNION ALL SELECT doc_id, label, base, NULL, share FROM l WHERE share >= {MIN_SHARE}),
a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM s GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM w LEFT JOIN a USING (doc_id)
"""
