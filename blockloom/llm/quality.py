"""Quality rules, line first: each line is judged on punctuation, navigation and boilerplate; failing lines go, then
documents that lose too much text are rejected. DataFrame functions only; nothing is shuffled."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WS_CHARS, boxed, unboxed, with_text

SYMBOLS = "#*$%&|<>"
#: Phrases that mark a line as boilerplate of web pages: English, German, French, Spanish.
BOILERPLATE = (
    "accept all cookies", "we use cookies", "enable javascript", "javascript is disabled", "terms of use", "privacy policy",
    "click here to", "sign up for our newsletter", "subscribe to our newsletter", "skip to content", "back to top", "lorem ipsum",
    "alle cookies akzeptieren", "wir verwenden cookies", "datenschutzerklärung", "nutzungsbedingungen", "zum inhalt springen", "newsletter abonnieren",
    "accepter tous les cookies", "nous utilisons des cookies", "politique de confidentialité", "conditions générales", "aller au contenu", "retour en haut",
    "aceptar todas las cookies", "utilizamos cookies", "política de privacidad", "términos de uso", "saltar al contenido", "volver arriba",
)
MARKS = SYMBOLS + "!»" + "0123456789"
SEPARATORS, MAX_ITEM_WORDS = "|>»", 4
#: A line fails when symbols (or exclamation marks) are more than this percentage of its characters, or digits more than that.
MAX_MARK_PCT, MAX_DIGIT_PCT = 10, 30
#: A line of fewer words and characters that does not end a sentence is a heading, a label or a button.
MIN_LINE_WORDS, SHORT_CHARS = 5, 100
#: How a sentence ends in any of many scripts, closing quotes and brackets behind it; how a list's line starts, and a teaser ends.
ENDING = r"[.!?:;\x{2026}\x{3002}\x{FF01}\x{FF1F}\x{061F}\x{0964}][\"')\]\x{00BB}\x{201C}\x{201D}\x{2019}\x{300D}]*$"
BULLET, TEASER = r"^[\-*\x{2022}\x{2023}\x{25E6}\x{00B7}\x{2013}][\x20\x09]", r"(\.\.\.|\x{2026})$"
#: An ASCII line with more characters to a word holds addresses, hashes or encoded data.
MAX_WORD_CHARS = 40
#: Capitals without any small letter: a line that shouts.
CAPITALS = "([^A-Z]*[A-Z]){5}"
#: A document is rejected when its remaining lines hold less than this percentage of its characters.
MIN_KEPT_PCT = 50
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 10, 20, 5


METRICS = ("_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_base_failed", "_n_bad_lines", "_bad_chars", "_kept", "_clean")


def _without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def line_stats(lines: Column) -> Column:
    """For each line a struct: the line, chars (without white space), marks, bad. The nested calls pass over a line twice; marks
    and digits are counted only in a line that has any.

    Punctuation: symbols or exclamation marks are over MAX_MARK_PCT of the characters, digits over MAX_DIGIT_PCT, the line is
    all capitals, or it is short and ends no sentence. Navigation: two or more of | > » with at most MAX_ITEM_WORDS words to
    each of them, an item of a list that ends no sentence, or a teaser that breaks off in dots. Boilerplate: a known phrase, or an
    ASCII line of over MAX_WORD_CHARS characters to a word. A blank line is never bad. But for the phrases no rule is tied to a
    language; what needs capitals or word spaces looks at ASCII alone."""
    dense = F.transform(lines, lambda x: F.struct(x.alias("line"), _without(x, WS_CHARS).alias("dense")))
    marked = F.transform(dense, lambda x: F.struct(x["line"].alias("line"), x["dense"].alias("dense"), F.length(x["dense"]).alias("chars"), (F.length(_without(x["dense"], MARKS)) < F.length(x["dense"])).alias("any")))

    def count(x: Column, chars: str) -> Column:
        return F.when(x["any"], x["chars"] - F.length(_without(x["dense"], chars))).otherwise(0)

    counted = F.transform(marked, lambda x: F.struct(
        x["line"].alias("line"), x["dense"].alias("dense"), x["chars"].alias("chars"), count(x, SYMBOLS).alias("marks"), count(x, "!").alias("bangs"), count(x, "0123456789").alias("digits"), count(x, SEPARATORS).alias("parts"),
        F.lower(x["line"]).alias("low"), F.regexp_count(x["line"], F.lit(WORD)).alias("words"),
    ))

    def bad(x: Column) -> Column:
        pct = (x["marks"] * 100 > MAX_MARK_PCT * x["chars"]) | (x["bangs"] * 100 > MAX_MARK_PCT * x["chars"]) | (x["digits"] * 100 > MAX_DIGIT_PCT * x["chars"])
        ends = F.substring(x["dense"], -4, 4).rlike(ENDING)
        short = (x["words"] < MIN_LINE_WORDS) & (x["chars"] < SHORT_CHARS) & ~ends
        shouts = ~x["line"].rlike("[a-z]") & x["line"].rlike(CAPITALS)
        menu = (x["parts"] >= 2) & (x["words"] <= MAX_ITEM_WORDS * x["parts"])
        item = F.btrim(x["line"], F.lit(WS_CHARS)).rlike(BULLET) & ~ends
        teaser = F.substring(x["dense"], -3, 3).rlike(TEASER)
        data = (x["chars"] > MAX_WORD_CHARS * x["words"]) & (F.length(x["line"]) == F.octet_length(x["line"]))
        return (x["chars"] > 0) & (pct | short | shouts | menu | item | teaser | data | reduce(or_, [F.contains(x["low"], F.lit(b)) for b in BOILERPLATE]))

    return F.transform(counted, lambda x: F.struct(x["line"].alias("line"), x["chars"].alias("chars"), x["marks"].alias("marks"), bad(x).alias("bad")))


def _sum(lines: str, value) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + value(x))


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with columns _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _base_failed, _n_bad_lines,
    _bad_chars, _kept and _clean (the text without failing lines). A null or empty text has no words and fails. Equal
    rows get equal verdicts; every other column passes through untouched, whatever its name."""
    return unboxed(_judge(boxed(docs, text)), docs, more=METRICS)


def _judge(w: DataFrame) -> DataFrame:
    """boxed() rows with METRICS."""
    w = w.withColumns({"_w": F.transform(F.regexp_extract_all("_t", F.lit(WORD), 0), lambda x: F.xxhash64(x)), "_l": line_stats(F.split("_t", "\n", -1))})
    n = F.size("_w")
    # a hash for each window of five words; only texts in which one returns are sorted
    w = w.withColumns({
        "_n_words": n.cast("long"),
        "_word_chars": _sum("_l", lambda x: x["chars"]),
        "_n_symbols": _sum("_l", lambda x: x["marks"]),
        "_bad_chars": _sum("_l", lambda x: F.when(x["bad"], x["chars"]).otherwise(0)),
        "_n_bad_lines": _sum("_l", lambda x: x["bad"].cast("int")),
        "_full": F.transform(F.filter("_l", lambda x: x["chars"] > 0), lambda x: x["line"]),
        "_g": F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]))),
        "_clean": F.array_join(F.transform(F.filter("_l", lambda x: ~x["bad"]), lambda x: x["line"]), "\n"),
    })
    w = w.withColumns({
        "_n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
        "_s": F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    })
    twice = F.filter("_s", lambda x, j: (x["h"] == F.get("_s", j - 1)["h"]) | (x["h"] == F.get("_s", j + 1)["h"]))
    w = w.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate("_p", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    w = w.withColumn("_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    w = w.withColumn("_base_failed", (F.col("_n_words") < MIN_WORDS) | (F.col("_n_repeat_words") * 100 > MAX_REPEAT_PCT * F.col("_n_words")))
    kept = ~F.col("_base_failed") & ((F.col("_word_chars") - F.col("_bad_chars")) * 100 >= MIN_KEPT_PCT * F.col("_word_chars"))
    w = w.withColumn("_kept", kept)
    # a generator of one row stops a later filter: pushed below the arrays above, it would make them again and again
    return w.select("_row", F.explode(F.array(F.struct(*METRICS))).alias("_m")).select("_row", "_m.*")


def op10(docs: DataFrame) -> DataFrame:
    """The digest of quality() for each document."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_bad_lines", "bad_chars", "kept")
    return quality(docs.select("doc_id", "text")).select("doc_id", *[F.col(f"_{x}").alias(x) for x in names])


def stage(docs: DataFrame) -> DataFrame:
    """Documents that pass, without their failing lines."""
    return unboxed(_judge(boxed(docs)).filter("_kept"), docs, with_text(docs, F.col("_clean")))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i:i+4])) AS g FROM w WHERE len(w) >= 5),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
p AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM h WHERE c > 1),
r AS (SELECT doc_id, sum(least(5, i - coalesce(before, i - 5))) AS n FROM p GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(l) AS x FROM w),
lc AS (SELECT doc_id, x, len(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM ln),
lm AS (SELECT doc_id, x, chars, regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') AS dense, len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS words, len(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS marks,
  len(regexp_replace(x, '[^!]', '', 'g')) AS bangs, len(regexp_replace(x, '[^0-9]', '', 'g')) AS digits, len(regexp_replace(x, '[^|>»]', '', 'g')) AS parts FROM lc),
le AS (SELECT *, regexp_matches(right(dense, 4), '{ENDING.replace("'", "''")}') AS ends FROM lm),
lf AS (SELECT doc_id, x, chars, chars > 0 AND (marks * 100 > {MAX_MARK_PCT} * chars OR bangs * 100 > {MAX_MARK_PCT} * chars OR digits * 100 > {MAX_DIGIT_PCT} * chars OR words < {MIN_LINE_WORDS} AND chars < {SHORT_CHARS} AND NOT ends
  OR NOT regexp_matches(x, '[a-z]') AND regexp_matches(x, '{CAPITALS}') OR parts >= 2 AND words <= {MAX_ITEM_WORDS} * parts OR regexp_matches(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '{BULLET}') AND NOT ends
  OR regexp_matches(right(dense, 3), '{TEASER}') OR chars > {MAX_WORD_CHARS} * words AND len(x) = strlen(x) OR regexp_matches(lower(x), '{"|".join(BOILERPLATE)}')) AS bad FROM le),
la AS (SELECT doc_id, count(*) FILTER (chars > 0) - count(DISTINCT x) FILTER (chars > 0) AS dup, count(*) FILTER (bad) AS n_bad, coalesce(sum(chars) FILTER (bad), 0) AS bad_chars, sum(chars) AS chars FROM lf GROUP BY doc_id),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, chars::BIGINT AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, n_bad::BIGINT AS n_bad_lines, bad_chars::BIGINT AS bad_chars FROM w JOIN la USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_bad_lines, bad_chars,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (word_chars - bad_chars) * 100 >= {MIN_KEPT_PCT} * word_chars AS kept FROM b
"""
