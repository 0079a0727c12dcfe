"""Quality rules by distribution divergence, with SQL functions only.

A document's histogram of character classes and its histogram of common words
are compared with a reference of its language by Jensen-Shannon distance.  The
reference is the median document: the median of each histogram cell over all
documents of the language, to a thousandth, scaled to sum to 1.  Medians stay
put where a third of the rows are copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nativetext import SPACE, SPACE_CHARS, gram_hashes, let, words
from .store import Tables

#: Common words by language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for"],
    "de": ["der", "die", "und", "in", "das", "den", "von", "mit", "des", "zu"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "las", "un"],
}
#: Other languages share one reference, over the first distinct ten of all lists' first three words.
OTHER = list(dict.fromkeys(w for ws in COMMON.values() for w in ws[:3]))[:10]
MIN_WORDS, MAX_REPEAT = 50, 50
#: Greatest distances kept, and the length guard: what a text of n words may deviate more, over the root of n.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, GUARD = 0.165, 0.25, 0.6
CELLS = 1000
CLASSES = ["space", "upper", "digit", "symbol", "punctuation", "beyond_ascii", "other"]
LETTERS = "abcdefghij"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows found twice or more."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(starts, i - 1))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def marked(g: Column) -> Column:
        order = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def neighbours(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

        return let(let(order, neighbours), covered)

    return let(gram_hashes(w, 3), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(marked(g))).cast("long")


def _code_counts(codes: Column) -> Column:
    n = F.length(codes)
    return F.array(*(n - F.length(F.replace(codes, F.lit(c), F.lit(""))) for c in LETTERS))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: c / F.greatest(total, F.lit(1)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance in bits of two arrays of shares, 0 to 1."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda a, b: let((a + b) / 2, lambda m: (term(a, m) + term(b, m)) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def _features(docs: DataFrame) -> DataFrame:
    language = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise(F.lit("other"))
    base = docs.select("doc_id", language.alias("language"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).withColumn("w", words(F.col("t")))
    t, w = F.col("t"), F.col("w")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    listed = lambda ws: F.array_join(F.transform(F.filter(w, lambda x: x.isin(*ws)), lambda x: F.substring(F.lit(LETTERS), F.array_position(F.array(*map(F.lit, ws)), x).cast("int"), F.lit(1))), "")
    codes = listed(OTHER)
    for lang, ws in COMMON.items():
        codes = F.when(F.col("language") == lang, listed(ws)).otherwise(codes)
    counted = base.select(
        "doc_id", "language",
        F.size(w).cast("long").alias("n_words"), F.length(t).cast("long").alias("n_chars"), _count(t, "[^\\x00-\\x7F]").alias("beyond"),
        _count(t, SPACE).alias("space"), _count(t, "[#*$%&|<>]").alias("n_symbols"), _count(t, "[A-Z]").alias("upper"), _count(t, "[0-9]").alias("digit"), _count(t, "[.,;:!?'\"()-]").alias("punctuation"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words"),
        codes.alias("codes"),
    )
    # the classes have no character in common
    named = [F.col(c) for c in ("space", "upper", "digit", "n_symbols", "punctuation", "beyond")]
    rest = F.col("n_chars") - sum(named[1:], named[0])
    classes = F.array(*named, rest)
    common = _code_counts(F.col("codes"))
    return counted.select(
        "doc_id", "language", "n_words", (F.col("n_chars") - F.col("space")).alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))).alias("base_failed"),
        _shares(classes, F.aggregate(classes, F.lit(0).cast("long"), lambda a, x: a + x)).alias("char_shares"),
        _shares(F.concat(common, F.array(F.col("n_words") - F.length("codes"))), F.col("n_words")).alias("word_shares"),
    )


def _references(features: DataFrame) -> DataFrame:
    """A row per language, five at most: the scaled cell medians over documents that pass the base rules."""
    cells = features.where(~F.col("base_failed")).select("language", F.posexplode(F.concat("char_shares", "word_shares")).alias("cell", "share"))
    counts = cells.groupBy("language", "cell", F.floor(F.col("share") * CELLS + 0.5).alias("step")).agg(F.count("*").alias("n"))
    # at most languages x cells x (CELLS + 1) counts come together here
    steps = counts.groupBy("language", "cell").agg(F.array_sort(F.collect_list(F.struct("step", "n"))).alias("s"), F.sum("n").alias("total"))
    running = F.aggregate(
        "s",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("at")),
        lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when((a["at"] < 0) & (2 * (a["seen"] + x["n"]) >= F.col("total")), x["step"]).otherwise(a["at"]).alias("at")),
    )
    medians = steps.select("language", "cell", (running["at"] / CELLS).alias("m"))
    arrays = medians.groupBy("language").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "m"))), lambda x: x["m"]).alias("m"))
    k = len(CLASSES)
    scaled = lambda a: let(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(a, lambda x: x / F.greatest(total, F.lit(1e-9))))
    return arrays.select("language", scaled(F.slice("m", 1, k)).alias("char_ref"), scaled(F.slice("m", k + 1, len(LETTERS) + 1)).alias("word_ref"))


def judge_quality(docs: DataFrame) -> DataFrame:
    """One row per input row, with its counts, distances and verdict.

    docs: doc_id, text, lang.  Null and empty texts have no words and fail the
    base rules, as do texts under 50 words; repeated rows get equal rows; a null or
    unlisted language is judged against one shared reference.  A language
    without a document that passes the base rules has no reference, and its
    documents are judged by the base rules alone.
    """
    tables = Tables(docs.sparkSession, "quality")
    features = tables.write(_features(docs.select("doc_id", "text", "lang")), "features")
    # five rows at most
    joined = features.join(F.broadcast(_references(features)), "language", "left")
    slack = GUARD / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    chars, common = js_distance(F.col("char_shares"), F.col("char_ref")), js_distance(F.col("word_shares"), F.col("word_ref"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", chars.alias("char_distance"), common.alias("word_distance"), slack.alias("slack")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce((F.col("char_distance") <= MAX_CHAR_DISTANCE + F.col("slack")) & (F.col("word_distance") <= MAX_WORD_DISTANCE + F.col("slack")), F.lit(True))).alias("kept"),
        "char_distance", "word_distance",
    )
