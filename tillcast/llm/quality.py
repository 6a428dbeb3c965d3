"""Quality rules: repetition counts, and distance of a text's make-up from its language's.

Only DataFrame functions. Counts are made in one pass over the texts and stored,
a narrow row per document; language references are sums of these counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import query, table

WINDOW = 8  # words of a window that is looked for again
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
# Jensen-Shannon distances (0 to 1) above which a text is not like its language, and the sizes
# from which a histogram is full enough to be compared.
MOST_CLASS_DISTANCE, LEAST_CHARS = 0.26, 200
MOST_WORD_DISTANCE, LEAST_COMPARED_WORDS = 0.22, 100

# Frequent words of the languages that `lang` names; texts of others are held against all of them.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "with"],
    "de": ["der", "die", "und", "das", "ist", "zu", "den", "mit", "ein", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "las", "por"],
}
CLASSES = ("letter", "upper", "digit", "space", "punctuation", "symbol")
SPACE = r"[\x20\x09-\x0D]"


def _without(text: Column, pattern: str) -> Column:
    """How many code points the matches of ``pattern`` have."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _words_of(lang: Column) -> Column:
    everything = F.array(*[F.lit(w) for w in dict.fromkeys(sum(COMMON_WORDS.values(), []))])
    own = None
    for name, listed in COMMON_WORDS.items():
        words = F.array(*[F.lit(w) for w in listed])
        own = F.when(lang == name, words) if own is None else own.when(lang == name, words)
    return own.otherwise(everything)


def text_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, lang`` and the counts that the rules need, a row per row of ``docs (doc_id, text, lang)``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"))
    # An array that a lambda looks into is a column of its own that is used twice, so that it is made once per row.
    rows = rows.select("doc_id", "lang", "text", F.filter(F.split("text", SPACE + "+"), lambda w: w != "").alias("words"),
                       F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    rows = rows.select("*", F.when(F.size("hashes") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))).alias("windows"))
    # windows in order of their hash, only where one comes twice
    rows = rows.select("*", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform(
        "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ordered"))
    again = F.filter("ordered", lambda x, k: (
        ((k > 0) & (F.get("ordered", k - 1)["h"] == x["h"])) | (F.coalesce(F.get("ordered", k + 1)["h"] == x["h"], F.lit(False)))))
    rows = rows.select("*", F.array_sort(F.transform(again, lambda x: x["i"])).alias("starts"))
    repeated = F.aggregate("starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")), lambda acc, i: F.struct(
        (acc["n"] + F.lit(WINDOW) - F.greatest(acc["upto"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("upto")), lambda acc: acc["n"])
    listed = _words_of(F.col("lang"))
    rows = rows.select("*", F.filter(F.transform("words", F.lower), lambda w: F.array_contains(listed, w)).alias("hits"))
    word_chars = F.length(F.array_join("words", "")).cast("long")
    symbols, upper, digits = _without(F.col("text"), "[#*$%&|<>]+"), _without(F.col("text"), "[A-Z]+"), _without(F.col("text"), "[0-9]+")
    punctuation = _without(F.col("text"), r"[!\"'()+,\-./:;=?@\[\\\]^_`{}~]+")
    rows = rows.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), word_chars.alias("word_chars"), symbols.alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated, F.lit(0).cast("long")).alias("n_repeat_words"), upper.alias("upper"), digits.alias("digit"),
        punctuation.alias("punctuation"), F.length("text").cast("long").alias("chars"),
        F.transform(listed, lambda c: F.size(F.filter("hits", lambda h: h == c)).cast("long")).alias("listed"),
        F.size("hits").cast("long").alias("n_hits"))
    space = F.col("chars") - F.col("word_chars")
    letter = F.col("chars") - space - F.col("upper") - F.col("digit") - F.col("punctuation") - F.col("n_symbols")
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars",
        F.array(letter, F.col("upper"), F.col("digit"), space, F.col("punctuation"), F.col("n_symbols")).alias("classes"),
        F.concat(F.array(F.col("n_words") - F.col("n_hits")), "listed").alias("common"))


def language_references(counts: DataFrame) -> DataFrame:
    """Summed histograms of each language, over all of its documents: ``lang, classes, common``."""
    def summed(name):
        cells = counts.select("lang", F.posexplode(name).alias("k", "n")).groupBy("lang", "k").agg(F.sum("n").alias("n"))
        return cells.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: x["n"]).alias(name))
    common = summed("common").withColumnRenamed("lang", "_lang")
    return summed("classes").join(common, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, to the base 2, of two histograms of counts; 0 if either is empty."""
    def total(counts):
        return F.aggregate(counts, F.lit(0).cast("double"), lambda acc, x: acc + x)

    def part(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def term(x, y):
        return (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2
    shares = F.zip_with(p, q, lambda x, y: term(F.try_divide(x, total(p)), F.try_divide(y, total(q))))
    return F.coalesce(F.sqrt(F.greatest(F.aggregate(shares, F.lit(0).cast("double"), lambda acc, x: acc + x), F.lit(0.0))), F.lit(0.0))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts and verdicts, a row per row of ``docs (doc_id, text, lang)``.

    A text fails the base rules with fewer than 20 words, or if more than 30 % of its words lie in 8-word
    windows that the text has twice or more. It is kept if it passes them and its histograms of character
    classes and of common words are near those of all documents of its ``lang`` (null is a language of its
    own); a histogram of few characters or words is not judged. Null and empty texts have no words and fail.
    A null ``doc_id`` stays null; repeated rows each give a row; other columns are not read.
    """
    counts = materialize(text_counts(docs))
    references = language_references(counts).select(
        F.col("lang").alias("_lang"), F.col("classes").alias("ref_classes"), F.col("common").alias("ref_common"))
    judged = counts.join(references, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    judged = judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        F.when(F.col("chars") >= LEAST_CHARS, js_distance(F.col("classes"), F.col("ref_classes"))).alias("class_distance"),
        F.when(F.col("n_words") >= LEAST_COMPARED_WORDS, js_distance(F.col("common"), F.col("ref_common"))).alias("word_distance"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("class_distance", F.lit(0.0)) <= MOST_CLASS_DISTANCE)
         & (F.coalesce("word_distance", F.lit(0.0)) <= MOST_WORD_DISTANCE)).alias("kept"),
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


@query("op9_quality_rules")
def op9_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))
