"""Quality rules: repetition counts and divergence from language references.

DataFrame functions only. A document's histogram of character classes and its
histogram of common words are compared with those of its language by
Jensen-Shannon distance (base 2, so 0 to 1). The references are means over all
documents of the language: one aggregation of as many rows as there are
languages, whose few numbers then are literals of the verdict. No row is
shuffled apart from those partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.llm.shared import written

# Frequent function words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "with", "as", "be", "by"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "est", "pour", "que", "qui", "dans", "par"],
}
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Lower a-z, upper A-Z, digits, the symbols above, other ASCII, all else, white space between words.
CLASSES = 7
#: Below these lengths a histogram is too thin to judge by.
LEAST_CHARS, LEAST_WORDS = 200, 100
#: Jensen-Shannon distances up to which a document is kept.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.25, 0.3
LEAST_BASE_WORDS, MOST_REPEAT_PERCENT = 50, 50


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _words, _odd, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Windows of three words are compared by their 64-bit hashes within the
    document; only documents that have a repeated hash are sorted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_words", F.array_remove(F.split(text, SPACE), ""))
    df = df.withColumn("_dense", F.array_join("_words", ""))
    df = df.withColumn("_odd", F.regexp_replace("_dense", "[a-z]+", ""))
    df = df.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.length("_dense").cast("long"))
    df = df.withColumn("n_symbols", (F.length("_odd") - F.length(F.translate("_odd", SYMBOLS, ""))).cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", F.when(text.contains("\n"), lines))
    df = df.withColumn("n_dup_lines", F.coalesce(F.size("_lines") - F.size(F.array_distinct("_lines")), F.lit(0)).cast("long"))
    hashes = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    df = df.withColumn("_hashes", F.slice(hashes, 1, F.greatest(F.size("_words") - 2, F.lit(0))))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def again(x: Column, at: Column) -> Column:
        same = lambda j: F.coalesce(F.get("_sorted", j)["h"] == x["h"], F.lit(False))
        return F.when(same(at - 1) | same(at + 1), x["i"])

    df = df.withColumn("_at", F.sort_array(F.filter(F.transform("_sorted", again), lambda x: x.isNotNull())))
    gaps = F.transform("_at", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - x, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long")))
    return df.drop("_dense", "_lines", "_hashes", "_sorted", "_at")


def _is_one_of(words: list[str]):
    return lambda w: w.isin(*words)


def with_histograms(df: DataFrame, lang_col: str = "lang") -> DataFrame:
    """``with_counts``'s rows with _lang, _classes and _common.

    _lang is the stated language, where none is stated the one of which the
    text has most common words, and null for one that has no list. _common counts the language's common words in order and,
    last, all other words.
    """
    odd = F.col("_odd")
    df = df.withColumn("_upper", F.length(F.regexp_replace(odd, "[A-Z]+", "")))
    df = df.withColumn("_digit", F.length(F.regexp_replace(odd, "[A-Z0-9]+", "")))
    df = df.withColumn("_ascii", F.length(F.regexp_replace(odd, r"[\x00-\x7F]+", "")))
    classes = [
        F.col("word_chars") - F.length(odd), F.length(odd) - F.col("_upper"), F.col("_upper") - F.col("_digit"), F.col("n_symbols"),
        F.col("_digit") - F.col("n_symbols") - F.col("_ascii"), F.col("_ascii"), F.greatest(F.col("n_words") - 1, F.lit(0)),
    ]
    df = df.withColumn("_classes", F.array(*[c.cast("double") for c in classes])).withColumn("_rest", F.transform("_words", F.lower))
    lists = {k: F.array(*map(F.lit, COMMON_WORDS[k])) for k in sorted(COMMON_WORDS)}
    hits = [F.struct(F.size(F.array_intersect("_rest", lists[k])).alias("n"), F.lit(k).alias("lang")) for k in lists]
    lang = F.col(lang_col)
    df = df.withColumn("_lang", F.when(lang.isin(*lists), lang).when(lang.isNull(), F.greatest(*hits)["lang"]))
    own, few = F.when(F.lit(False), F.array().cast("array<string>")), F.when(F.lit(False), F.array().cast("array<string>"))
    for k, words in lists.items():
        own = own.when(F.col("_lang") == k, words)
        few = few.when(F.col("_lang") == k, F.filter("_rest", _is_one_of(COMMON_WORDS[k])))
    df = df.withColumn("_own", own).withColumn("_few", few)
    counts = F.transform("_own", lambda c: F.size(F.filter("_few", lambda w: w == c)).cast("double"))
    df = df.withColumn("_common", F.concat(counts, F.array((F.col("n_words") - F.size("_few")).cast("double"))))
    return df.drop("_upper", "_digit", "_ascii", "_rest", "_few", "_own", "_words", "_odd")


def references(features: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Per language the mean shares over its documents: (character classes, common words).

    Every document counts alike, whatever its length, if it is long enough to
    be judged and the base rules pass it; a language without one is absent. At
    most one row per known language reaches the driver.
    """
    size = len(next(iter(COMMON_WORDS.values()))) + 1
    share = lambda c: F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda a, y: a + y))
    rows = features.where(F.col("_lang").isNotNull() & (F.col("n_words") >= LEAST_WORDS) & (F.col("word_chars") >= LEAST_CHARS) & ~_base_failed()).select("_lang", share("_classes").alias("c"), share("_common").alias("w"))
    means = [F.avg(F.col("c")[i]).alias(f"c{i}") for i in range(CLASSES)] + [F.avg(F.col("w")[i]).alias(f"w{i}") for i in range(size)]
    return {r["_lang"]: ([r[f"c{i}"] for i in range(CLASSES)], [r[f"w{i}"] for i in range(size)]) for r in rows.groupBy("_lang").agg(*means).collect()}


def _base_failed() -> Column:
    return (F.col("n_words") < LEAST_BASE_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))


def _distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of an array of counts from reference shares; null for an empty histogram."""
    ref = F.array(*map(F.lit, reference))
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def part(p: Column, q: Column) -> Column:
        term = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))
        return (term(p) + term(q)) / 2

    shares = F.transform(counts, lambda x: x / total)
    divergence = F.aggregate(F.zip_with(shares, ref, part), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0))))


def quality(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed, kept.

    kept is false where the base rules fail (fewer than 50 words, or more than
    half the words in repeated 3-word windows) or a distance is over its
    bound; a text under the least length isn't judged by that distance.
    The counts are written once as a table, with the text if ``keep_text``;
    references and verdicts read that table, so texts are cut once.

    Nulls: a null text has no words and fails; a null language stands for the
    one of whose common words the text has most, and a document of a language
    without a list is judged by the base rules alone. Repeated rows
    are judged each. An empty table gives an empty result. An input column of
    a result's name is replaced by the result; all others may have any names.
    """
    kept = [c for c in docs.columns if c not in ADDED and (keep_text or c != text_col)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_stated"))
    df = written(with_histograms(with_counts(rows, "_text"), "_stated").drop("_text", "_stated"), "quality")
    by_class = by_word = F.lit(None).cast("double")
    for lang, (classes, words) in sorted(references(df).items()):
        by_class = F.when(F.col("_lang") == lang, _distance(F.col("_classes"), classes)).otherwise(by_class)
        by_word = F.when(F.col("_lang") == lang, _distance(F.col("_common"), words)).otherwise(by_word)
    df = df.withColumn("class_distance", by_class).withColumn("word_distance", by_word)
    df = df.withColumn("base_failed", _base_failed())
    odd = (F.col("word_chars") >= LEAST_CHARS) & (F.coalesce("class_distance", F.lit(0.0)) > MOST_CLASS_DISTANCE)
    strange = (F.col("n_words") >= LEAST_WORDS) & (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD_DISTANCE)
    return df.withColumn("kept", ~F.col("base_failed") & ~odd & ~strange).select("_row.*", *ADDED)


#: The columns that ``quality`` adds.
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"]
RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality(docs, keep_text=False).select(*RESULT)
