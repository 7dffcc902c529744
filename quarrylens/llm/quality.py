"""Quality rules by distribution divergence, in DataFrame functions alone.

Every text gets counts (words, symbols, repeated lines and 5-word windows) and two histograms: of character classes
and of its language's common words. The pooled histograms of a language over all documents that pass the base rules
are its reference. A document is rejected if the Jensen-Shannon distance (base 2, 0 to 1) of its character classes
from the reference is over MAX_CLASS_DISTANCE, or that of its common words is over MAX_WORD_DISTANCE. Short texts say
little about frequencies, so either is judged only from a least number of words on.

Languages without a reference (unknown, null, or with no accepted document) are judged by character classes alone,
against the nearest of the references.

Defined results: a null or empty text has no words, so base_failed; repeated rows give repeated results; extra
columns are not read; an empty table gives an empty result. Words of a window are compared by a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import materialize, row_key, rows_of

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: The most frequent function words of four languages.
COMMON = {
    "en": "the of and to in is that it was for on are as with at be this by from or".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
CLASSES = ("space", "lower", "upper", "digit", "punctuation", "symbol", "other")
#: Rule parameters.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MAX_CLASS_DISTANCE, MIN_WORDS_FOR_CLASSES = 0.30, 50
MAX_WORD_DISTANCE, MIN_WORDS_FOR_WORDS = 0.31, 100


def _only(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in the class."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def _repeat_words(grams: Column) -> Column:
    """Words in windows found twice or more: windows are sorted by hash, equal neighbours give their positions."""
    by_hash = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    hit = F.transform(F.array(by_hash), lambda s: F.filter(F.transform(s, lambda x, k: F.when((x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"]), x["i"])), lambda i: i.isNotNull()))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    total = F.aggregate(F.sort_array(F.get(hit, F.lit(0))), start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return F.when(F.size(grams) > F.size(F.array_distinct(grams)), total).otherwise(0).cast("long")


def text_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts of every whole text of ``docs(text, ...)``; see the names below."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = sorted({w for ws in COMMON.values() for w in ws})
    df = docs.select(*keep, text.alias("_text"))
    df = df.withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    grams = F.when(F.size("_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(
        *keep,
        F.length("_text").cast("long").alias("n_chars"),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _only(F.col("_text"), "#*$%&|<>").alias("n_symbols"),
        _only(F.col("_text"), "A-Z\\p{Lu}").alias("n_upper"),
        _only(F.col("_text"), "0-9").alias("n_digits"),
        _only(F.col("_text"), ".,;:!?'\"()\\-").alias("n_punctuation"),
        _only(F.col("_text"), "!|").alias("n_marks"),
        F.length(F.regexp_replace("_text", "[\\p{L}\\x20\\x09-\\x0D#*$%&|<>0-9.,;:!?'\"()\\-]+", "")).cast("long").alias("n_other"),
        lines.alias("_lines"),
        grams.alias("_grams"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        F.filter("_words", lambda w: w.isin(every)).alias("_common"),
    )
    return df.select(
        *keep,
        *[c for c in df.columns if c.startswith(("n_", "word_")) and c not in keep],
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_grams")).alias("n_repeat_words"),
        F.size("_common").cast("long").alias("n_common"),
        "_common",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def js_distance(p: Column, q: Column) -> Column:
    """The square root of the Jensen-Shannon divergence of two arrays of shares, base 2."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs(text, lang, ...)`` with counts, distances, base_failed and kept.

    The counts are written to the shared folder once, since references and verdicts both need them. A reference is a
    row a language of ``COMMON``, so what the driver reads back does not grow.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col("lang").cast("string").alias("_lang"), "text")
    counted = text_counts(packed, ["_row", "_lang"])
    letters = F.col("n_chars") - F.col("n_upper") - F.col("n_digits") - F.col("n_punctuation") - F.col("n_symbols") - F.col("n_other") - (F.col("n_chars") - F.col("word_chars"))
    classes = F.array(F.col("n_chars") - F.col("word_chars"), letters, F.col("n_upper"), F.col("n_digits"), F.col("n_punctuation"), F.col("n_symbols"), F.col("n_other"))
    tally = F.lit(None).cast("array<bigint>")
    for lang, words in COMMON.items():
        own = F.array(*[(F.size("_common") - F.size(F.array_remove("_common", w))).cast("long") for w in words])
        tally = F.when(F.col("_lang") == lang, own).otherwise(tally)
    rest = F.array(F.col("n_words") - F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x))
    counted = counted.withColumn("classes", classes).withColumn("words", tally).withColumn("words", F.concat("words", rest)).withColumn("base_failed", base_failed()).drop("_common")
    counted = materialize(counted, "counts")

    # Conditions inside the sums, not as a filter, whose expressions Spark would copy down to the texts.
    known = F.when(F.col("_lang").isin(list(COMMON)), F.col("_lang")).alias("lang")
    sums = [F.array(*[F.sum(F.when(~F.col("base_failed"), F.get(c, F.lit(i)))) for i in range(n)]).alias(c) for c, n in (("classes", len(CLASSES)), ("words", 1 + len(COMMON["en"])))]
    found = [r for r in counted.groupBy(known).agg(*sums).collect() if r["lang"]]
    reference: dict[str, dict[str, Column]] = {}
    for r in found:
        if all(sum(x or 0 for x in r[c]) > 0 for c in ("classes", "words")):
            reference[r["lang"]] = {c: F.array(*[F.lit(x / sum(r[c])) for x in r[c]]) for c in ("classes", "words")}

    class_shares, word_shares = _shares(F.col("classes")), _shares(F.col("words"))
    class_distance = word_distance = F.lit(None).cast("double")
    each = [js_distance(class_shares, reference[x]["classes"]) for x in sorted(reference)]
    if each:
        class_distance = F.least(*each) if len(each) > 1 else each[0]
    for x in sorted(reference):
        is_x = F.col("_lang") == x
        class_distance = F.when(is_x, js_distance(class_shares, reference[x]["classes"])).otherwise(class_distance)
        word_distance = F.when(is_x, js_distance(word_shares, reference[x]["words"])).otherwise(word_distance)
    judged = counted.withColumn("class_distance", class_distance).withColumn("word_distance", word_distance)
    far = lambda c, most, least: (F.col("n_words") >= least) & (F.coalesce(c, F.lit(0.0)) > most)
    odd = far("class_distance", MAX_CLASS_DISTANCE, MIN_WORDS_FOR_CLASSES) | far("word_distance", MAX_WORD_DISTANCE, MIN_WORDS_FOR_WORDS)
    clash = {c.lower() for c in keep}
    extra = [c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance") if c not in clash]
    return judged.withColumn("kept", ~F.col("base_failed") & ~odd).select("_row.*", *extra, *([] if "kept" in clash else ["kept"]))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns.

    Texts are counted once, into a narrow stored table; its verdicts meet the rows again by key, in one shuffle of
    the texts, which costs a small part of counting them twice.
    """
    keyed = docs.select(*row_key("doc_id", "lang"), "lang", "text")
    return rows_of(docs, judge(keyed, ["_k1", "_k2"]).where("kept"), "doc_id", "lang")
