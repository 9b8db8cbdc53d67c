"""Quality rules by distribution divergence.

Each language has a reference: the share of each character class and of each common word in all its documents. A
document whose own shares lie too far from its language's, by Jensen-Shannon distance, fails; short documents, whose
shares say little, are not judged. Native DataFrame operations throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, ascii_lower, over_cores
from tessera.session import stage

#: Character classes, each counted in what the ones before leave over; the last one takes the rest.
CLASSES = (r"\p{Ll}+", r"\p{Lu}+", r"[\x20\x09-\x0D]+", r"[.,;:!?'\"()-]+", r"\p{N}+", r"[#*$%&|<>]+")
#: A word is common in a language if at least this share of its words are it, so there are at most 1/share of them.
COMMON_SHARE = 0.003
#: Texts of fewer characters or words are not judged by classes or by words.
MIN_CHARS = 200
MIN_WORDS = 50
#: Largest distances of a kept document.
MAX_CLASS_DISTANCE = 0.27
MAX_WORD_DISTANCE = 0.45
#: Base rules.
BASE_MIN_WORDS = 50
BASE_MAX_REPEATED = 50
SYMBOLS = r"[^#*$%&|<>]+"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK_RUN), lambda w: w != "")


def class_counts(text: Column) -> list[Column]:
    """Characters of each class, in the order of ``CLASSES`` and the rest."""
    counts, left = [], text
    for pattern in CLASSES:
        after = F.regexp_replace(left, pattern, "")
        counts.append(F.length(left) - F.length(after))
        left = after
    return [*counts, F.length(left)]


def js_terms(p: Column, q: Column) -> Column:
    """What one bin adds to twice the Jensen-Shannon divergence, in bits."""
    middle = (p + q) / 2
    of = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)
    return of(p) + of(q)


def references(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang, words (map of shares), others, classes (array of shares)``; the empty name is for null languages.

    Counts cover all documents. The result has a row per language and at most ``1 / COMMON_SHARE`` words in each.
    """
    named = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = stage(
        named.select("lang", F.explode(words_of(ascii_lower(F.col("text")))).alias("word"))
        .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")),
        "word-counts",
    )
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    common = (
        counted.join(F.broadcast(totals), "lang")  # a row per language
        .withColumn("share", F.col("n") / F.col("total"))
        .filter(F.col("share") >= COMMON_SHARE)
        .groupBy("lang")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "share")))).alias("words"), F.sum("share").alias("common"))
    )
    sums = [F.sum(c).alias(f"c{i}") for i, c in enumerate(class_counts(F.col("text")))]
    names = [f"c{i}" for i in range(len(sums))]
    classes = named.groupBy("lang").agg(*sums, F.sum(F.length("text")).alias("chars"))
    shares = F.array(*[F.coalesce(F.col(c) / F.nullif(F.col("chars"), F.lit(0)), F.lit(0.0)) for c in names])
    return classes.join(common, "lang", "left").select(
        "lang", F.coalesce("words", F.create_map().cast("map<string,double>")).alias("words"),
        F.greatest(F.lit(0.0), 1.0 - F.coalesce("common", F.lit(0.0))).alias("others"), shares.alias("classes"),
    )


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``<key>, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance, kept``.

    A null text is empty: it has no words and fails the base rules. A null language has a reference of its own. Texts
    below the guards have null distances and pass. Rows that repeat each get their row, other columns are not read.

    Counts over all documents come first; then one scan without a shuffle judges each document by itself. The
    references, a row per language of bounded size, are the only thing that is broadcast.
    """
    learned = stage(references(docs, text, lang), "references")
    names = sorted({w for r in learned.select(F.map_keys("words").alias("w")).collect() for w in r["w"]})
    rows = over_cores(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")), "key").select(
        "key", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang")
    )
    worded = rows.withColumn("words_", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    at = lambda i: F.element_at("words_", i)
    windows = F.when(
        F.size("words_") >= 3,
        F.transform(F.sequence(F.lit(1), F.size("words_") - 2), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    common = F.filter(words_of(ascii_lower(F.col("text"))), lambda w: w.isin(names)) if names else F.array().cast("array<string>")
    counts = class_counts(F.col("text"))
    measured = worded.select(
        "key", "lang",
        F.size("words_").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", BLANK_RUN, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"), common.alias("common"), F.length("text").alias("chars"), F.array(*counts).alias("counts"),
    )
    # Only texts with a window that comes back need its places.
    placed = measured.withColumn(
        "placed",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("windows")
    twin = lambda e, i: (F.get("placed", i - 1)["h"].eqNullSafe(e["h"])) | (F.get("placed", i + 1)["h"].eqNullSafe(e["h"]))
    again = placed.withColumn("again", F.array_sort(F.transform(F.filter("placed", twin), lambda e: e["i"]))).drop("placed")
    steps = F.zip_with("again", F.slice("again", 2, F.greatest(F.size("again"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")
    based = again.withColumn("n_repeat_words", repeated).drop("again")
    joined = based.join(F.broadcast(learned), "lang", "left")
    class_js = F.aggregate(
        F.zip_with("counts", "classes", lambda c, q: js_terms(c / F.col("chars"), q)), F.lit(0.0), lambda s, x: s + x
    )
    present = F.filter(F.array_distinct("common"), lambda w: F.map_contains_key("words", w))
    shares = F.transform(
        present, lambda w: F.struct((F.size(F.filter("common", lambda x: x == w)) / F.col("n_words")).alias("p"), F.element_at("words", w).alias("q"))
    )
    compared = joined.withColumns({"class_js": class_js, "shares": shares}).drop("common", "words", "counts", "classes")
    taken = F.aggregate("shares", F.lit(0.0), lambda s, x: s + x["p"])
    both = F.aggregate("shares", F.lit(0.0), lambda s, x: s + js_terms(x["p"], x["q"]))
    absent = F.greatest(F.lit(0.0), 1.0 - F.col("others") - F.aggregate("shares", F.lit(0.0), lambda s, x: s + x["q"]))
    other = js_terms(F.greatest(F.lit(0.0), 1.0 - taken), F.col("others"))
    distance = lambda twice: F.sqrt(F.greatest(F.lit(0.0), twice / 2))
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEATED * F.col("n_words"))
    far = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(
        F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False)
    )
    return (
        compared.withColumn("class_distance", F.when(F.col("chars") >= MIN_CHARS, distance(F.col("class_js"))))
        .withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, distance(both + absent + other)))
        .select(
            F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            failed.alias("base_failed"), "class_distance", "word_distance", (~failed & ~far).alias("kept"),
        )
    )
