"""Quality rules: base counts, and distribution divergence from language references. DataFrame functions only.

One pass over the texts writes each document's counts to the shared folder: words, symbols,
repeated lines and windows, a histogram of character classes and one of common words. The
language references are sums of those histograms over all documents of a language (rows without
a language: over all documents). A document is rejected if its Jensen-Shannon distance to its
reference is above the limit in either histogram; texts with fewer words than a guard aren't
judged by that histogram, as short texts differ by chance.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Common words of four languages.
COMMON = (
    "the of and to in that is was for on with as it be by this "
    "der die das und zu den von mit ist nicht ein auf für im dem sich "
    "de la le et les des un que en du une est pour dans par sur "
    "el los y se del las con para su al como más una por lo"
).split()


def _but(chars: str) -> str:
    """A pattern of runs of all but `chars`, which are listed one by one: the matcher tests such a class by a table, a range by a chain of conditions."""
    return "[^" + "".join("\\" + c if c in "\\[]^-&" else c for c in chars) + "]+"


_SPACE = " \t\n\v\f\r"
#: The characters of each class. Upper, digit, mark and the rest are counted by removing all others, space and lower are what is left.
CLASSES = {"lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "digit": string.digits, "space": _SPACE, "mark": string.punctuation}
OTHER = _but("".join(CLASSES.values())).replace("[^", "[", 1)
SYMBOLS = _but("#*$%&|<>")
#: The least words for each histogram, and the greatest distances (0 to 1) kept.
LEAST_CLASS, LEAST_COMMON, FAR_CLASS, FAR_COMMON = 50, 100, 0.25, 0.40
_COUNTERS = [chr(0x100 + i) for i in range(len(COMMON))]


def _repeats(words: Column) -> Column:
    """Words inside windows of three that come twice or more, from sorted window hashes and places."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))

    def places(pairs: Column) -> Column:
        last = F.size(pairs)
        twice = F.filter(pairs, lambda p, i: ((i > 0) & (F.get(pairs, i - 1)["g"] == p["g"])) | ((i + 1 < last) & (F.get(pairs, i + 1)["g"] == p["g"])))
        return F.sort_array(F.transform(twice, lambda p: p["i"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).cast("long").alias("n")))["n"]

    def counted(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(common.let(pairs, places)))

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(common.let(grams, counted))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes and common (arrays of counts) of every row."""
    left = lambda pattern: F.length(F.regexp_replace("t", pattern, "")).cast("long")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    d = d.withColumn("words", F.filter(F.split("t", "[ \\t-\\r]+"), lambda w: w != "")).withColumn("lines", F.filter(F.split("t", "\n"), lambda s: s.rlike("[^ \\t-\\r]")))
    d = d.withColumns({"n": F.length("t").cast("long"), "chars": F.length(F.array_join("words", "")).cast("long"), "other": left(OTHER), **{k: left(_but(CLASSES[k])) for k in ("upper", "digit", "mark")}})
    d = d.withColumn("space", F.col("n") - F.col("chars")).withColumn("lower", F.col("chars") - F.col("upper") - F.col("digit") - F.col("mark") - F.col("other"))
    places = F.transform(F.filter("words", lambda w: F.length(w) <= max(map(len, COMMON))), lambda w: F.find_in_set(F.lower(w), F.lit(",".join(COMMON))))  # a comma is in no word of the list, so a word that has one isn't found
    marks = F.array_join(F.transform(F.filter(places, lambda i: i > 0), lambda i: F.substring(F.lit("".join(_COUNTERS)), i, 1)), "")
    d = d.withColumn("marks", marks)
    return d.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), F.col("chars").alias("word_chars"), left(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _repeats(F.col("words")).alias("n_repeat_words"),
        F.array(*CLASSES, "other").alias("classes"),
        F.array(*[F.length("marks") - F.length(F.replace(F.col("marks"), F.lit(c), F.lit(""))) for c in _COUNTERS], F.size("words") - F.length("marks")).cast("array<long>").alias("common"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts; null if either has none."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    shares = lambda a: common.let(total(a), lambda t: F.transform(a, lambda x: x / t))
    terms = F.zip_with(shares(p), shares(q), lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2)))


def references(each: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_common) from all rows; lang null is the reference of all rows."""
    sums = lambda name, n: F.array(*[F.sum(F.col(name)[i]) for i in range(n)]).cast("array<long>").alias(f"ref_{name}")
    cols = [sums("classes", len(CLASSES) + 1), sums("common", len(COMMON) + 1)]
    return each.where("lang is not null").groupBy("lang").agg(*cols).unionByName(each.agg(*cols).withColumn("lang", F.lit(None).cast("string")))


def judge(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, the counts, base_failed, class_distance, common_distance (to six places; null where not judged), kept.

    Null text has no words; empty and short texts fail the base. Equal rows give equal rows. Extra columns are ignored.
    """
    each = common.stored(counts(docs), "counts")
    refs = common.stored(references(each), "references")
    every = refs.where("lang is null").select(F.col("ref_classes").alias("all_classes"), F.col("ref_common").alias("all_common"))
    # not broadcast by hint: the number of languages has no bound; few are broadcast by their size
    known = each.join(refs.where("lang is not null"), "lang", "left").join(F.broadcast(every))  # one row joins all: the reference of all rows
    far = lambda name, least: F.when(F.col("n_words") >= least, F.round(distance(F.col(name), F.coalesce(f"ref_{name}", f"all_{name}")), 6)).alias(f"{name.removesuffix('es')}_distance")
    near = known.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        far("classes", LEAST_CLASS), far("common", LEAST_COMMON),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd = (F.coalesce("class_distance", F.lit(0.0)) > FAR_CLASS) | (F.coalesce("common_distance", F.lit(0.0)) > FAR_COMMON)
    return near.withColumn("base_failed", failed).withColumn("kept", ~failed & ~odd)
