"""Quality rules and distribution divergence, with DataFrame functions only.

Every document gets two histograms: character classes, and common words (function words of a few languages
and all other words as one).  The languages' references are the summed histograms of all documents of that
``lang`` and PRIOR average documents of the whole table, which decide for rare languages.  A document fails when the Jensen-Shannon distance of one of its histograms to its language's
reference exceeds the bound, if it has at least so many characters or words that the distance means
something.  Everything of a document is computed inside its row; only the small histograms are shuffled.

Repetition inside a text uses 64-bit hashes of three-word windows: texts without an equal pair (most) end
there, the others sort (hash, place) pairs once.

Defined cases: null and empty texts have no words and fail the length rule; a null ``lang`` is a language
of its own; if the base rule keeps no document, there is no reference and no distance; repeated rows are
judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm.common import SPACE, body, written

#: Frequent function words of English, French, Spanish and German.
COMMON = tuple(sorted({
    *"the of and to in a is that for it was on with as be by this are from or an not".split(),
    *"de la le et les des en un une du que est pour dans qui par sur au pas elle".split(),
    *"el los las y del se por con para una su al lo como es".split(),
    *"der die und den von zu das mit sich dem nicht ein eine ist auf im auch".split(),
}))
#: Character classes, as regular expressions of what they hold; the rest is a class too.
CLASSES = ("aeiou", "b-df-hj-np-tv-z", "A-Z", "0-9", r"\x20\t\x0B\f\r", r"\n", r".,;:!?'\"()\-", r"#*$%&|<>", r"À-ɏ", r"Ͱ-￿")
SYMBOLS = CLASSES.index(r"#*$%&|<>")
LEAST_CHARS, LEAST_WORDS, PRIOR = 400, 80, 20
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.25, 0.30
MIN_WORDS, MOST_REPEATED = 50, 50


def _words() -> Column:
    return F.filter(F.split(body(), SPACE), lambda w: w != "")


def _repeated(windows: Column) -> Column:
    """Words inside three-word windows whose hash occurs twice or more among ``windows`` (in text order)."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(windows)

    def marked(sorted_pairs: Column) -> Column:
        twice = F.filter(
            sorted_pairs,
            lambda x, k: ((k > 0) & (F.get(sorted_pairs, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(sorted_pairs, k + 1)["h"] == x["h"])),
        )
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).alias("last"))
        step = lambda s, p: F.struct((s["sum"] + F.least(F.lit(3), p - s["last"])).cast("long").alias("sum"), p.alias("last"))
        return F.aggregate(places, start, step, lambda s: s["sum"])

    chain = F.transform(F.array(pairs), lambda p: covered(marked(p)))  # binds the sorted array once
    return F.when(n > F.size(F.array_distinct(windows)), F.element_at(chain, 1)).otherwise(F.lit(0)).cast("long")


def _class_counts(texts: DataFrame) -> DataFrame:
    """Add ``classes``, the characters of each class in ``text``.

    Small letters, most of a text, are taken out in one pass and their vowels counted in another; each further
    class is taken out of what the ones before have left.
    """
    without = lambda column, holds: F.regexp_replace(column, f"[{holds}]+", "")
    order = [4, 8, 2, 6, 5, 3, 7, 9]  # the most frequent first
    left = texts.withColumn("_left", without("text", "a-z"))
    left = left.withColumn("_0", F.length(F.regexp_replace("text", "[^aeiou]+", ""))).withColumn("_1", F.length("text") - F.length("_left") - F.col("_0"))
    for k in order:
        left = left.withColumn("_less", without("_left", CLASSES[k])).withColumn(f"_{k}", F.length("_left") - F.length("_less"))
        left = left.drop("_left").withColumnRenamed("_less", "_left")
    counts = F.array(*[F.col(f"_{k}").cast("double") for k in range(len(CLASSES))])
    return left.select(*texts.columns, counts.alias("classes"))


def features(docs: DataFrame) -> DataFrame:
    """Counts and both histograms of every document, with the base rule."""
    text = _class_counts(docs.select("doc_id", "lang", body().alias("text"), _words().alias("words")))
    windows = F.transform(F.filter(F.col("words"), lambda w, i: i < F.size("words") - 2), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lowered = F.filter(F.transform("words", F.lower), lambda w: w.isin(*COMMON))
    wide = (
        text.withColumn("n_words", F.size("words").cast("long"))
        .withColumn("windows", windows)
        .withColumn("n_chars", F.length("text"))
        .withColumn("common", lowered)
        .withColumn("lines", lines)
    )
    rows = wide.select(
        "doc_id", "lang", "n_words", "n_chars",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.get("classes", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("windows")).alias("n_repeat_words"),
        "classes",
        F.array(*[(F.size("common") - F.size(F.array_remove("common", w))).cast("double") for w in COMMON]).alias("common"),
    )
    rest = lambda total, parts: F.concat(parts, F.array(F.greatest(F.lit(0.0), total - F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_chars",
        rest(F.col("n_chars").cast("double"), F.col("classes")).alias("classes"), rest(F.col("n_words").cast("double"), F.col("common")).alias("common"),
    )


def references(rows: DataFrame) -> DataFrame:
    """Summed histograms of every language, over all its documents that the base rule keeps, and of PRIOR
    average ones of all languages; their totals too."""
    sums = [F.sum(F.when(~F.col("base_failed"), F.get(name, F.lit(i)))).alias(f"{name}_{i}") for name, n in _SIZES.items() for i in range(n)]
    flat = rows.groupBy("lang").agg(F.count_if(~F.col("base_failed")).alias("docs"), *sums).fillna(0.0)
    every = Window.partitionBy(F.lit(0))  # one row per language
    prior = F.lit(PRIOR) / F.greatest(F.sum("docs").over(every), F.lit(1))
    smooth = [F.array(*[F.col(f"{name}_{i}") + prior * F.sum(f"{name}_{i}").over(every) for i in range(n)]).alias(f"_{name}") for name, n in _SIZES.items()]
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    return flat.select(F.col("lang").alias("_lang"), *smooth).withColumns({f"_{name}_total": total(f"_{name}") for name in _SIZES})


_SIZES = {"classes": len(CLASSES) + 1, "common": len(COMMON) + 1}


def distance(one: Column, two: Column, total_one: Column, total_two: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of equal length and known totals."""
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    shares = F.zip_with(one, two, lambda a, b: F.struct((a / total_one).alias("p"), (b / total_two).alias("q"), (a / total_one + b / total_two).alias("both")))
    terms = F.aggregate(shares, F.lit(0.0), lambda s, x: s + part(x["p"], x["both"] / 2) + part(x["q"], x["both"] / 2))
    return F.sqrt(F.greatest(F.lit(0.0), terms / 2))


def quality(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed``, both distances (null below the guards) and ``kept`` of every document."""
    rows = written(features(docs), "features")
    known = rows.join(references(rows), F.col("lang").eqNullSafe(F.col("_lang")))
    judge = lambda name, size, least: F.when(
        (F.col(size) >= least) & (F.col(f"_{name}_total") > 0), distance(F.col(name), F.col(f"_{name}"), F.col(size).cast("double"), F.col(f"_{name}_total"))
    )
    judged = known.withColumn("class_distance", judge("classes", "n_chars", LEAST_CHARS)).withColumn("word_distance", judge("common", "n_words", LEAST_WORDS))
    odd = (F.coalesce("class_distance", F.lit(0.0)) > MOST_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD_DISTANCE)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~odd).alias("kept"), "class_distance", "word_distance"
    )
