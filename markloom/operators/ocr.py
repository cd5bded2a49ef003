"""Handwriting-recognition benchmark: labels, scores, reports and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions.text import norm, text_or_empty, trimmed
from markloom.operators import sequences as S


def label_manifest(raw: DataFrame) -> DataFrame:
    """Manifest rows with state labeled / skipped (no grade) / pending (answer still to be typed)."""
    grade = F.lower(trimmed(F.col("grade")))
    truth, source = trimmed(F.col("truth")), text_or_empty(F.col("truth_source"))
    state = (
        F.when(~grade.isin(*K.HANDWRITING), "skipped")
        .when((grade != "blank") & (truth == ""), "pending")
        .otherwise("labeled")
    )
    return raw.withColumn("state", state).withColumns(
        {"grade": grade, "truth": truth, "truth_source": trimmed(F.when(source == "", "typed").otherwise(source))}
    )


def accepted_rows(manifest: DataFrame) -> DataFrame:
    """(row_id, accepted): every spelling that counts as right; candidates first, else the answer."""
    raw = F.coalesce(F.nullif(F.col("candidates"), F.lit("")), F.col("answer"), F.lit(""))
    rows = manifest.select("row_id", F.explode(F.split(raw, r"\|")).alias("_c"))
    return rows.select("row_id", trimmed(F.col("_c")).alias("accepted")).filter("accepted <> ''").distinct()


def answer_pool(manifest: DataFrame) -> DataFrame:
    return accepted_rows(manifest).select("accepted").distinct()


def canonical(answer: Column, candidates: Column) -> Column:
    first = F.get(F.split(text_or_empty(candidates), r"\|"), F.lit(0))
    return trimmed(F.coalesce(F.nullif(answer, F.lit("")), first))


def expand_number_ranges(specs: DataFrame, spec: str, out: str = "no") -> DataFrame:
    """'3,7,12-14' to one row per number (as text); descending ranges are empty.

    A range whose ends are not numbers stops the job: ``unreadable_ranges`` lists all of them beforehand.
    """
    keys = [c for c in specs.columns if c != spec]
    parts = specs.select(*keys, F.explode(F.split(text_or_empty(F.col(spec)), ",")).alias("_raw"))
    parts = parts.select(*keys, trimmed(F.col("_raw")).alias("_p")).filter("_p <> ''")
    low, high = _bounds()
    broken = F.raise_error(F.concat(F.lit("a range that is not numbers: "), "_p")).cast("array<bigint>")
    span = F.when(low.isNull() | high.isNull(), broken).when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    numbers = F.when(F.contains("_p", F.lit("-")), span.cast("array<string>")).otherwise(F.array("_p"))
    return parts.select(*keys, F.explode(numbers).alias(out)).distinct()


def _bounds() -> tuple[Column, Column]:
    low = F.substring_index("_p", "-", 1)
    high = F.substring(F.col("_p"), F.length(low) + 2, F.length("_p"))
    return trimmed(low).try_cast("bigint"), trimmed(high).try_cast("bigint")


def unreadable_ranges(specs: DataFrame, spec: str) -> DataFrame:
    """Range parts whose ends are not numbers; these have to be corrected by hand."""
    keys = [c for c in specs.columns if c != spec]
    parts = specs.select(*keys, F.explode(F.split(text_or_empty(F.col(spec)), ",")).alias("_raw"))
    parts = parts.select(*keys, trimmed(F.col("_raw")).alias("_p")).filter(F.contains("_p", F.lit("-")))
    low, high = _bounds()
    return parts.filter(low.isNull() | high.isNull()).select(*keys, F.col("_p").alias("part"))


def fill_truth(manifest: DataFrame, marks: DataFrame, overwrite: bool = False) -> DataFrame:
    """Fill labels from a teacher's marks.

    ``marks``: one row per student (student, grade, wrong, blank) with number specs. Typed labels
    are kept unless ``overwrite``; blanks are empty; wrong ones wait to be typed; all others are
    assumed to show the canonical answer. Rows of students without marks stay as they are
    ('untouched'). Adds ``action``.
    """
    known = marks.select("student", F.col("grade").alias("_grade"), F.lit(True).alias("_marked"))
    flagged = [
        expand_number_ranges(marks.select("student", spec), spec, "_q").withColumn(f"_{spec}", F.lit(True)) for spec in ("blank", "wrong")
    ]
    base = manifest.withColumn("_q", trimmed(F.col("question"))).withColumn("_s", trimmed(F.col("student")))
    joined = base.join(known.withColumnRenamed("student", "_s"), "_s", "left")
    for df in flagged:
        joined = joined.join(df.withColumnRenamed("student", "_s"), ["_s", "_q"], "left")
    action = (
        F.when(F.col("_marked").isNull(), "untouched")
        .when((F.col("truth_source") == "typed") & F.lit(not overwrite), "skipped")
        .when(F.col("_blank").isNotNull(), "blank")
        .when(F.col("_wrong").isNotNull(), "to_type")
        .otherwise("assumed")
    )
    a = F.col("action")
    by = lambda keep, blank, wrong, rest: (
        F.when(a.isin("skipped", "untouched"), keep).when(a == "blank", blank).when(a == "to_type", wrong).otherwise(rest)
    )
    out = joined.withColumn("action", action)
    truth = by(F.col("truth"), F.lit(""), F.lit(""), canonical(F.col("answer"), F.col("candidates")))
    grade = by(F.col("grade"), F.lit("blank"), F.col("_grade"), F.col("_grade"))
    source = by(F.col("truth_source"), F.lit("assumed"), F.lit(""), F.lit("assumed"))
    return out.withColumns({"truth": truth, "grade": grade, "truth_source": source}).drop("_s", "_q", "_grade", "_marked", "_blank", "_wrong")


def label_fill_stats(filled_rows: DataFrame) -> DataFrame:
    return filled_rows.groupBy("student", "action").agg(F.count("*").alias("n"))


def todo_list(manifest: DataFrame, n: int = 40) -> tuple[DataFrame, DataFrame]:
    """(first n labels to type, one row of counts: to type, not shown, untouched)."""
    grade, truth = trimmed(F.col("grade")), trimmed(F.col("truth"))
    pending = (truth == "") & ~grade.isin("blank", "")
    counts = manifest.agg(F.count_if(pending).alias("pending"), F.count_if(grade == "").alias("unlabeled"))
    counts = counts.withColumn("not_shown", F.greatest(F.lit(0), F.col("pending") - n))
    rows = manifest.filter(pending).withColumn("canonical", canonical(F.col("answer"), F.col("candidates")))
    return rows.orderBy("row_id").limit(n), counts


def ocr_score_rows(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Every result with its label and the flags exact, unreadable, misread, lenient, harsh.

    ``manifest``: labeled rows. Spellings are compared after normalising, as rows of a table rather
    than inside arrays, so right answers are found by an equi join.
    """
    ok = accepted_rows(manifest).select("row_id", norm(F.col("accepted")).alias("_text")).distinct()
    label = manifest.select("row_id", "grade", "truth", "truth_source", norm(F.col("truth")).alias("_text"))
    right = label.filter("_text <> ''").join(ok, ["row_id", "_text"], "left_semi").select("row_id", F.lit(True).alias("_right"))
    truth = label.join(right.distinct(), "row_id", "left").withColumnRenamed("_text", "_truth")
    read = results.withColumn("_text", norm(F.col("text"))).join(truth, "row_id")
    scored = read.join(ok.withColumn("_hit", F.lit(True)), ["row_id", "_text"], "left")
    legible = F.coalesce(F.col("legible"), F.lit(False))
    exact = F.col("_truth") == F.col("_text")
    truth_ok = F.col("_right").isNotNull()
    pred_ok = (F.col("_text") != "") & F.col("_hit").isNotNull()
    return scored.select(
        *results.columns, "grade", "truth",
        (F.col("truth_source") == "assumed").alias("assumed"),
        exact.alias("exact"), truth_ok.alias("truth_correct"), pred_ok.alias("pred_correct"),
        (~legible).alias("unreadable"), (legible & ~exact).alias("misread"),
        (~truth_ok & pred_ok).alias("lenient"), (truth_ok & ~pred_ok).alias("harsh"),
    )


def ocr_report(scored: DataFrame) -> DataFrame:
    """Rates per mode and handwriting grade, and per mode over all grades (grade 'all').

    The median keeps one counter per distinct millisecond value and combines map-side.
    """
    rate = lambda c: (F.count_if(c) / F.count("*") * 100).alias(c)
    sets = scored.groupingSets([["mode", "grade"], ["mode"]], "mode", "grade").agg(
        F.count("*").alias("n"),
        *[rate(c) for c in ("exact", "unreadable", "misread", "lenient", "harsh")],
        (F.median(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))) / 1000).alias("median_seconds"),
        F.grouping("grade").alias("_all"),
    )
    return sets.withColumn("grade", F.when(F.col("_all") == 1, "all").otherwise(F.col("grade"))).drop("_all")


def ocr_gate(scored: DataFrame) -> DataFrame:
    """Per mode over non-blank cells: accuracy at least 95 % and misreads under 1 %."""
    real = scored.filter("grade <> 'blank'").groupBy("mode").agg(
        F.avg(F.col("exact").cast("double")).alias("accuracy"), F.avg(F.col("misread").cast("double")).alias("misread_rate")
    )
    ok = (F.col("accuracy") >= K.OCR_ACCURACY) & (F.col("misread_rate") < K.OCR_MISREAD)
    return real.withColumn("ok", ok)


def leniency_report(scored: DataFrame, k: int = 3, order: str = "call_id") -> DataFrame:
    """Wrong answers that were written, how many were read as right, and k examples per mode."""
    target = scored.filter((F.col("truth") != "") & ~F.col("truth_correct"))
    counts = target.groupBy("mode").agg(F.count("*").alias("wrong_written"), F.count_if("pred_correct").alias("read_as_right"))
    shown = F.concat(F.col("truth"), F.lit("→"), text_or_empty(F.col("text")))
    top = S.first_rows(target.filter("pred_correct").withColumn("_e", shown), ["mode"], [F.col(order)], k, rank="_k")
    examples = top.groupBy("mode").agg(F.sort_array(F.collect_list(F.struct("_k", "_e"))).alias("_all"))
    text = F.array_join(F.transform("_all", lambda x: x["_e"]), ", ")
    return counts.join(examples, "mode", "left").select(
        "mode", "wrong_written", "read_as_right", F.coalesce(text, F.lit("—")).alias("examples")
    )


def assumed_label_conflicts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("mode").agg(F.count_if(F.col("assumed") & ~F.col("exact")).alias("conflicts"))


def ocr_cost(scored: DataFrame, prices: DataFrame, model: str, batched: bool = False) -> DataFrame:
    """Cost and cost per call of every mode; batches cost half; an unknown model gives NULL."""
    sums = scored.groupBy("mode").agg(
        F.count("*").alias("n"), F.sum("in_tok").alias("_i"), F.sum("out_tok").alias("_o"), F.count("error").alias("errors")
    )
    price = prices.filter(F.col("model") == model).select("model", "usd_in", "usd_out")
    joined = sums.withColumn("model", F.lit(model)).join(price, "model", "left")
    usd = (F.col("_i") * F.col("usd_in") + F.col("_o") * F.col("usd_out")) / 1_000_000 * (0.5 if batched else 1.0)
    return joined.select("mode", "n", "errors", usd.alias("cost_usd"), (usd / F.col("n")).alias("cost_per_call"))
