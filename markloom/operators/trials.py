"""Re-grading a sheet under another condition, and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions.money import pct
from markloom.functions.text import norm
from markloom.operators import sequences as S
from markloom.operators.verdict import decide, item_tallies
from markloom.session import shuffled

CONDITION = ("model", "effort", "variant", "edge")


def latest_trial(trials: DataFrame) -> DataFrame:
    """Newest run per sheet and condition; a missing variant means the full one."""
    known = trials.withColumn("variant", F.coalesce("variant", F.lit("full")))
    return S.first_rows(known, ["sheet_id", *CONDITION], [F.col("created_at").desc(), F.col("trial_id").desc()])


def untried_sheets(sheets: DataFrame, latest: DataFrame) -> DataFrame:
    return sheets.join(latest.select("sheet_id").distinct(), "sheet_id", "left_anti")


def failed_reasons(latest: DataFrame) -> DataFrame:
    return latest.filter("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def system_verdicts(items: DataFrame, sheets: DataFrame) -> DataFrame:
    """Verdict recomputed from the system's own judgements, nothing held out.

    The stored sheet columns may already carry a teacher's corrections and must not be compared.
    """
    wrong = ~F.coalesce(F.col("correct"), F.lit(False))
    tallies = item_tallies(items, wrong, F.lit(False))
    heads = sheets.select(
        "sheet_id", F.coalesce(F.col("missing"), F.lit(0)).cast("bigint").alias("missing"),
        F.coalesce("cut_line", "transcript_cut").alias("cut_text"),
    )
    return decide(tallies.join(heads, "sheet_id")).select("sheet_id", "n", "n_wrong", "cut", "verdict", "near_boundary", "margin")


def call_totals(calls: DataFrame) -> DataFrame:
    """Per sheet: time, tokens with cached input, model and effort of the first call."""
    cached = F.coalesce("cache_read", F.lit(0)) + F.coalesce("cache_write", F.lit(0))
    return calls.groupBy("sheet_id").agg(
        F.sum("latency_ms").alias("latency_ms"),
        F.sum(F.col("input_tokens") + cached).alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.min_by(F.struct("model", "effort"), "pos").alias("_first"),
    ).select("sheet_id", "latency_ms", "input_tokens", "output_tokens", "_first.model", "_first.effort")


def bench_base_runs(items: DataFrame, sheets: DataFrame, calls: DataFrame, default_model: str) -> DataFrame:
    """The base side of a comparison: system verdict, cost and tokens of every sheet with items."""
    base = system_verdicts(items, sheets)
    cost = sheets.select("sheet_id", F.coalesce(F.col("cost_usd"), F.lit(0)).alias("cost_usd"))
    joined = base.join(cost, "sheet_id").join(call_totals(calls), "sheet_id", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("latency_ms", "input_tokens", "output_tokens")]
    return joined.select(
        *base.columns, "cost_usd", *zero, F.coalesce("model", F.lit(default_model)).alias("model"),
        F.coalesce("effort", F.lit(K.NO_EFFORT)).alias("effort"),
    )


def _side(items: DataFrame, prefix: str, keys: tuple[str, ...]) -> DataFrame:
    """One row per number: the last reading counts, wrong when any of its results is wrong."""
    judged = F.col("judged") if "judged" in items.columns else F.lit(True)
    wrong = judged & ~F.coalesce(F.col("correct"), F.lit(False))
    return items.groupBy(*keys, "no").agg(
        F.max_by("written", "seq").alias(f"{prefix}_written"),
        F.bool_or(wrong).alias(f"{prefix}_wrong"),
        F.bool_or(judged).alias(f"{prefix}_judged"),
        F.lit(True).alias(f"in_{prefix}"),
    )


def run_diff_items(base_items: DataFrame, trial_items: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Per number: which side read it, whether the text differs after normalising, whether the result differs."""
    base, trial = _side(base_items, "base", keys), _side(trial_items, "trial", keys)
    joined = base.join(trial, [*keys, "no"], "full_outer")
    in_base, in_trial = (F.coalesce(F.col(c), F.lit(False)) for c in ("in_base", "in_trial"))
    both = in_base & in_trial
    judged = both & F.coalesce(F.col("base_judged") & F.col("trial_judged"), F.lit(False))
    b, t = F.col("base_wrong"), F.col("trial_wrong")
    return joined.select(
        *keys, "no", in_base.alias("in_base"), in_trial.alias("in_trial"), "base_written", "trial_written",
        (both & (norm(F.col("base_written")) != norm(F.col("trial_written")))).alias("written_differs"),
        judged.alias("judged"),
        (judged & b & ~t).alias("wrong_only_base"),
        (judged & t & ~b).alias("wrong_only_trial"),
    )


def _agreement(counts: DataFrame) -> DataFrame:
    agree = F.col("n") - F.col("wrong_only_base") - F.col("wrong_only_trial")
    return counts.withColumn("agree", agree).withColumn("verdict_match", F.col("base_verdict") == F.col("trial_verdict"))


def sheet_run_diff(diff_items: DataFrame, base_runs: DataFrame, trial_runs: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Per sheet: verdict match (NULL when either side is undecided) and item counts."""
    counts = diff_items.groupBy(*keys).agg(
        F.count_if("in_base").alias("base_read"),
        F.count_if("in_trial").alias("trial_read"),
        F.count_if(F.col("in_base") & ~F.col("in_trial")).alias("only_base"),
        F.count_if(F.col("in_trial") & ~F.col("in_base")).alias("only_trial"),
        F.count_if("written_differs").alias("written_diffs"),
        F.count_if("judged").alias("n"),
        F.count_if("wrong_only_base").alias("wrong_only_base"),
        F.count_if("wrong_only_trial").alias("wrong_only_trial"),
    )
    base = base_runs.select(
        "sheet_id", F.col("verdict").alias("base_verdict"), F.col("near_boundary").alias("base_near"), F.col("margin").alias("base_margin")
    )
    trial = trial_runs.select(*keys, F.col("verdict").alias("trial_verdict"))
    return _agreement(counts.join(base, "sheet_id").join(trial, list(keys)))


def runs_diff(base_items: DataFrame, trial_items: DataFrame, base_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """sheet_run_diff of many runs of a sheet: one row for every run whose sheet has base items.

    The base side stays one row a number: every run's numbers look it up, and what a run lacks is the base count
    less the numbers both have.  So the base is never copied for each run.  ``base_runs``: bench_base_runs of the
    same items, whose ``n`` is that count; ``runs``: (trial_id, sheet_id, verdict).  Further columns of both are kept,
    so each is joined once; rows of sheets and runs are too many to be collected for a broadcast.
    """
    keys = ("trial_id", "sheet_id")
    base = _side(base_items, "base", ("sheet_id",))
    cells = _side(S.spread(trial_items, "sheet_id", "no"), "trial", keys).join(shuffled(base), ["sheet_id", "no"], "left")
    both = F.col("in_base").isNotNull()
    judged = both & F.col("base_judged") & F.col("trial_judged")
    b, t = F.col("base_wrong"), F.col("trial_wrong")
    names = ("trial_read", "_both", "written_diffs", "n", "wrong_only_base", "wrong_only_trial")
    found = cells.groupBy(*keys).agg(
        F.count("*").alias("trial_read"),
        F.count_if(both).alias("_both"),
        F.count_if(both & (norm(F.col("base_written")) != norm(F.col("trial_written")))).alias("written_diffs"),
        F.count_if(judged).alias("n"),
        F.count_if(judged & b & ~t).alias("wrong_only_base"),
        F.count_if(judged & t & ~b).alias("wrong_only_trial"),
    )
    heads = base_runs.withColumnsRenamed({"n": "base_read", "verdict": "base_verdict", "near_boundary": "base_near", "margin": "base_margin"})
    listed = runs.withColumnRenamed("verdict", "trial_verdict").join(shuffled(found), list(keys), "left").fillna(0, list(names))
    counts = listed.join(shuffled(heads), "sheet_id")
    counts = counts.withColumn("only_base", F.col("base_read") - F.col("_both")).withColumn("only_trial", F.col("trial_read") - F.col("_both"))
    return _agreement(counts.drop("_both"))


def trial_summary(diffs: DataFrame, dims: list[str]) -> DataFrame:
    """One row per condition. ``diffs``: sheet_run_diff plus base_/trial_ cost, ms, in, out columns."""
    match, near = F.col("verdict_match"), F.coalesce(F.col("base_near"), F.lit(False))
    flipped = match.isNotNull() & ~match
    both_pass = (F.col("base_verdict") == "pass") & (F.col("trial_verdict") == "pass")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (
        "base_cost", "trial_cost", "base_ms", "trial_ms", "base_in", "trial_in", "base_out", "trial_out")]
    return diffs.groupBy(*dims).agg(
        F.count("*").alias("sheets"),
        F.count("verdict_match").alias("compared"),
        F.count_if(match).alias("verdict_agree"),
        F.count_if(flipped).alias("flipped"),
        F.count_if(flipped & near).alias("flipped_at_boundary"),
        F.count_if(flipped & ~near).alias("flipped_with_margin"),
        F.count_if(match.isNull() & F.col("base_verdict").isNotNull()).alias("trial_undecided"),
        F.count_if(match.isNull() & F.col("base_verdict").isNull()).alias("incomparable"),
        F.sum("n").alias("items_compared"),
        F.sum("agree").alias("items_agree"),
        F.sum("wrong_only_base").alias("items_wrong_only_base"),
        F.sum("wrong_only_trial").alias("items_wrong_only_trial"),
        F.coalesce(F.bool_and(F.when(match.isNotNull(), both_pass)), F.lit(True)).alias("all_compared_pass"),
        F.sum("written_diffs").alias("written_diffs"),
        F.sum("only_base").alias("missed_cells"),
        F.count_if(F.col("trial_cost").isNull()).alias("no_price"),
        *sums,
    )


def trial_bias(wrong_only_base: Column, wrong_only_trial: Column) -> Column:
    """lenient / strict when at least three quarters of three or more differences point one way."""
    total = wrong_only_base + wrong_only_trial
    return (
        F.when(total < 3, "balanced")
        .when(wrong_only_base >= total * 0.75, "lenient")
        .when(wrong_only_trial >= total * 0.75, "strict")
        .otherwise("balanced")
    )


def trial_ratios(summary: DataFrame, dims: list[str]) -> DataFrame:
    """Trial as percent of base; cost stays blank when no run has a price."""
    c = F.col
    blank = (c("no_price") == c("sheets")) & (c("sheets") > 0)
    return summary.select(
        *dims,
        pct(c("verdict_agree"), c("compared")).alias("verdict_pct"),
        pct(c("items_agree"), c("items_compared")).alias("item_pct"),
        F.when(blank, F.lit("—")).otherwise(pct(c("trial_cost"), c("base_cost"))).alias("cost_pct"),
        pct(c("trial_in"), c("base_in")).alias("input_pct"),
        pct(c("trial_out"), c("base_out")).alias("output_pct"),
        pct(c("trial_ms"), c("base_ms")).alias("time_pct"),
        "no_price",
        trial_bias(c("items_wrong_only_base"), c("items_wrong_only_trial")).alias("bias"),
    )


def stale_base(base_runs: DataFrame, settings: DataFrame) -> DataFrame:
    """Flag base runs graded under other settings than the live ones (a one-row table)."""
    live = settings.select(F.col("model").alias("_m"), F.col("effort").alias("_e")).limit(1)
    tagged = base_runs.withColumn("_one", F.lit(1)).join(F.broadcast(live.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
    stale = F.col("_m").isNotNull() & ((F.col("model") != F.col("_m")) | (F.col("effort") != F.col("_e")))
    return tagged.withColumn("stale", stale).drop("_m", "_e")


def run_variance(runs: DataFrame) -> DataFrame:
    """Repeated readings of one sheet. ``runs``: (sheet_id, run, no, written, seq); run 1 is the base.

    Per sheet and run: items read and cells that differ from run 1, absent cells included.
    """
    cells = runs.groupBy("sheet_id", "run", "no").agg(F.max_by("written", "seq").alias("_raw"), F.count("*").alias("rows"))
    cells = cells.withColumn("text", norm(F.col("_raw")))
    # a number has one cell a run, so its window is short; run 1 is not read a second time
    base = F.max(F.when(F.col("run") == 1, F.col("text"))).over(Window.partitionBy("sheet_id", "no"))
    present = cells.withColumn("base_text", F.when(F.col("sheet_id").isNotNull() & F.col("no").isNotNull(), base))
    seen = present.groupBy("sheet_id", "run").agg(
        F.sum("rows").alias("n_items"),
        F.count_if(~F.col("text").eqNullSafe(F.col("base_text"))).alias("_changed"),
        F.count("base_text").alias("_shared"),
        F.count("*").alias("_cells"),
    )
    size = F.max(F.when((F.col("run") == 1) & F.col("sheet_id").isNotNull(), F.col("_cells"))).over(Window.partitionBy("sheet_id"))
    return seen.withColumn("_base", size).select(
        "sheet_id", "run", "n_items",
        F.when(F.col("run") > 1, F.col("_changed") + F.coalesce("_base", F.lit(0)) - F.col("_shared")).alias("cells_changed"),
    )


def unstable_items(runs: DataFrame) -> DataFrame:
    """Numbers of run 1 that some run read differently; a run without the number reads as empty."""
    first = runs.groupBy("sheet_id", "run", "no").agg(F.min_by("written", "seq").alias("_raw"))
    first = first.withColumn("text", norm(F.col("_raw")))
    n_runs = runs.select("sheet_id", "run").distinct().groupBy("sheet_id").agg(F.count("*").alias("_runs"))
    per_no = first.groupBy("sheet_id", "no").agg(
        F.bool_or(F.col("run") == 1).alias("_base"), F.count("*").alias("_read"), F.min("text").alias("_lo"), F.max("text").alias("_hi")
    ).join(n_runs, "sheet_id")
    absent = F.col("_read") < F.col("_runs")
    varies = (F.col("_lo") != F.col("_hi")) | (absent & (F.col("_hi") != ""))
    return per_no.filter(F.col("_base") & varies).select("sheet_id", "no")
