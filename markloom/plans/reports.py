"""Report flows: model comparison, usage and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.operators import costs, trials, usage


def compare_models(
    items: DataFrame, sheets: DataFrame, calls: DataFrame, trial_runs: DataFrame, trial_items: DataFrame, default_model: str
) -> DataFrame:
    """Summary per condition of the newest finished run of every sheet.

    ``trial_runs``: (trial_id, sheet_id, model, effort, variant, edge, verdict, cost_usd, latency_ms, input_tokens,
    output_tokens, error, created_at); ``trial_items``: (trial_id, sheet_id, seq, no, written, correct).
    """
    names = {"cost_usd": "cost", "latency_ms": "ms", "input_tokens": "in", "output_tokens": "out"}
    base = trials.bench_base_runs(items, sheets, calls, default_model)
    runs = trials.latest_trial(trial_runs).filter("error is null")
    left = base.select("sheet_id", "n", "verdict", "near_boundary", "margin", *[F.col(c).alias(f"base_{n}") for c, n in names.items()])
    right = runs.select("trial_id", "sheet_id", "verdict", *trials.CONDITION, *[F.col(c).alias(f"trial_{n}") for c, n in names.items()])
    return trials.trial_summary(trials.runs_diff(items, trial_items, left, right), [*trials.CONDITION])


def usage_report(events: DataFrame, hours: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per person, per hour, totals)."""
    people = usage.usage_by_staff(events, hours)
    return people, usage.usage_by_hour(events, hours), usage.usage_totals(people)


def cost_report(calls: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(breakdown, projection, levers)."""
    m = costs.measured(costs.token_stage_split(calls), items.agg(F.count("*").alias("items")))
    return costs.cost_breakdown(m), costs.cost_projection(m), costs.cost_levers(m)
