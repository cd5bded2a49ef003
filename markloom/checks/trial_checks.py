"""Model comparison and teacher agreement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.checks.registry import query
from markloom.checks.verdict_checks import verdict_sql
from markloom.operators import agreement as A
from markloom.operators import trials as T
from markloom.plans.reports import compare_models

LATEST = """latest as (select * from (select *, row_number() over (partition by sheet_id, model, effort, variant, edge order by created_at desc, trial_id desc) as rn
  from (select * replace (coalesce(variant, 'full') as variant) from fx_trial_runs) v) z where rn = 1)"""


@query("latest_trial", f"with {LATEST} select trial_id, sheet_id, model, effort, variant, edge from latest")
def _(t):
    return T.latest_trial(t.trial_runs).select("trial_id", "sheet_id", "model", "effort", "variant", "edge")


ONE = "model = 'claude-opus-5' and effort = 'high'"


@query("untried_failed_sheets", f"""with {LATEST}, one as (select * from latest where {ONE})
  select 'untried' as what, null as error, count(*) as n from fx_sheets where sheet_id not in (select sheet_id from one)
  union all select 'failed', error, count(*) from one where error is not null group by error""")
def _(t):
    one = T.latest_trial(t.trial_runs).filter(ONE)
    untried = T.untried_sheets(t.sheets, one).agg(F.count("*").alias("n")).select(F.lit("untried").alias("what"), F.lit(None).cast("string").alias("error"), "n")
    return untried.unionByName(T.failed_reasons(one).select(F.lit("failed").alias("what"), "error", "n"))


def side_sql(name: str, items: str) -> str:
    return f"""{name}_t as (select sheet_id, count(distinct no) as n, count(distinct no) filter (where not coalesce(correct, false)) as n_wrong from {items} group by 1),
  {name}_s as (select t.sheet_id, n, n_wrong, coalesce(cut_line, transcript_cut) as cut_text, cast(missing as bigint) as missing from {name}_t t join fx_sheets s on s.sheet_id = t.sheet_id),
  """ + verdict_sql(f"{name}_s").replace("cutted", f"{name}_c").replace("plain", f"{name}_p").replace("judged", f"{name}_j").replace("decided", f"{name}_d")


BASE = f"""{side_sql('b', 'fx_items')},
  calls as (select sheet_id, sum(latency_ms) as ms, sum(input_tokens + cache_read + cache_write) as it, sum(output_tokens) as ot,
    min_by(model, pos) as model, any_value(effort) as effort from fx_calls group by 1),
  base as (select d.sheet_id, d.n, d.n_wrong, d.cut, d.verdict, d.near_boundary, d.margin, coalesce(s.cost_usd, 0) as cost_usd, cast(coalesce(ms, 0) as bigint) as latency_ms,
    cast(coalesce(it, 0) as bigint) as input_tokens, cast(coalesce(ot, 0) as bigint) as output_tokens, coalesce(c.model, 'claude-opus-5') as model, coalesce(c.effort, 'none') as effort
    from b_d d join fx_sheets s on s.sheet_id = d.sheet_id left join calls c on c.sheet_id = d.sheet_id)"""


def base(t):
    return T.bench_base_runs(t.items, t.sheets, t.calls, "claude-opus-5")


@query("bench_base_runs", f"with {BASE} select * replace (cast(cost_usd as double) as cost_usd) from base")
def _(t):
    return base(t).withColumn("cost_usd", F.col("cost_usd").cast("double"))


READING = ("sheet_id", "seq", "no", "written")  # what every reading of an item has
DIFF = r"""di as (select coalesce(b.sheet_id, t.sheet_id) as sheet_id, coalesce(b.no, t.no) as no, b.no is not null as in_base, t.no is not null as in_trial, bw as base_written, tw as trial_written,
    b.no is not null and t.no is not null and regexp_replace(lower(trim(bw)), '\s+', ' ', 'g') <> regexp_replace(lower(trim(tw)), '\s+', ' ', 'g') as written_differs,
    b.no is not null and t.no is not null as judged, coalesce(bx and not tx, false) as wrong_only_base, coalesce(tx and not bx, false) as wrong_only_trial
  from (select sheet_id, no, max_by(written, seq) as bw, bool_or(not coalesce(correct, false)) as bx from fx_items group by 1, 2) b
  full outer join (select sheet_id, no, max_by(written, seq) as tw, bool_or(not coalesce(correct, false)) as tx from fx_trials group by 1, 2) t
    on t.sheet_id = b.sheet_id and t.no = b.no)"""


@query("run_diff_items", f"with {DIFF} select * from di")
def _(t):
    return T.run_diff_items(t.items, t.trials)


@query("only_base_only_trial", f"with {DIFF} select sheet_id, no, in_base from di where in_base <> in_trial")
def _(t):
    return T.run_diff_items(t.items, t.trials).filter("in_base <> in_trial").select("sheet_id", "no", "in_base")


SHEET_DIFF = f"""{BASE}, {side_sql('t', 'fx_trials')}, {DIFF},
  cnt as (select sheet_id, count(*) filter (where in_base) as base_read, count(*) filter (where in_trial) as trial_read, count(*) filter (where in_base and not in_trial) as only_base,
    count(*) filter (where in_trial and not in_base) as only_trial, count(*) filter (where written_differs) as written_diffs, count(*) filter (where judged) as n,
    count(*) filter (where wrong_only_base) as wrong_only_base, count(*) filter (where wrong_only_trial) as wrong_only_trial from di group by 1),
  sd as (select cnt.*, b.verdict as base_verdict, b.near_boundary as base_near, b.margin as base_margin, x.verdict as trial_verdict,
    cnt.n - wrong_only_base - wrong_only_trial as agree, b.verdict = x.verdict as verdict_match from cnt join base b on b.sheet_id = cnt.sheet_id join t_d x on x.sheet_id = cnt.sheet_id)"""


def diffs(t):
    t.keep("items", *READING, "correct", "note")
    b = base(t)
    return b, T.sheet_run_diff(T.run_diff_items(t.items, t.trials), b, T.system_verdicts(t.trials, t.sheets))


@query("sheet_run_diff", f"with {SHEET_DIFF} select * from sd")
def _(t):
    return diffs(t)[1]


# every run has its own readings and verdict
TRIAL_ITEMS = "(select r.trial_id, t.* from fx_trials t join fx_trial_runs r on r.sheet_id = t.sheet_id where (t.seq + r.trial_id) % 11 <> 0)"
TRIAL_VERDICT = "case trial_id % 5 when 0 then null when 1 then 'fail' else 'pass' end"
TEXT = r"regexp_replace(lower(trim({})), '\s+', ' ', 'g')"
SUMMARY = f"""{BASE}, {LATEST}, ok as (select *, {TRIAL_VERDICT} as verdict from latest where error is null),
  bi as (select ok.trial_id, i.sheet_id, no, max_by(written, seq) as bw, bool_or(not coalesce(correct, false)) as bx from fx_items i join ok on ok.sheet_id = i.sheet_id group by 1, 2, 3),
  ti as (select ok.trial_id, ok.sheet_id, no, max_by(written, seq) as tw, bool_or(not coalesce(correct, false)) as tx from {TRIAL_ITEMS} t join ok on ok.trial_id = t.trial_id group by 1, 2, 3),
  di as (select coalesce(b.trial_id, t.trial_id) as trial_id, coalesce(b.sheet_id, t.sheet_id) as sheet_id, b.no is not null as in_base, t.no is not null as in_trial,
    {TEXT.format("bw")} <> {TEXT.format("tw")} as differs, coalesce(bx and not tx, false) as wb, coalesce(tx and not bx, false) as wt from bi b full outer join ti t on t.trial_id = b.trial_id and t.no = b.no),
  cnt as (select trial_id, sheet_id, count(*) filter (where in_base and not in_trial) as only_base, count(*) filter (where differs) as written_diffs, count(*) filter (where in_base and in_trial) as n,
    count(*) filter (where wb) as wrong_only_base, count(*) filter (where wt) as wrong_only_trial from di group by 1, 2),
  pr as (select c.*, c.n - wrong_only_base - wrong_only_trial as agree, b.verdict as base_verdict, b.near_boundary as base_near, l.verdict as trial_verdict, b.verdict = l.verdict as verdict_match,
    l.model, l.effort, l.variant, l.edge, b.cost_usd as base_cost, l.cost_usd as trial_cost, b.latency_ms as base_ms, l.latency_ms as trial_ms, b.input_tokens as base_in, l.input_tokens as trial_in,
    b.output_tokens as base_out, l.output_tokens as trial_out from cnt c join base b on b.sheet_id = c.sheet_id join ok l on l.trial_id = c.trial_id),
  sm as (select model, effort, variant, edge, count(*) as sheets, count(verdict_match) as compared, count(*) filter (where verdict_match) as verdict_agree, count(*) filter (where not verdict_match) as flipped,
    count(*) filter (where not verdict_match and base_near) as flipped_at_boundary, count(*) filter (where not verdict_match and not base_near) as flipped_with_margin,
    count(*) filter (where verdict_match is null and base_verdict is not null) as trial_undecided, count(*) filter (where base_verdict is null) as incomparable,
    cast(sum(n) as bigint) as items_compared, cast(sum(agree) as bigint) as items_agree, cast(sum(wrong_only_base) as bigint) as items_wrong_only_base, cast(sum(wrong_only_trial) as bigint) as items_wrong_only_trial,
    coalesce(bool_and(base_verdict = 'pass' and trial_verdict = 'pass') filter (where verdict_match is not null), true) as all_compared_pass,
    cast(sum(written_diffs) as bigint) as written_diffs, cast(sum(only_base) as bigint) as missed_cells, count(*) filter (where trial_cost is null) as no_price,
    cast(coalesce(sum(base_cost), 0) as double) as base_cost, cast(coalesce(sum(trial_cost), 0) as double) as trial_cost, cast(sum(base_ms) as bigint) as base_ms, cast(sum(trial_ms) as bigint) as trial_ms,
    cast(sum(base_in) as bigint) as base_in, cast(sum(trial_in) as bigint) as trial_in, cast(sum(base_out) as bigint) as base_out, cast(sum(trial_out) as bigint) as trial_out from pr group by 1, 2, 3, 4)"""


DIMS = [*T.CONDITION]


def summary(t):
    t.keep("items", *READING, "correct", "note")
    runs = t.trial_runs.withColumn("verdict", F.expr(TRIAL_VERDICT))
    out = compare_models(t.items, t.sheets, t.calls, runs, t.sql(f"select * from {TRIAL_ITEMS} i"), "claude-opus-5")
    return out.withColumn("base_cost", F.col("base_cost").cast("double")).withColumn("trial_cost", F.col("trial_cost").cast("double"))


@query("trial_summary", f"with {SUMMARY} select * from sm")
def _(t):
    return summary(t)


BIAS = """case when items_wrong_only_base + items_wrong_only_trial < 3 then 'balanced' when items_wrong_only_base >= (items_wrong_only_base + items_wrong_only_trial) * 0.75e0 then 'lenient'
  when items_wrong_only_trial >= (items_wrong_only_base + items_wrong_only_trial) * 0.75e0 then 'strict' else 'balanced' end as bias"""


@query("trial_bias", f"with {SUMMARY} select model, effort, variant, edge, {BIAS} from sm")
def _(t):
    return summary(t).select(*DIMS, T.trial_bias(F.col("items_wrong_only_base"), F.col("items_wrong_only_trial")).alias("bias"))


def _pct(a: str, b: str) -> str:
    return f"case when coalesce({b}, 0) <> 0 then printf('%.1f%%', cast({a} as double) / {b} * 100) else '—' end"


@query("trial_ratios", f"""with {SUMMARY} select model, effort, variant, edge, {_pct('verdict_agree', 'compared')} as verdict_pct, {_pct('items_agree', 'items_compared')} as item_pct,
  case when no_price = sheets then '—' else {_pct('trial_cost', 'base_cost')} end as cost_pct, {_pct('trial_in', 'base_in')} as input_pct, {_pct('trial_out', 'base_out')} as output_pct,
  {_pct('trial_ms', 'base_ms')} as time_pct, no_price, {BIAS} from sm""")
def _(t):
    return T.trial_ratios(summary(t), DIMS)


@query("stale_base_flag", f"""with {BASE} select sheet_id, model <> 'claude-opus-5' or effort <> 'none' as stale from base""")
def _(t):
    live = t.spark.range(1).select(F.lit("claude-opus-5").alias("model"), F.lit("none").alias("effort"))
    return T.stale_base(base(t), live).select("sheet_id", "stale")


RUNS = """(select sheet_id, 1 as run, no, written, seq from fx_items union all select sheet_id, 2 as run, no, written, seq from fx_trials
  union all select sheet_id, 3 as run, no, case when seq % 4 = 1 then upper(written) else written end as written, seq from fx_items where seq % 6 <> 5)"""
CELLS = f"""c as (select sheet_id, run, no, lower(trim(max_by(written, seq))) as x, lower(trim(min_by(written, seq))) as f, count(*) as r from {RUNS} u group by 1, 2, 3)"""


@query("run_variance", f"""with {CELLS}, sr as (select sheet_id, run, cast(sum(r) as bigint) as n_items from c group by 1, 2),
  al as (select s.sheet_id, s.run, n.no from sr s join (select distinct sheet_id, no, run as nr from c) n on n.sheet_id = s.sheet_id and (nr = 1 or nr = s.run) group by 1, 2, 3),
  df as (select a.sheet_id, a.run, count(*) filter (where x.x is distinct from b.x) as d from al a left join c x on x.sheet_id = a.sheet_id and x.run = a.run and x.no = a.no
    left join c b on b.sheet_id = a.sheet_id and b.run = 1 and b.no = a.no group by 1, 2)
  select s.sheet_id, s.run, n_items, case when s.run > 1 then d end as cells_changed from sr s join df on df.sheet_id = s.sheet_id and df.run = s.run""")
def _(t):
    t.keep("items", *READING, "correct", "note")
    return T.run_variance(t.sql(f"select * from {RUNS} u"))


@query("unstable_items", f"""with {CELLS}, sr as (select distinct sheet_id, run from c), b as (select sheet_id, no from c where run = 1)
  select b.sheet_id, b.no from b join sr on sr.sheet_id = b.sheet_id left join c on c.sheet_id = b.sheet_id and c.run = sr.run and c.no = b.no
  group by 1, 2 having count(distinct coalesce(f, '')) > 1""")
def _(t):
    t.keep("items", *READING, "correct", "note")
    return T.unstable_items(t.sql(f"select * from {RUNS} u"))


MARKED = """mi as (select coalesce(i.sheet_id, m.sheet_id) as sheet_id, coalesce(i.no, m.no) as no, i.no is not null as known, coalesce(w, false) as ours, m.no is not null as theirs
  from (select sheet_id, no, bool_or(not coalesce(correct, false)) as w from fx_items group by 1, 2) i
  full outer join (select distinct sheet_id, trim(mark_no) as no from fx_marks where trim(mark_no) <> '') m on m.sheet_id = i.sheet_id and m.no = i.no)"""
TEACH_SHEETS = """(select sheet_id, cut_line as cut_text, cast(missing as bigint) as missing, case when sheet_id % 2 = 0 then final_verdict else 'unmarked' end as pass_fail from fx_sheets)"""
TEACHER = f"""{MARKED}, tl as (select sheet_id, count(*) filter (where known) as n, count(*) filter (where ours) as n_wrong, count(*) filter (where known and theirs) as n_marked,
    count(*) filter (where ours and not theirs) as ours_only, count(*) filter (where known and theirs and not ours) as theirs_only, count(*) filter (where not known) as unmatched from mi group by 1),
  ts as (select tl.*, s.cut_text, s.missing, s.pass_fail from tl join {TEACH_SHEETS} s on s.sheet_id = tl.sheet_id), {verdict_sql('ts')},
  tv as (select *, case when robust then coalesce(case when pass_fail in ('pass', 'fail') then pass_fail end, case when cut is null then null when n_marked <= cut then 'pass' else 'fail' end) end as teacher_verdict from decided),
  tc as (select sheet_id, n, n_wrong, n_marked, ours_only, theirs_only, unmatched, n - ours_only - theirs_only as agree, missing, cut, verdict, teacher_verdict,
    verdict = teacher_verdict as verdict_match, near_boundary, margin from tv)"""


def compared(t):
    t.keep("items", "sheet_id", "no", "correct")
    return A.teacher_mark_compare(t.items, t.marks, t.sql(f"select * from {TEACH_SHEETS} s"))


@query("teacher_mark_compare", f"with {TEACHER} select * from tc")
def _(t):
    return compared(t)


@query("unmatched_marks", f"with {MARKED} select sheet_id, no from mi where not known")
def _(t):
    return A.unmatched_marks(t.items, t.marks)


@query("symmetric_difference", f"with {MARKED} select sheet_id, no, case when ours then 'ours' else 'theirs' end as side from mi where known and ours <> theirs")
def _(t):
    return A.symmetric_difference(t.items, t.marks)


FLAGS = """(select sheet_id, coalesce(warn_level = 'drift', false) as has_drift, cost_usd, case when sheet_id % 101 = 0 then 'bad image' end as error from fx_sheets)"""
TOTALS = f"""{TEACHER}, cf as (select tc.*, has_drift, cost_usd, error, error is null and unmatched = 0 as used from tc join {FLAGS} f on f.sheet_id = tc.sheet_id),
  tt as (select count(*) as runs, count(*) filter (where error is null and unmatched > 0) as excluded, cast(coalesce(sum(n) filter (where used), 0) as bigint) as n,
    cast(coalesce(sum(agree) filter (where used), 0) as bigint) as agree, cast(coalesce(sum(theirs_only) filter (where used), 0) as bigint) as theirs_only,
    cast(coalesce(sum(ours_only) filter (where used), 0) as bigint) as ours_only, count(*) filter (where used and has_drift) as drifted, count(*) filter (where used and verdict_match is not null) as verdicts,
    count(*) filter (where used and verdict_match) as verdicts_matched, count(*) filter (where used and near_boundary) as near, cast(coalesce(sum(cost_usd) filter (where error is null), 0) as double) as cost_usd from cf)"""


def totals(t):
    return A.agreement_totals(compared(t).join(t.sql(f"select * from {FLAGS} f"), "sheet_id"))


@query("teacher_agreement_report", f"with {TOTALS} select * from tt")
def _(t):
    return totals(t).withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query("phase_gate", f"""with {TOTALS} select 'verdict_match' as criterion, round(verdicts_matched::double / nullif(verdicts, 0), 6) as value, coalesce(verdicts_matched::double / nullif(verdicts, 0) >= 0.97, false) as ok from tt
  union all select 'review_rate', round(near::double / runs, 6), near <= runs * 0.25 from tt union all select 'missed_wrong', round(theirs_only::double / n, 6), theirs_only::double / n <= 0.03 from tt
  union all select 'drift_sheets', drifted::double, drifted = 0 from tt""")
def _(t):
    return A.phase_gate(totals(t)).withColumn("value", F.round("value", 6))


@query("small_sheet_note", f"with {TEACHER} select sheet_id, n, round(100.0e0 / n, 6) as points from tc where n < 25 and n > 0 and unmatched = 0")
def _(t):
    return A.small_sheet_note(compared(t)).withColumn("points", F.round("points", 6))


CASES = """(select p_partkey as case_no, case when p_size % 3 = 0 then null else p_size % 2 = 0 end as want_lax, p_size % 5 <> 0 as want_strict from part)"""
GOT = """(select p_partkey as case_no, k = 1 as strict, p_partkey % 7 <> k as correct from part cross join (select 0 as k union all select 1 as k) r where p_partkey % 50 <> 0)"""


@query("rubric_regression", f"""with w as (select case_no, false as strict, want_lax as want from {CASES} c union all select case_no, true, want_strict from {CASES} c)
  select w.case_no, w.strict, want, g.correct as actual, want is null or coalesce(want = g.correct, false) as ok from w left join {GOT} g on g.case_no = w.case_no and g.strict = w.strict""")
def _(t):
    return A.rubric_regression(t.sql(f"select * from {CASES} c"), t.sql(f"select * from {GOT} g"))


READ = """(select sheet_id, case seq % 2 when 0 then 'baseline' else 'spell' end as strategy, 1 as run, no, written, seq from fx_trials)"""
TRUTH = """(select distinct sheet_id, no, prompt as truth from (select *, row_number() over (partition by sheet_id, no order by seq) as rn from fx_items) z where rn = 1)"""


@query("reading_preservation", f"""with r as (select distinct sheet_id, strategy, run from {READ} a), g as (select sheet_id, strategy, run, no, max_by(written, seq) as w from {READ} a group by 1, 2, 3, 4)
  select r.strategy, count(*) filter (where coalesce(lower(trim(g.w)) = lower(trim(t.truth)), false)) as kept, count(*) as total
  from r join {TRUTH} t on t.sheet_id = r.sheet_id left join g on g.sheet_id = r.sheet_id and g.strategy = r.strategy and g.run = r.run and g.no = t.no group by 1""")
def _(t):
    from markloom.operators.sequences import first_rows

    t.keep("items", *READING, "prompt", "correct", "note")
    truth = first_rows(t.items, ["sheet_id", "no"], [F.col("seq")]).select("sheet_id", "no", F.col("prompt").alias("truth"))
    return A.reading_preservation(truth, t.sql(f"select * from {READ} a"))
