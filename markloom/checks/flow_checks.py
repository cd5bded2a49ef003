"""Whole flows from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.checks.drift_checks import PAGED, PARTS
from markloom.checks.registry import query
from markloom.checks.verdict_checks import verdict_sql
from markloom.plans import grading

RESULTS = "(select sheet_id, no, seq as pos, correct, expected, note from fx_items where (sheet_id + seq) % 13 <> 0)"


@query("grade_flow", f"""with best as (select sheet_id, no from (select sheet_id, no, 1 + sheet_id % 2 as np, row_number() over (partition by sheet_id, no order by
      (case when blank then 0 else 1 end + case when legible then 1 else 0 end + case when trim(written) <> '' then 1 else 0 end) desc, confidence desc, page, pos) as rn from {PAGED} p) z where np = 1 or rn = 1),
  j as (select sheet_id, no, max_by(coalesce(correct, false), pos) as correct, max_by(note, pos) as note from {RESULTS} r group by 1, 2),
  g as (select b.sheet_id, b.no, coalesce(j.correct, false) as correct, contains(coalesce(j.note, ''), '정답모름') as held from best b left join j on j.sheet_id = b.sheet_id and j.no = b.no),
  h as (select sheet_id, case when count(*) > 1 then greatest(max(printed_total), 0) else greatest(max(printed_total), 0) end as printed_total,
    case when count(*) > 1 then coalesce(min_by(trim(cut_line), page) filter (where trim(cut_line) <> ''), '') else any_value(cut_line) end as cut_text from {PARTS} p group by 1),
  tl as (select sheet_id, count(*) as n_rows, count(*) filter (where held) as held_out, count(distinct no) filter (where not held) as n, count(distinct no) filter (where not held and not correct) as n_wrong from g group by 1),
  src as (select tl.sheet_id, n, n_wrong, cut_text, cast(case when printed_total > 0 then greatest(0, printed_total - n_rows) else 0 end + held_out as bigint) as missing from tl join h on h.sheet_id = tl.sheet_id),
  {verdict_sql('src')}
select sheet_id, n, n_wrong, missing, cut, verdict, near_boundary, margin from decided""")
def _(t):
    t.keep("items", "sheet_id", "seq", "no", "prompt", "prefix", "written", "blank", "legible", "confidence", "correct", "expected", "note")
    rows = t.sql(f"select * from {PAGED} p").withColumn("prompt", F.lit("")).withColumn("direction", F.lit("other"))
    graded = grading.grade(t.sql(f"select * from {PARTS} p"), rows, t.sql(f"select * from {RESULTS} r"))
    return graded.verdicts.select("sheet_id", "n", "n_wrong", "missing", "cut", "verdict", "near_boundary", "margin")
