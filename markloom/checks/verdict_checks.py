"""Verdicts, item projections and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.checks.registry import query
from markloom.functions import text as T
from markloom.functions import verdicts as V
from markloom.operators import verdict as ops

CUT = r"""case when {n} > 0 then case when regexp_extract({t}, '-\s*(\d+(?:\.\d+)?)\s*(%|퍼센트)?', 1) = '' then null
  when regexp_extract({t}, '-\s*(\d+(?:\.\d+)?)\s*(%|퍼센트)?', 2) <> ''
    then cast(floor({n} * cast(regexp_extract({t}, '-\s*(\d+(?:\.\d+)?)\s*(%|퍼센트)?', 1) as double) / 100) as bigint)
  else cast(floor(cast(regexp_extract({t}, '-\s*(\d+(?:\.\d+)?)\s*(%|퍼센트)?', 1) as double)) as bigint) end end"""


def cut_sql(text: str, n: str) -> str:
    return CUT.format(t=f"coalesce({text}, '')", n=n)


def verdict_sql(source: str, extra: str = "") -> str:
    """source: (sheet_id, n, n_wrong, missing, cut_text, ...)"""
    return f"""
  cutted as (select *, {cut_sql('cut_text', '(n + missing)')} as cut from {source}),
  plain as (select *, case when cut is null then null when n_wrong <= cut then 'pass' else 'fail' end as p,
     case when cut is null then null when n_wrong + missing <= cut then 'pass' else 'fail' end as worst_verdict from cutted),
  judged as (select *, missing = 0 or coalesce(p = worst_verdict, false) as robust from plain),
  decided as (select *, case when robust then p end as verdict,
     robust and coalesce(abs(n_wrong - cut) <= 2, false) as near_boundary, n_wrong - cut as margin from judged){extra}"""


SHEET_VERDICT = f"""with t as (
  select sheet_id, count(*) as n_rows, count(*) filter (where held) as held_out,
    count(distinct no) filter (where not held) as n, count(distinct no) filter (where not held and wrong) as n_wrong
  from (select sheet_id, no, contains(note, '정답모름') as held, not coalesce(correct, false) as wrong from fx_items) i group by 1),
  src as (select t.sheet_id, n, n_wrong, cut_line as cut_text,
    cast(case when printed_total > 0 then greatest(0, printed_total - n_rows) else 0 end + held_out as bigint) as missing
    from t join fx_sheets s on s.sheet_id = t.sheet_id),
  {verdict_sql('src')}
select sheet_id, n, n_wrong, missing, cut, verdict, worst_verdict, robust, near_boundary, margin from decided"""


@query("sheet_verdict", SHEET_VERDICT)
def _(t):
    return ops.sheet_verdict(t.items, t.sheets)


@query("recount_verdict", f"""with t as (
  select sheet_id, count(*) filter (where held) as held_out,
    count(distinct no) filter (where not held) as n, count(distinct no) filter (where not held and wrong) as n_wrong
  from (select sheet_id, no, contains(note, '정답모름') and coalesce(teacher_correct, correct) is null as held,
    not coalesce(teacher_correct, correct, false) as wrong from fx_items) i group by 1),
  src as (select t.sheet_id, n, n_wrong, coalesce(cut_line, transcript_cut) as cut_text, cast(missing + held_out as bigint) as missing
    from t join fx_sheets s on s.sheet_id = t.sheet_id),
  {verdict_sql('src')}
select sheet_id, n, n_wrong, missing, cut, verdict, robust, near_boundary, margin from decided""")
def _(t):
    return ops.recount_verdict(t.items, t.sheets)


@query("final_correct", """select sheet_id, seq, coalesce(teacher_correct, correct) as final_correct,
  teacher_correct is not null and teacher_correct is distinct from correct as overturned from fx_items""")
def _(t):
    return ops.with_final(t.items).select("sheet_id", "seq", "final_correct", "overturned")


@query("judge_results_from_items", """select sheet_id, no, coalesce(teacher_correct, correct, false) as correct, expected, note from fx_items""")
def _(t):
    return ops.judge_results(t.items)


@query("keep_name", """select sheet_id, coalesce(nullif(trim(case when sheet_id % 3 = 0 then '  ' else student_name end), ''),
  trim(concat(' ', class_name, ' '))) as name from fx_sheets""")
def _(t):
    existing = F.when(F.col("sheet_id") % 3 == 0, F.lit("  ")).otherwise(F.col("student_name"))
    return t.sheets.select("sheet_id", V.keep_name(existing, F.concat(F.lit(" "), "class_name", F.lit(" "))).alias("name"))


@query("needs_review", """select sheet_id, title from fx_sheets where status = 'graded'
  and (near_boundary or verdict is null or coalesce(warn_level = 'drift', false))""")
def _(t):
    return ops.sheets_needing_review(t.sheets_full).select("sheet_id", "title")


@query("has_drift_is_incomplete", """select sheet_id, coalesce(warn_level = 'drift', false) as has_drift,
  coalesce(warn_level = 'incomplete', false) as is_incomplete from fx_sheets""")
def _(t):
    w = F.col("warnings")
    return t.sheets_full.select("sheet_id", V.has_level(w, "drift").alias("has_drift"), V.has_level(w, "incomplete").alias("is_incomplete"))


@query("missing_count", """select s.sheet_id, cast(case when printed_total > 0 then greatest(0, printed_total - n) else 0 end as bigint) as missing
  from fx_sheets s join (select sheet_id, count(*) as n from fx_items group by 1) i on i.sheet_id = s.sheet_id""")
def _(t):
    read = t.items.groupBy("sheet_id").agg(F.count("*").alias("n"))
    return t.sheets.join(read, "sheet_id").select("sheet_id", V.missing_count(F.col("printed_total"), F.col("n")).alias("missing"))


@query("unjudged_flag", """select sheet_id, seq, contains(note, '정답모름') as unjudged from fx_items""")
def _(t):
    return t.items.select("sheet_id", "seq", V.is_unjudged(F.col("note")).alias("unjudged"))


@query("open_flag", """select sheet_id, seq, contains(note, '정답모름') and coalesce(teacher_correct, correct) is null as is_open from fx_items""")
def _(t):
    final = V.final_correct(F.col("teacher_correct"), F.col("correct"))
    return t.items.select("sheet_id", "seq", V.is_open(F.col("note"), final).alias("is_open"))


@query("split_unjudged", """select sheet_id, count(*) filter (where contains(note, '정답모름')) as unjudged,
  count(*) filter (where not contains(note, '정답모름')) as judged from fx_items group by 1""")
def _(t):
    return ops.split_unjudged(t.items)[1]


@query("short_answer_suspects", """select sheet_id, seq, written, concat(expected, ' of the ', prompt) as expected from fx_items
  where coalesce(teacher_correct, correct) and
    len(list_filter(regexp_split_to_array(written, '\\s+'), lambda w: regexp_matches(w, '[a-zA-Z0-9제안]')))
      < 0.6e0 * len(list_filter(regexp_split_to_array(concat(expected, ' of the ', prompt), '\\s+'), lambda w: regexp_matches(w, '[a-zA-Z0-9]')))""")
def _(t):
    longer = t.items.withColumn("expected", F.concat("expected", F.lit(" of the "), "prompt"))
    return ops.short_answer_suspects(longer).select("sheet_id", "seq", "written", "expected")


@query("review_stats", """select sheet_id,
  count(*) filter (where not is_open and fc = false) as wrong, count(*) filter (where is_open) as open,
  count(*) filter (where teacher_correct is not null and teacher_correct is distinct from correct) as overturned,
  count(teacher_correct) as reviewed
  from (select *, coalesce(teacher_correct, correct) as fc,
    contains(note, '정답모름') and coalesce(teacher_correct, correct) is null as is_open from fx_items) i group by 1""")
def _(t):
    return ops.review_stats(t.items)


@query("overturn_rate", """select direction, note, count(teacher_correct) as reviewed,
  count(*) filter (where teacher_correct is not null and teacher_correct is distinct from correct) as overturned,
  round(count(*) filter (where teacher_correct is not null and teacher_correct is distinct from correct) / nullif(count(teacher_correct), 0)::double, 6) as rate
  from fx_items group by cube (direction, note)""")
def _(t):
    return ops.overturn_rate(t.items, ["direction", "note"]).withColumn("rate", F.round("rate", 6))


@query("progress_summary", """select cast(created_at as date) as received_on, count(*) as total,
  count(*) filter (where status in ('queued', 'running')) as pending, count(*) filter (where status = 'graded') as graded,
  count(*) filter (where status = 'confirmed') as confirmed, count(*) filter (where status = 'failed') as failed,
  count(*) filter (where status = 'graded' and (near_boundary or verdict is null or coalesce(warn_level = 'drift', false))) as needs_review,
  cast(coalesce(sum(cost_usd), 0) as double) as cost_usd from fx_sheets group by 1""")
def _(t):
    df = t.sheets_full.withColumn("received_on", F.to_date("created_at"))
    return ops.progress_summary(df, ["received_on"]).withColumn("cost_usd", F.col("cost_usd").cast("double"))


WRONG = """select i.sheet_id, cast(created_at as date) as received_on, class_name, student_name, title, seq, no, prompt, written, expected, note,
  teacher_correct is not null and teacher_correct is distinct from correct as overturned
  from fx_items i join fx_sheets s on s.sheet_id = i.sheet_id where coalesce(teacher_correct, correct) = false"""


@query("wrong_items", WRONG)
def _(t):
    return ops.wrong_items(t.items, t.sheets)


@query("confirmed_wrong_items", WRONG + " and status = 'confirmed'")
def _(t):
    return ops.wrong_items(t.items, t.sheets, confirmed_only=True)


@query("parse_cut", f"""select sheet_id, {cut_sql('cut_line', 'sheet_id % 60')} as cut from fx_sheets""")
def _(t):
    return t.sheets.select("sheet_id", V.parse_cut(F.col("cut_line"), F.col("sheet_id") % 60).alias("cut"))


@query("verdict", f"""select sheet_id, case when cut is null then null when sheet_id % 9 <= cut then 'pass' else 'fail' end as verdict
  from (select sheet_id, {cut_sql('cut_line', 'sheet_id % 60')} as cut from fx_sheets) s""")
def _(t):
    cut = V.parse_cut(F.col("cut_line"), F.col("sheet_id") % 60)
    return t.sheets.select("sheet_id", V.verdict(F.col("sheet_id") % 9, cut).alias("verdict"))


@query("wilson_lower_bound", """select title, k, n, round((k / n + 3.841458820694124 / (2 * n)
    - 1.959963984540054 * sqrt((k / n * (1 - k / n) + 3.841458820694124 / (4 * n)) / n)) / (1 + 3.841458820694124 / n), 4) as lower_bound
  from (select title, count(*)::double as n, (count(*) filter (where verdict = 'pass'))::double as k from fx_sheets group by 1) s""")
def _(t):
    g = t.sheets.groupBy("title").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("verdict") == "pass").cast("double").alias("k"))
    return g.withColumn("lower_bound", F.round(V.wilson_lower(F.col("k"), F.col("n")), 4))


NORM_SQL = r"regexp_replace(lower(trim({})), '[\s]+', ' ', 'g')"


@query("norm", f"""select sheet_id, seq, {NORM_SQL.format("concat('  ', upper(prompt), '   ', written, ' ')")} as normed from fx_items""")
def _(t):
    raw = F.concat(F.lit("  "), F.upper("prompt"), F.lit("   "), "written", F.lit(" "))
    return t.items.select("sheet_id", "seq", T.norm(raw).alias("normed"))


@query("has_hangul", """select sheet_id, seq, regexp_matches(written, '[가-힣]') as hangul from fx_items""")
def _(t):
    return t.items.select("sheet_id", "seq", T.has_hangul(F.col("written")).alias("hangul"))


NUMKEY_SQL = "coalesce(try_cast(nullif(regexp_extract({0}, '^\\s*(\\d+)', 1), '') as bigint), 9007199254740991)"


@query("num_key", f"""select sheet_id, seq, {NUMKEY_SQL.format("concat(' ', written, no, ')')")} as k1, {NUMKEY_SQL.format("concat(' ', no, ') x')")} as k2 from fx_items""")
def _(t):
    k1 = T.num_key(F.concat(F.lit(" "), "written", "no", F.lit(")")))
    k2 = T.num_key(F.concat(F.lit(" "), "no", F.lit(") x")))
    return t.items.select("sheet_id", "seq", k1.alias("k1"), k2.alias("k2"))


@query("prefix_mismatch", """select sheet_id, seq from fx_items where trim(prefix) <> '' and trim(written) <> ''
  and not starts_with(lower(trim(written)), lower(trim(prefix)))""")
def _(t):
    return t.items.filter(T.prefix_mismatch(F.col("prefix"), F.col("written"))).select("sheet_id", "seq")


@query("language_mismatch", """select sheet_id, seq, case when direction = 'ko2en' then '한글' else '영문' end as language from fx_items
  where length(trim(written)) >= 2 and ((direction = 'ko2en' and regexp_matches(written, '[가-힣]'))
    or (direction = 'en2ko' and not regexp_matches(written, '[가-힣]')))""")
def _(t):
    lang = T.language_mismatch(F.col("direction"), F.col("written"))
    return t.items.select("sheet_id", "seq", lang.alias("language")).filter("language is not null")


@query("word_count", """select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}'']')))::bigint as words from documents""")
def _(t):
    return t.documents.select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("item_seq", """select sheet_id, seq, no from fx_items""")
def _(t):
    return t.items.select("sheet_id", "seq", "no")


@query("natural_number_order", f"""select class_name, {NUMKEY_SQL.format("no")} as num_key, no,
  row_number() over (partition by class_name order by {NUMKEY_SQL.format("no")}, no) as ord
  from (select distinct class_name, concat(cast(sheet_id % 130 as varchar), case when sheet_id % 3 = 0 then ')' when sheet_id % 3 = 1 then '-A' else '' end) as no from fx_sheets) s""")
def _(t):
    suffix = F.when(F.col("sheet_id") % 3 == 0, ")").when(F.col("sheet_id") % 3 == 1, "-A").otherwise("")
    d = t.sheets.select("class_name", F.concat((F.col("sheet_id") % 130).cast("string"), suffix).alias("no")).distinct()
    from markloom.operators.pages import natural_order

    return natural_order(d, ["class_name"])
