"""Drift, page merging and reference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.checks.registry import query
from markloom.checks.verdict_checks import NUMKEY_SQL
from markloom.operators import drift as D
from markloom.operators import pages as P
from markloom.operators import reference as R
from markloom.session import written

# the same items with longer, broken and unnumbered sequences
GAPPED = """(select sheet_id, seq, case when seq % 5 = 4 and sheet_id % 3 = 0 then 'A' when sheet_id % 2 = 0 then cast(seq * (1 + seq % 3) as varchar)
  else no end as no, case when seq = 2 and sheet_id % 6 = 0 then ' ' else prompt end as prompt, direction, prefix, written from fx_items)"""
NK = NUMKEY_SQL.format("no")
SECTIONS = f"""lagged as (select *, lag(num) over (partition by sheet_id order by seq) as prev_num from (select *, {NK} as num from {GAPPED} g) i),
  sections as (select *, coalesce(num <= prev_num, false) as breaks,
    1 + cast(sum(case when num <= prev_num then 1 else 0 end) over (partition by sheet_id order by seq) as bigint) as section from lagged)"""


GRADED = ("sheet_id", "seq", "no", "prompt", "direction", "prefix", "written")


def gapped(t):
    return t.sql(f"select * from {GAPPED} g")


def stored(t):
    """The same items as a stored table, which is what the checks read in use."""
    return written(gapped(t), "gapped-items")


@query("number_duplicates", f"select sheet_id, trim(no) as no, count(*) as times from {GAPPED} g group by 1, 2 having count(*) > 1")
def _(t):
    return D.number_duplicates(gapped(t))


@query("number_sections", f"with {SECTIONS} select sheet_id, seq, no, section from sections")
def _(t):
    return D.number_sections(stored(t)).select("sheet_id", "seq", "no", "section")


GAPS = """gaps as (select sheet_id, section, g.n as missing_no
  from (select sheet_id, section, min(num) as lo, max(num) as hi from sections where num < 9007199254740991 group by 1, 2) b,
  lateral (select unnest(generate_series(lo, hi)) as n) g
  where not exists (select 1 from sections s where s.sheet_id = b.sheet_id and s.section = b.section and s.num = g.n))"""


RUNS = """runs as (select sheet_id, section, min(missing_no) as gap_from, max(missing_no) as gap_to, count(*) as n
  from (select *, missing_no - row_number() over (partition by sheet_id, section order by missing_no) as island from gaps) z group by sheet_id, section, island)"""


@query("number_gaps", f"with {SECTIONS}, {GAPS}, {RUNS} select * from runs")
def _(t):
    return D.number_gaps(D.number_sections(stored(t)))


KEY_ROWS = """(select sheet_id, no, case when seq % 6 = 1 then '' when (sheet_id + seq) % 8 = 0 then concat(prompt, ' x') else upper(prompt) end as prompt, seq as pos from fx_items)"""


@query("drift_key_mismatch", f"""with k as (select sheet_id, no, max_by(prompt, pos) as kp from {KEY_ROWS} r group by 1, 2)
  select g.sheet_id, g.seq, g.no, g.prompt, kp as key_prompt from {GAPPED} g join k on k.sheet_id = g.sheet_id and k.no = g.no
  where kp <> '' and regexp_replace(lower(trim(kp)), '\\s+', ' ', 'g') <> regexp_replace(lower(trim(g.prompt)), '\\s+', ' ', 'g')""")
def _(t):
    return D.key_mismatch(gapped(t), t.sql(f"select * from {KEY_ROWS} r"))


def _list_sql(rows: str, value: str, order: str, limit: int) -> str:
    return f"""(select sheet_id, concat(string_agg(v, ', ' order by rn) filter (where rn <= {limit}), case when count(*) > {limit} then ' …' else '' end) as lst
      from (select sheet_id, {value} as v, row_number() over (partition by sheet_id order by {order}) as rn from {rows} q) z group by 1)"""


DRIFT = f"""with {SECTIONS}, {GAPS},
  items as (select * from {GAPPED} g),
  dup as (select sheet_id, trim(no) as no from items group by 1, 2 having count(*) > 1),
  keymap as (select sheet_id, no, max_by(prompt, pos) as kp from {KEY_ROWS} r group by 1, 2),
  keybad as (select g.sheet_id, g.seq, g.no from items g join keymap k on k.sheet_id = g.sheet_id and k.no = g.no
    where kp <> '' and lower(trim(kp)) <> lower(trim(g.prompt))),
  w1 as (select sheet_id, 1 as check_no, 0 as section, 'drift' as level, concat('문항 번호가 중복됩니다: ', lst) as text from {_list_sql('dup', 'no', 'no', 10)} a),
  w2 as (select sheet_id, 2, 0, 'info', concat('번호 묶음이 ', max(section), '개입니다 — 절이 나뉜 시험지로 보고 연속성은 묶음 안에서만 검사합니다.') from sections group by 1 having max(section) > 1),
  w3 as (select sheet_id, 3, section, 'drift', concat(section, '번째 묶음의 번호가 비었습니다: ',
      string_agg(missing_no, ', ' order by missing_no) filter (where rn <= 15), case when count(*) > 15 then ' …' else '' end)
    from (select *, row_number() over (partition by sheet_id, section order by missing_no) as rn from gaps) z group by sheet_id, section),
  facts as (select i.sheet_id, count(*) as n, any_value(printed_total) as total, any_value(page_count) as pages,
      coalesce(max(case when {NK} < 9007199254740991 then {NK} end), count(*)) as last, count(*) filter (where trim(prompt) = '') as n_empty
    from items i join fx_sheets s on s.sheet_id = i.sheet_id group by 1),
  w4 as (select sheet_id, 4, 0, case when ok then 'incomplete' else 'drift' end,
      case when not ok then concat('인쇄된 문항 수 ', total, ' ≠ 전사 ', n, ' — 밀렸거나 빠졌습니다.')
        when pages > 1 then concat(pages, '장을 올렸는데 ', total, '문항 중 ', n, '문항만 읽혔습니다 (', last, '번까지, ', total - n, '칸 부족). 장이 더 있는지 확인하시고, 다 올리셨다면 **', total - n, '칸을 놓친 것이니 검수해 주십시오.**')
        else concat('이 시험지는 ', total, '문항인데 ', n, '문항만 읽혔습니다 (', last, '번까지, ', total - n, '칸 부족). **뒷면이나 다음 장을 마저 찍어 함께 올리십시오.**') end
    from (select *, n < total and sheet_id not in (select sheet_id from w1 union select sheet_id from w3) as ok from facts where total > 0 and total <> n) f),
  w5 as (select sheet_id, 5, 0, 'drift', concat('제시어가 정답표와 다릅니다(밀림 의심): ', lst) from {_list_sql('keybad', 'no', 'seq', 15)} a),
  w6 as (select sheet_id, 6, 0, 'info', concat('제시어가 비어 있는 문항 ', n_empty, '개 — 밀림 검증이 그만큼 약해집니다.') from facts where n_empty > 0),
  px as (select * from items where trim(prefix) <> '' and trim(written) <> '' and not starts_with(lower(trim(written)), lower(trim(prefix)))),
  w7 as (select sheet_id, 7, 0, 'drift', concat('인쇄된 첫 글자와 답이 안 맞습니다(밀림 의심): ', lst) from {_list_sql('px', 'no', 'seq', 15)} a),
  lg as (select *, case when direction = 'ko2en' and regexp_matches(written, '[가-힣]') then '한글' when direction = 'en2ko' and not regexp_matches(written, '[가-힣]') then '영문' end as lang
    from items where length(trim(written)) >= 2),
  lh as (select * from lg where lang is not null),
  w8 as (select sheet_id, 8, 0, 'drift', concat('출제 방향과 답의 언어가 다릅니다(밀림 의심): ', lst) from {_list_sql('lh', "concat(no, '(', lang, ')')", 'seq', 15)} a),
  allw as (select * from w1 union all select * from w2 union all select * from w3 union all select * from w4 union all select * from w5
    union all select * from w6 union all select * from w7 union all select * from w8)"""


@query("drift_warnings", DRIFT + " select sheet_id, check_no, cast(section as bigint) as section, level, text from allw")
def _(t):
    t.keep("items", *GRADED)
    return D.drift_warnings(gapped(t), t.sheets, t.sql(f"select * from {KEY_ROWS} r"))


@query("drift_findings", DRIFT.replace("dup as (", RUNS + ", dup as (", 1) + """ select sheet_id, 1 as check_no, cast(0 as bigint) as section, no as item from dup
  union all select sheet_id, 3, section, concat(gap_from, '-', gap_to) from runs union all select sheet_id, 5, 0, no from keybad
  union all select sheet_id, 7, 0, no from px union all select sheet_id, 8, 0, concat(no, '(', lang, ')') from lh""")
def _(t):
    t.keep("items", *GRADED)
    return D.drift_findings(stored(t), t.sql(f"select * from {KEY_ROWS} r"))


PAGED = """(select sheet_id, cast(seq % (1 + sheet_id % 2) as int) as page, seq as pos, no, prompt, prefix, written, blank, legible, confidence from fx_items)"""
PARTS = """(select sheet_id, k as page, case when sheet_id % 5 = k then '' else concat(' ', title, ' ', cast(k as varchar)) end as title,
  case when sheet_id % 3 = k then class_name else ' ' end as teacher, case when k = 1 then student_name end as student, cut_line,
  printed_total - k as printed_total from fx_sheets cross join (select 0 as k union all select 1 as k) r where k <= sheet_id % 2)"""


@query("merge_pages", f"""select sheet_id, no, written, confidence, n_parts from (
  select *, 1 + sheet_id % 2 as n_parts, row_number() over (partition by sheet_id, no order by
    (case when blank then 0 else 1 end + case when legible then 1 else 0 end + case when trim(written) <> '' then 1 else 0 end) desc, confidence desc, page, pos) as rn
  from {PAGED} p) z where n_parts = 1 or rn = 1""")
def _(t):
    merged = P.merge_items(t.sql(f"select * from {PAGED} p"), t.sql(f"select sheet_id, page from {PARTS} p"))
    return merged.select("sheet_id", "no", "written", "confidence", "n_parts")


@query("merge_page_headers", f"""select sheet_id,
  case when count(*) > 1 then coalesce(min_by(nullif(trim(title), ''), page) filter (where trim(title) <> ''), '') else any_value(title) end as title,
  case when count(*) > 1 then coalesce(min_by(trim(teacher), page) filter (where trim(teacher) <> ''), '') else any_value(teacher) end as teacher,
  case when count(*) > 1 then coalesce(min_by(trim(student), page) filter (where trim(student) <> ''), '') else any_value(student) end as student,
  cast(greatest(max(printed_total), 0) as int) as printed_total, count(*) as n_parts from {PARTS} p group by 1""")
def _(t):
    return P.merge_headers(t.sql(f"select * from {PARTS} p")).drop("cut_line")


@query("merge_bands", f"""select sheet_id, no, band, pos, written, row_number() over (partition by sheet_id order by {NK}, no) as ord from (
  select *, row_number() over (partition by sheet_id, no order by confidence desc, band, pos) as rn
  from (select sheet_id, seq % 3 as band, seq as pos, no, written, confidence from fx_items) b) z where rn = 1""")
def _(t):
    return P.merge_bands(t.items.withColumn("band", F.col("seq") % 3).withColumnRenamed("seq", "pos")).select("sheet_id", "no", "band", "pos", "written", "ord")


@query("band_headers", f"""select sheet_id, title, teacher, student from (select *, row_number() over (partition by sheet_id order by page desc) as rn from {PARTS} p) z where rn = 1""")
def _(t):
    headers = t.sql(f"select *, -page as band from {PARTS} p")
    return P.band_headers(headers).select("sheet_id", "title", "teacher", "student")


@query("last_number", f"""select sheet_id, coalesce(max(case when {NK} < 9007199254740991 then {NK} end), 0) as last_no from {GAPPED} g group by 1""")
def _(t):
    return P.last_number(gapped(t))


RESULTS = """(select sheet_id, no, seq as pos, seq, correct, case when seq % 9 = 8 then '' else expected end as expected, note from fx_items where (sheet_id + seq) % 13 <> 0)"""


@query("items_from_transcript", f"""with j as (select sheet_id, no, max_by(correct is null, pos) as nul, max_by(coalesce(correct, false), pos) as c, max_by(expected, pos) as expected, max_by(note, pos) as note from {RESULTS} r group by 1, 2)
  select i.sheet_id, i.seq, i.no, i.written, case when not nul then c end as correct, coalesce(j.expected, '') as expected, coalesce(j.note, '') as note
  from fx_items i left join j on j.sheet_id = i.sheet_id and j.no = i.no""")
def _(t):
    return R.items_from_transcript(t.items.select("sheet_id", "seq", "no", "written"), t.sql(f"select * from {RESULTS} r"))


REFS = """(select sheet_id, no, seq as pos, case when seq % 4 = 3 then '' when seq % 7 = 6 then concat(prompt, '?') else upper(prompt) end as prompt,
  case when seq % 11 = 10 then '' else concat(' ', expected) end as expected from fx_items where (sheet_id + seq) % 17 <> 0)"""
APPLY = f"""with r as (select sheet_id, no, max_by(prompt, pos) as rp, max_by(expected, pos) as re from {REFS} q group by 1, 2),
  j as (select i.sheet_id, i.seq, coalesce(re, '') as expected, legible, blank,
    (coalesce(rp, '') = '' or prompt = '' or lower(trim(rp)) = lower(trim(prompt))) and coalesce(re, '') <> '' and lower(trim(written)) = lower(trim(re)) as eq
    from fx_items i left join r on r.sheet_id = i.sheet_id and r.no = i.no)"""
APPLY_COLS = """select sheet_id, seq, expected, case when not legible or blank or eq then 'pre' else 'todo' end as action,
  case when not legible or blank then false when eq then true end as correct,
  case when not legible then '판독불가' when blank then '무응답' when eq then '' end as note from j"""


KEYED = ("sheet_id", "seq", "no", "prompt", "expected", "written", "legible", "blank")


@query("apply_reference", APPLY + APPLY_COLS)
def _(t):
    t.keep("items", *KEYED)
    return R.apply_reference(t.items, t.sql(f"select * from {REFS} q")).select("sheet_id", "seq", "expected", "action", "correct", "note")


@query("rule_prejudge", APPLY + f" select note, correct, count(*) as n from ({APPLY_COLS}) z where action = 'pre' group by 1, 2")
def _(t):
    t.keep("items", *KEYED)
    done = R.apply_reference(t.items, t.sql(f"select * from {REFS} q")).filter("action = 'pre'")
    return done.groupBy("note", "correct").agg(F.count("*").alias("n"))


FINGERPRINT = """fp as (select s.sheet_id, concat(lower(trim(title)), '|', nos) as fingerprint from fx_sheets s
  join (select sheet_id, string_agg(trim(no), ',' order by seq) as nos from fx_items group by 1) n on n.sheet_id = s.sheet_id where trim(title) <> '')"""


@query("ref_fingerprint", f"with {FINGERPRINT} select * from fp")
def _(t):
    return R.ref_fingerprint(t.items, t.sheets)


BUILD_ITEMS = """(select sheet_id, seq, cast(seq + 1 as varchar) as no, prompt, direction from fx_items where sheet_id % 40 <> 3)"""
BUILD_RESULTS = """(select sheet_id, cast(seq + 1 as varchar) as no, seq as pos, correct, case when (sheet_id + seq) % 19 = 0 then ' ' else expected end as expected, note from fx_items)"""
BUILD_WARN = """(select sheet_id, warn_level as level from fx_sheets where warn_level is not null)"""


@query("build_reference", f"""with i as (select * from {BUILD_ITEMS} a), r as (select * from {BUILD_RESULTS} b),
  n as (select sheet_id, string_agg(no, ',' order by seq) as nos, count(*) as cnt from i group by 1)
  select i.sheet_id, concat(lower(s.title), '|', nos) as fingerprint, s.title, i.seq, i.no, prompt, direction, r.expected
  from i join r on r.sheet_id = i.sheet_id and r.no = i.no join fx_sheets s on s.sheet_id = i.sheet_id join n on n.sheet_id = i.sheet_id
  where not exists (select 1 from r x where x.sheet_id = i.sheet_id and (trim(x.expected) = '' or contains(x.note, '정답모름')))
    and coalesce(warn_level, 'info') = 'info' and (printed_total = 0 or printed_total <= cnt)""")
def _(t):
    t.keep("items", "sheet_id", "seq", "prompt", "direction", "correct", "expected", "note")
    return R.build_reference(
        t.sql(f"select * from {BUILD_ITEMS} a"), t.sql(f"select * from {BUILD_RESULTS} b"), t.sheets, t.sql(f"select * from {BUILD_WARN} w")
    )


@query("key_as_reference", """select concat('key:', i.slug) as fingerprint, title, no, '' as prompt, 'ko2en' as direction, expected
  from fx_key_items i join fx_keys k on k.slug = i.slug""")
def _(t):
    return R.key_as_reference(t.key_items.join(t.keys, "slug"))


@query("resolve_reference", f"""with {FINGERPRINT},
  refs as (select distinct fingerprint from fp where sheet_id % 5 = 0),
  km as (select sheet_id, concat('key:', lower(title)) as k from fx_sheets where sheet_id % 3 = 0)
  select s.sheet_id, coalesce(k, r.fingerprint) as ref_id, case when k is not null then 'key' when r.fingerprint is not null then 'reference' end as origin
  from fx_sheets s left join km on km.sheet_id = s.sheet_id left join fp on fp.sheet_id = s.sheet_id left join refs r on r.fingerprint = fp.fingerprint""")
def _(t):
    fp = R.ref_fingerprint(t.items, t.sheets)
    km = t.sheets.filter("sheet_id % 3 = 0").select("sheet_id", R.key_slug(F.col("title")).alias("slug"))
    return R.resolve_reference(t.sheets, km, fp, fp.filter("sheet_id % 5 = 0"))


@query("key_slug", "select sheet_id, nullif(lower(trim(title)), '') as slug from fx_exams")
def _(t):
    return t.exams.select("sheet_id", R.key_slug(F.col("title")).alias("slug"))


@query("unjudged_warning", """select sheet_id, cast(0 as bigint) as part, 'incomplete' as level,
  concat(count(*), '문항은 정답을 알 수 없어 판정하지 않았습니다 (', string_agg(no, ', ' order by seq), '번). 지문을 봐야 정답이 나오는 유형입니다 — 그 문항은 사람이 채점하십시오.') as text
  from fx_items where contains(note, '정답모름') group by 1""")
def _(t):
    return R.unjudged_warning(t.items)
