"""Answer key matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.checks.registry import query
from markloom.functions import titles as TF
from markloom.functions.money import round2
from markloom.operators import matching as M
from markloom.operators import reference as R

BG = """list_distinct(case when length(replace({0}, ' ', '')) > 1 then list_transform(generate_series(1, length(replace({0}, ' ', '')) - 1), lambda i: substring(replace({0}, ' ', ''), i, 2)) else [replace({0}, ' ', '')] end)"""
NUMS = """list_distinct(list_transform(list_filter(regexp_extract_all({0}, '[0-9]+'), lambda r: length(r) <= 4), lambda r: cast(r as bigint)))"""
SCORED = f"""
  tt as (select distinct lower(trim(title)) as a from fx_exams where trim(title) <> ''),
  ta as (select a, {BG.format('a')} as ba, {NUMS.format('a')} as na from tt),
  kb as (select slug, lower(trim(title)) as b, {BG.format('lower(trim(title))')} as bb, {NUMS.format('lower(trim(title))')} as nb from fx_keys),
  raw as (select a, slug, a = b as same, 2.0e0 * len(list_intersect(ba, bb)) / (len(ba) + len(bb)) as letters,
    len(list_intersect(na, nb)) as hit, len(na) as la, len(nb) as lb from ta cross join kb),
  scored as (select a as title, slug, case when same then 1.0e0 when la = 0 or lb = 0 then letters when hit = 0 then 0.0e0
    else 0.55e0 * letters + 0.45e0 * (cast(hit as double) / (la + lb - hit)) end as score from raw)"""


@query("exact_title_match", """select sheet_id, slug, k.title as key_title from fx_exams e join fx_keys k on k.slug = lower(trim(e.title))""")
def _(t):
    return M.exact_title_match(t.exams, t.keys)


@query("title_similarity_join", f"with {SCORED} select title, slug, round(score, 6) as score from scored where score >= 0.5")
def _(t):
    return M.title_similarity_join(t.exams, t.keys).withColumn("score", F.round("score", 6))


@query("title_score", f"""with {SCORED} select title, slug, round(score, 6) as score from scored s join (select distinct lower(trim(title)) as title, lower(concat(p_type, ' Unit ', cast(p_size as varchar), '-', cast(p_size + 1 as varchar))) as slug from fx_exams) e using (title, slug)""")
def _(t):
    own = t.sql("""select distinct lower(trim(title)) as title, lower(concat(p_type, ' Unit ', cast(p_size as varchar), '-', cast(p_size + 1 as varchar))) as slug
        from fx_exams where trim(title) <> ''""")
    return own.select("title", "slug", F.round(TF.title_score(F.col("title"), F.col("slug")), 6).alias("score"))


@query("bigrams", f"select slug, len({BG.format('slug')})::int as n_pairs, array_to_string(list_sort({BG.format('slug')}), ',') as pairs from fx_keys")
def _(t):
    pairs = TF.letter_pairs(F.col("slug"))
    return t.keys.select("slug", F.size(pairs).alias("n_pairs"), F.array_join(F.sort_array(pairs), ",").alias("pairs"))


@query("numbers", f"select sheet_id, array_to_string(list_sort({NUMS.format('lower(title)')}), ',') as nums from fx_exams")
def _(t):
    nums = F.sort_array(TF.title_numbers(F.lower("title"))).cast("array<string>")
    return t.exams.select("sheet_id", F.array_join(nums, ",").alias("nums"))


PAIR = "lower(title)"


@query("dice", f"""with p as (select sheet_id, {BG.format("lower(concat('x ', title))")} as a, {BG.format("lower(concat('exam ', title))")} as b from fx_exams)
  select sheet_id, round(2.0e0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) as dice from p""")
def _(t):
    a, b = (TF.letter_pairs(F.lower(F.concat(F.lit(x), "title"))) for x in ("x ", "exam "))
    return t.exams.select("sheet_id", F.round(TF.dice(a, b), 6).alias("dice"))


@query("jaccard", f"""with p as (select sheet_id, {NUMS.format("lower(title)")} as a, {NUMS.format("lower(concat(title, ' 7 12'))")} as b from fx_exams)
  select sheet_id, round(case when len(a) = 0 or len(b) = 0 then 0.0e0 else cast(len(list_intersect(a, b)) as double) / (len(a) + len(b) - len(list_intersect(a, b))) end, 6) as jaccard from p""")
def _(t):
    a, b = TF.title_numbers(F.lower("title")), TF.title_numbers(F.lower(F.concat("title", F.lit(" 7 12"))))
    return t.exams.select("sheet_id", F.round(TF.jaccard(a, b), 6).alias("jaccard"))


OVERLAP = """
  pa as (select distinct sheet_id, lower(trim(prompt)) as p from fx_exam_items where trim(prompt) <> ''),
  pb as (select distinct slug, lower(trim(prompt)) as p from fx_key_items where trim(prompt) <> ''),
  sa as (select sheet_id, count(*) as na from pa group by 1), sb as (select slug, count(*) as nb from pb group by 1),
  hit as (select sheet_id, slug, count(*) as hits from pa join pb on pa.p = pb.p group by 1, 2),
  overlap as (select h.sheet_id, h.slug, hits, cast(hits as double) / least(na, nb) as ratio from hit h join sa on sa.sheet_id = h.sheet_id join sb on sb.slug = h.slug)"""


@query("prompt_overlap_join", f"with {OVERLAP} select sheet_id, slug, hits, round(ratio, 6) as ratio from overlap where ratio >= 0.7e0 - 0.15e0")
def _(t):
    t.keep_exams()
    lists, items = t.exam_lists
    return M.prompt_overlap_join(items, t.key_items, lists=lists).withColumn("ratio", F.round("ratio", 6))


@query("top2_margin", f"""with {SCORED}, r as (select *, row_number() over (partition by title order by score desc, slug) as rn,
    lead(score) over (partition by title order by score desc, slug) as runner_up from scored where score >= 0.5)
  select title, slug, round(score, 6) as score, round(runner_up, 6) as runner_up, round(score - runner_up, 6) as margin from r where rn = 1""")
def _(t):
    best = M.top2_margin(M.title_similarity_join(t.exams, t.keys), ["title"], "score")
    return best.select("title", "slug", *[F.round(c, 6).alias(c) for c in ("score", "runner_up", "margin")])


@query("ambiguous_top3", f"""with {SCORED}, r as (select *, row_number() over (partition by title order by score desc, slug) as place from scored where score >= 0.6e0)
  select r.title, cast(place as int) as place, r.slug, k.title as key_title, floor(score * 100 + 0.5) / 100 as score from r join fx_keys k on k.slug = r.slug where place <= 3""")
def _(t):
    return M.ambiguous_top3(M.title_similarity_join(t.exams, t.keys), t.keys)


MATCH = f"""{SCORED}, {OVERLAP},
  e as (select sheet_id, lower(trim(title)) as nt from fx_exams),
  ex as (select e.sheet_id, k.slug, k.title as kt from e join fx_keys k on k.slug = e.nt where nt <> ''),
  rest as (select * from e where sheet_id not in (select sheet_id from ex)),
  tr as (select *, row_number() over (partition by title order by score desc, slug) as rn, lead(score) over (partition by title order by score desc, slug) as ru
    from scored where score >= 0.6e0 - 0.1e0),
  tb as (select tr.title, tr.slug, k.title as kt, score, ru from tr join fx_keys k on k.slug = tr.slug where rn = 1 and score >= 0.6e0 and (ru is null or score - ru >= 0.1e0)),
  nr as (select tr.title, count(*) as n_near, string_agg(concat(k.title, '=', printf('%.2f', floor(score * 100 + 0.5) / 100)), '; ' order by rn) as near
    from tr join fx_keys k on k.slug = tr.slug where score >= 0.6e0 and rn <= 3 group by 1),
  ir as (select *, row_number() over (partition by sheet_id order by ratio desc, slug) as rn, lead(ratio) over (partition by sheet_id order by ratio desc, slug) as ru
    from overlap where ratio >= 0.7e0 - 0.15e0),
  ib as (select ir.sheet_id, ir.slug, k.title as kt, hits, ratio, ru from ir join fx_keys k on k.slug = ir.slug
    where rn = 1 and ratio >= 0.7e0 and hits >= 5 and (ru is null or ratio - ru >= 0.15e0)),
  j as (select rest.sheet_id, tb.slug as ts, tb.kt as tk, tb.score as tsc, tb.ru as tru, ib.slug as is_, ib.kt as ik, ib.hits, ib.ratio, ib.ru as iru, near
    from rest left join tb on tb.title = rest.nt left join nr on nr.title = rest.nt left join ib on ib.sheet_id = rest.sheet_id),
  d as (select *, case when coalesce(ts <> is_, false) then null when is_ is not null then '문항' when ts is not null then '제목 근사' end as how from j)
  select sheet_id, slug, '제목' as how, 1.0e0 as score, 0.0e0 as rival_score, concat('제목이 「', kt, '」과 같습니다.') as why, '' as ambiguous from ex
  union all select sheet_id, case how when '문항' then is_ when '제목 근사' then ts end,  how,
    floor(case how when '문항' then ratio when '제목 근사' then tsc end * 100 + 0.5) / 100, floor(case how when '문항' then iru when '제목 근사' then tru end * 100 + 0.5) / 100,
    case how when '문항' then concat('제목은 못 맞췄지만 제시어 ', hits, '개가 「', ik, '」과 같습니다.') when '제목 근사' then concat('제목이 「', tk, '」과 비슷합니다 (', cast(floor(tsc * 100 + 0.5) as bigint), '%).') end,
    case when coalesce(ts <> is_, false) then concat(tk, '=', printf('%.2f', floor(tsc * 100 + 0.5) / 100), '; ', ik, '=', printf('%.2f', floor(ratio * 100 + 0.5) / 100))
      when how is null then coalesce(near, '') else '' end from d"""


def matched(t):
    t.keep_exams()
    lists, items = t.exam_lists
    return M.match_answer_key(t.exams, items, t.keys, t.key_items, lists)


@query("match_answer_key", "with " + MATCH)
def _(t):
    shown = F.transform("ambiguous", lambda a: F.concat(a["title"], F.lit("="), F.format_string("%.2f", a["score"])))
    return matched(t).withColumn("ambiguous", F.array_join(shown, "; "))


@query("key_match_notes", f"""with m as (with {MATCH}) select sheet_id, 'info' as level, concat('🔶 정답지를 「', how, '」로 붙였습니다 — ', why, ' 다른 시험의 정답지가 아닌지 확인하십시오.') as text
    from m where slug is not null and how <> '제목'
  union all select sheet_id, 'info', concat('정답지 「', regexp_replace(regexp_replace(ambiguous, '=[0-9.]+', '', 'g'), '; ', '」, 「', 'g'), '」가 비슷해 어느 것인지 정하지 못했습니다. 엉뚱한 정답으로 채점하지 않으려고 하나도 안 썼습니다 — 정답지 화면에서 시험 제목을 답안지와 같게 고쳐 등록하면 채점됩니다.')
    from m where slug is null and ambiguous <> ''""")
def _(t):
    return R.key_match_notes(matched(t))
