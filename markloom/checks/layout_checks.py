"""Layout and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom import constants as K
from markloom.checks.registry import query
from markloom.functions import text as T
from markloom.operators import layout as L
from markloom.operators import sequence_diff as D

BOX_SQL = "round(min(x), 4) as x, round(min(y), 4) as y, round(max(x + w) - min(x), 4) as w, round(max(y + h) - min(y), 4) as h"
LINES = """lg as (select *, lag(page) over d as pp, lag(y) over d as py from fx_words window d as (partition by doc_id order by pos)),
  ln as (select *, cast(sum(case when pp is null or page <> pp or abs(y - py) > 0.008e0 then 1 else 0 end) over (partition by doc_id order by pos) as bigint) as line from lg)"""


@query("tokens_to_lines", f"with {LINES} select doc_id, line, min(page) as page, count(*) as n_tokens, trim(string_agg(text, ' ' order by pos)) as text, {BOX_SQL} from ln group by 1, 2")
def _(t):
    return L.tokens_to_lines(t.words, ["doc_id"]).select("doc_id", "line", "page", "n_tokens", T.trimmed(F.col("text")).alias("text"), *L.BOX)


@query("bbox_union", f"select doc_id, page, {BOX_SQL} from fx_words group by 1, 2")
def _(t):
    return L.bbox_union(t.words, ["doc_id", "page"])


SPANS = """(select doc_id, page, cast(floor(pos / 10.0e0) as bigint) as line, pos, text, cast(case pos % 4 when 3 then 0 when 2 then 16119285 else 16777215 end as int) as color,
  x * 600 as x0, y * 800 as y0, x * 600 + case when pos % 3 = 0 then 40.0e0 else 53.5e0 end as x1, (y + h) * 800 as y1 from fx_words where trim(text) <> '')"""
GROUPS = """lg as (select *, lag(x1) over (partition by doc_id, page, line order by pos) as px from sp),
  gr as (select *, cast(sum(case when x0 - px >= 1 then 1 else 0 end) over (partition by doc_id, page, line order by pos) as bigint) as grp from lg)"""
SIZES = "(select distinct doc_id, page, 600.0e0 as width, 800.0e0 as height from fx_words)"


@query("merge_adjacent_spans", f"""with sp as (select * from {SPANS} s), {GROUPS} select doc_id, page, line, grp, string_agg(text, '' order by pos) as text, round(min_by(x0, pos), 4) as x0, round(max_by(x1, pos), 4) as x1, round(min(y0), 4) as y0, round(max(y1), 4) as y1 from gr group by 1, 2, 3, 4""")
def _(t):
    merged = L.merge_adjacent_spans(t.sql(f"select * from {SPANS} s"))
    return merged.select("doc_id", "page", "line", "grp", "text", *[F.round(c, 4).alias(c) for c in ("x0", "x1", "y0", "y1")])


@query("hidden_span_answers", f"""with sp as (select * from {SPANS} s where color >= 15790320 and not regexp_matches(trim(text), '^[\\s.,)(\\]\\[:;\\-–—~∙*※→…/]+$')), {GROUPS}
  select doc_id, page, line, grp, trim(string_agg(text, '' order by pos)) as answer, round(min_by(x0, pos) / 600, 4) as x, round(min(y0) / 800, 4) as y, round((max_by(x1, pos) - min_by(x0, pos)) / 600, 4) as w, round((max(y1) - min(y0)) / 800, 4) as h from gr group by 1, 2, 3, 4""")
def _(t):
    out = L.hidden_span_answers(t.sql(f"select * from {SPANS} s"), t.sql(f"select * from {SIZES} z"))
    return out.drop("part")


PRINTED = """(select doc_id, page, pos, case pos % 7 when 1 then concat(text, '____') when 2 then concat(cast(pos % 200 as varchar), case when pos % 2 = 0 then '.' else ')' end) when 3 then concat('③', text) else text end as text, x, y, case when pos % 4 = 0 then 0.03e0 else w end as w, h from fx_words)"""
RULES = """(select doc_id, page, pos, x, y, w, 0.001e0 as h, cast(pos % 5 as double) as height_pt, 800.0e0 as page_height from fx_words cross join (select 0 as k union all select 1 as k) r where pos % 10 = 0)"""


@query("layout_regions", f"""select 'underscore' as kind, doc_id, page, pos, round(x, 4) as x, round(y, 4) as y, round(w, 4) as w, round(h, 4) as h, cast(null as int) as index from {PRINTED} p where contains(text, '___') and y between 0.1 and 0.97 and w >= 0.04
  union all select 'choice', doc_id, page, pos, round(x, 4), round(y, 4), round(w, 4), round(h, 4), cast(3 as int) from {PRINTED} p where starts_with(text, '③')
  union all select distinct 'rule', doc_id, page, pos, round(x, 4), round(y - 14.0e0 / 800, 4), round(w, 4), 0.02e0, cast(null as int) from {RULES} r where height_pt <= 2.5 and w >= 0.05 and y between 0.1 and 0.97""")
def _(t):
    out = L.layout_regions(t.sql(f"select * from {PRINTED} p"), t.sql(f"select * from {RULES} r"))
    return out.select("kind", "doc_id", "page", "pos", *L.BOX, "index")


QNUM = f"select doc_id, page, pos, cast(regexp_extract(text, '^(\\d{{1,3}})[.)]$', 1) as int) as number, x, y from {PRINTED} p where regexp_matches(text, '^\\d{{1,3}}[.)]$') and y between 0.1 and 0.97"


@query("question_numbers", QNUM)
def _(t):
    return L.question_numbers(t.sql(f"select * from {PRINTED} p")).drop("w", "h")


NUMS = "(select doc_id, page, pos, cast(pos % 60 as int) as number, x, y from fx_words where pos % 10 in (0, 5) and pos % 70 < 40)"
REGS = "(select doc_id, page, pos, x, y + case when pos % 10 = 7 then 0.011e0 else 0.0e0 end as y from fx_words where pos % 10 in (2, 7, 8))"
MATCHED = f"""with n as (select * from {NUMS} a), r as (select * from {REGS} b),
  b as (select r.doc_id, r.page, r.pos, max({{'y': n.y, 'x': n.x, 'n': number}}) filter (where abs(n.y - r.y) < 0.02e0 and n.x <= r.x + 0.01e0) as b1, max({{'y': n.y, 'x': n.x, 'n': number}}) filter (where r.y - n.y > 0 and r.y - n.y < 0.045e0) as b2
    from r left join n on n.doc_id = r.doc_id and n.page = r.page and abs(n.y - r.y) < 0.045e0 group by 1, 2, 3)
  select doc_id, page, pos, coalesce(b1['n'], b2['n']) as question from b"""


def matched(t):
    return L.number_region_match(t.sql(f"select * from {NUMS} a"), t.sql(f"select * from {REGS} b"))


@query("number_region_match", MATCHED)
def _(t):
    return matched(t).select("doc_id", "page", "pos", "question")


PAGES = """(select doc_id, cast(doc_id % 3 + 1 as int) as page, doc_id % 200 as book, case when doc_id % 4 = 0 then lang when doc_id % 4 = 1 then regexp_replace(text, '[a-z]', '#'{g}) else text end as text, doc_id * 7 % 600 as n_draw, doc_id % 3 as n_img from documents)"""
BROKEN = """len(sample) >= 40 and len(regexp_replace(sample, '[^\\p{L}\\p{N}]', '', 'g')) < len(sample) * 0.45e0"""
KIND = f"""pg as (select *, substring(regexp_replace(text, '\\s+', '', 'g'), 1, 600) as sample, length(trim(text)) as n from {PAGES.format(g=", 'g'")} p),
  kd as (select *, case when n > 200 and {BROKEN} then 'mojibake' when n > 200 then 'text' when n_draw > 300 then 'outlined' when n_img > 0 and n < 50 then 'scanned' else 'sparse' end as kind from pg)"""


def page_rows(t):
    return t.sql(f"select * from {PAGES.format(g='')} p")


@query("page_layout_class", f"with {KIND} select doc_id, kind from kd")
def _(t):
    return L.page_layout_class(page_rows(t)).select("doc_id", "kind")


@query("page_kind_summary", f"""with {KIND}, k as (select book, kind, count(*) as n, min(doc_id) as f from kd group by 1, 2), m as ({MATCHED}),
  nu as (select doc_id % 200 as book, count(distinct number) as numbers from {NUMS} a group by 1), rg as (select doc_id % 200 as book, count(question) as regions, count(*) filter (where question is null) as orphans from m group by 1)
  select k.book as doc_id, max_by(kind, {{'n': n, 'f': -f}}) as layer, cast(sum(n) as bigint) as pages, coalesce(any_value(numbers), 0) as numbers, coalesce(any_value(regions), 0) as regions, coalesce(any_value(orphans), 0) as orphans
  from k left join nu on nu.book = k.book left join rg on rg.book = k.book group by 1""")
def _(t):
    kinds = L.page_layout_class(page_rows(t)).select(F.col("book").alias("doc_id"), F.col("doc_id").alias("page"), "kind")
    book = (F.col("doc_id") % 200).alias("doc_id")
    return L.page_kind_summary(kinds, t.sql(f"select * from {NUMS} a").withColumn("doc_id", book), matched(t).withColumn("doc_id", book))


@query("mojibake_docs", f"with pg as (select doc_id, substring(regexp_replace(text, '\\s+', '', 'g'), 1, 600) as sample from {PAGES.format(g=', ' + chr(39) + 'g' + chr(39))} p) select doc_id from pg where {BROKEN}")
def _(t):
    return page_rows(t).filter(T.is_mojibake(F.col("text"))).select("doc_id")


@query("has_text_layer", f"select doc_id, length(regexp_replace(text, '\\s+', '', 'g')) >= 40 as has_text from {PAGES.format(g=', ' + chr(39) + 'g' + chr(39))} p")
def _(t):
    return page_rows(t).select("doc_id", T.has_text_layer(F.col("text")).alias("has_text"))


DOCS = """(select doc_id, 10 + doc_id % 50 as exam_tokens, doc_id % 70 as exam_images, 12 + doc_id % 50 + doc_id % 9 as key_tokens, doc_id % 40 as key_images from documents)"""


@query("document_flags", f"""with d as (select *, exam_images > greatest(exam_tokens, 30) as a, key_images > greatest(key_tokens, 30) as b from {DOCS} d)
  select doc_id, a as exam_image_based, b as key_image_based, not a and exam_images > exam_tokens * 0.15e0 as exam_has_images, not b and key_images > key_tokens * 0.15e0 as key_has_images, not (a or b) and key_tokens - exam_tokens < 5 as key_not_filled from d""")
def _(t):
    return L.document_flags(t.sql(f"select * from {DOCS} d"))


ZW = "​"
HID = f"(select doc_id, replace(text, 'en ', 'en{ZW} ') as text from documents)"


@query("hidden_chars", f"select doc_id, replace(replace(text, '\r', '⟨U+000D⟩'), '{ZW}', '⟨U+200B⟩') as shown from {HID} h")
def _(t):
    return t.sql(f"select * from {HID} h").select("doc_id", T.mark_hidden(F.col("text")).alias("shown"))


@query("odd_chars", f"""with o as (select doc_id, regexp_extract_all(replace(text, '{ZW}', ''), '[^\\x{{20}}-\\x{{7e}}\\x{{b7}}\\x{{2013}}\\x{{2014}}\\x{{2018}}\\x{{2019}}\\x{{201c}}\\x{{201d}}\\x{{2026}}\\x{{ac00}}-\\x{{d7a3}}]') as l from {HID} h),
  u as (select doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) as l from o)
  select doc_id, case when len(l) > 0 then array_to_string(list_transform(l, lambda x: concat(x, ' U+', printf('%04X', unicode(x)))), ', ') end as odd from u""")
def _(t):
    return t.sql(f"select * from {HID} h").select("doc_id", T.odd_chars(F.col("text")).alias("odd"))


NOISY = "(select doc_id, pos, case pos % 9 when 0 then '...' when 1 then ' ( ) ' when 2 then '—※' when 3 then concat('*', text) when 4 then ' ' else text end as text from fx_words)"


@query("is_noise", f"select doc_id, pos, regexp_matches(text, '^[\\s.,)(\\]\\[:;\\-–—~∙*※→…]+$') or length(trim(text)) < 1 as noise from {NOISY} n")
def _(t):
    return t.sql(f"select * from {NOISY} n").select("doc_id", "pos", T.is_noise(F.col("text")).alias("noise"))


# every word pair of a conversation becomes an answer line, a bare number or plain text
KEYTEXT = """(select doc_id, {agg} as text from (select doc_id, pos, case pos % 8 when 0 then concat('(', cast(pos % 50 as varchar), ') 정답: ', text, ' ') when 2 then concat(cast(pos % 50 as varchar), '.') when 5 then concat(' ', text) else text end as l from fx_words) z group by doc_id)"""
KT_DUCK = KEYTEXT.format(agg="string_agg(l, chr(10) order by pos)")
KT_SPARK = KEYTEXT.format(agg="array_join(transform(array_sort(collect_list(struct(pos, l))), x -> x.l), chr(10))")


@query("parse_answer_lines", f"""with tx as (select doc_id, list_transform(string_split(text, chr(10)), lambda s: trim(s)) as ls from {KT_DUCK} k),
  ex as (select doc_id, unnest(ls) as a, unnest(generate_series(0, len(ls) - 1)) as i, unnest(list_append(ls[2:], null)) as b, unnest(list_concat(ls[3:], [null, null])) as c from tx)
  select doc_id, i::int as line, 'explained' as form, cast(regexp_extract(a, '[(\\[]?(\\d{{1,3}})[)\\].]?\\s*정답\\s*[:：]\\s*(.+?)\\s*$', 1) as int) as number, null as prompt, regexp_extract(a, '[(\\[]?(\\d{{1,3}})[)\\].]?\\s*정답\\s*[:：]\\s*(.+?)\\s*$', 2) as answer from ex where regexp_matches(a, '[(\\[]?(\\d{{1,3}})[)\\].]?\\s*정답\\s*[:：]\\s*(.+?)\\s*$')
  union all select doc_id, i::int, 'parallel', cast(regexp_extract(a, '^(\\d{{1,3}})[.)]$', 1) as int), b, c from ex where regexp_matches(a, '^\\d{{1,3}}[.)]$') and coalesce(b, '') <> '' and coalesce(c, '') <> '' and not regexp_matches(c, '^\\d{{1,3}}[.)]$')""")
def _(t):
    return L.parse_answer_lines(t.sql(f"select * from {KT_SPARK} k"))


FILES = """(select p_partkey as id, p_brand as level, concat('문법 ', case when p_partkey % 3 = 0 then 'ch_' when p_partkey % 3 = 1 then 'Ch. ' else 'Part' end, cast(p_size as varchar), '. ', p_name, case when p_partkey % 10 = 9 then '.hwp' else '.PDF' end) as file from part)"""
CH = "cast(nullif(regexp_extract(file, '[Cc]h\\s*\\.?\\s*_?\\s*(\\d{1,2})', 1), '') as int)"


@query("exam_key_pairing", f"""with k as (select level, {CH} as ch, min(file) as key_file from {FILES} f where id % 5 = 0 and lower(file) like '%.pdf' and {CH} is not null group by 1, 2),
  e as (select id, level, file, coalesce({CH}, 0) as ch from {FILES} f where id % 5 <> 0 and lower(file) like '%.pdf')
  select id, e.level, file, e.ch as chapter, key_file from e left join k on k.level = e.level and k.ch = e.ch""")
def _(t):
    f = t.sql(f"select * from {FILES} f")
    return L.exam_key_pairing(f.filter("id % 5 <> 0"), f.filter("id % 5 = 0").drop("id"))


UNITS = "(select p_brand as level, p_size as chapter, p_partkey as unit_id, p_partkey % 40 as n_hidden, case when p_partkey % 4 = 0 then 0 else p_partkey * 7 % 45 end as n_diff from part where p_partkey % 3 <> 0 union all select p_brand, p_size, p_partkey, 0, p_partkey % 2 from part where p_partkey % 3 = 0)"
AUDIT = f"""au as (select *, greatest(n_hidden, n_diff) as n, case when greatest(n_hidden, n_diff) < 1 then '—' when n_hidden >= n_diff then '숨은정답' else '정답지차분' end as method,
  case when greatest(n_hidden, n_diff) >= 25 then '완전자동' when greatest(n_hidden, n_diff) >= 10 then '대부분자동' when greatest(n_hidden, n_diff) >= 1 then '일부만' else '수동' end as bucket,
  case when greatest(n_hidden, n_diff) >= 25 then 2 when greatest(n_hidden, n_diff) >= 10 then 5 when greatest(n_hidden, n_diff) >= 1 then 12 else 20 end as minutes from {UNITS} u)"""


@query("extraction_units", f"with {AUDIT} select unit_id, n, method, bucket, minutes from au")
def _(t):
    return L.extraction_audit(t.sql(f"select * from {UNITS} u")).select("unit_id", "n", "method", "bucket", "minutes")


@query("extraction_audit", f"""with {AUDIT} select level, count(*) as units, count(*) filter (where bucket = '완전자동') as "full", count(*) filter (where bucket = '대부분자동') as mostly, count(*) filter (where bucket = '일부만') as partly, count(*) filter (where bucket = '수동') as manual,
  cast(sum(n) as bigint) as answers, cast(sum(minutes) as bigint) as minutes from au group by rollup (level)""")
def _(t):
    return L.extraction_rollup(L.extraction_audit(t.sql(f"select * from {UNITS} u")))


# --- rules that take things in order: recursive SQL goes one by one ----------------------------------------

NOISE_SQL = "(regexp_matches({c}, '^[\\s.,)(\\]\\[:;\\-–—~∙*※→…]+$') or length(trim({c})) < 1)"


def fill_sql(blanks: str, tokens: str) -> str:
    """CTEs that end in ``filled``: blanks take tokens in order."""
    return f"""
  wish as (select b.doc_id, b.block, b.page, b.pos as blank_pos, any_value(b.text) as removed, row_number() over (partition by b.doc_id, b.block, b.page order by b.pos) as nth,
      list(struct_pack(p := t.pos, noise := {NOISE_SQL.format(c="t.text")}, text := t.text, x := t.x, y := t.y, w := t.w, h := t.h) order by abs(t.x - b.x), t.pos) as w
    from {blanks} b join {tokens} t on t.doc_id = b.doc_id and t.block = b.block and t.page = b.page and abs(t.y - b.y) < 0.02e0 group by 1, 2, 3, 4),
  fill as (select distinct doc_id, block, page, 0::bigint as nth, []::bigint[] as used, null::bigint as blank_pos, null::varchar as removed, w[1:0][1] as pick from wish where nth = 1
    union all select doc_id, block, page, nth, case when pick.noise then used else list_append(used, pick.p) end, blank_pos, removed, pick
      from (select f.doc_id, f.block, f.page, w.nth, f.used, w.blank_pos, w.removed, list_filter(w.w, lambda c: not list_contains(f.used, c.p))[1] as pick
            from fill f join wish w on w.doc_id = f.doc_id and w.block = f.block and w.page = f.page and w.nth = f.nth + 1) z),
  filled as (select doc_id, block, blank_pos, pick.p as token_pos, page, trim(pick.text) as answer, removed, pick.x as x, pick.y as y, pick.w as w, pick.h as h
    from fill where pick is not null and not pick.noise)"""


# Every 20 words of a turn start a change: the exam has five old words, every other time with blanks, for eight new ones.
EXAM = """(select doc_id, cast(blk * 17 + case when k < 5 then k else k - 3 end as int) as pos, page, case when k < 5 and k % 3 = 1 and blk % 2 = 0 then '____' when k < 5 then concat(text, '~') else text end as text, x, y, w, h
  from (select *, pos % 20 as k, cast(floor(pos / 20.0e0) as bigint) as blk from fx_words) q where k < 5 or k >= 8)"""
CHANGES = f"""ex as (select * from {EXAM} e), sizes as (select doc_id, count(*) as nk from fx_words group by 1), exams as (select doc_id, count(*) as ne from ex group by 1),
  met as (select a.doc_id, a.pos as i, b.pos as j from ex a join fx_words b on b.doc_id = a.doc_id and b.text = a.text),
  runs as (select doc_id, min(i) as si, min(j) as sj, count(*)::int as n from (select *, i - row_number() over (partition by doc_id, j - i order by i) as g from met) m group by doc_id, j - i, g),
  piece as (select doc_id, 0 as a0, coalesce(ne, 0)::int as a1, 0 as b0, nk::int as b1, null::struct(n int, i int, j int) as m, 0 as k from sizes left join exams using (doc_id)
    union all select doc_id, case when side.k = 0 then a0 else m.n - m.i end::int, case when side.k = 0 then -m.i else a1 end::int, case when side.k = 0 then b0 else m.n - m.j end::int, case when side.k = 0 then -m.j else b1 end::int, m, side.k
      from (select p.doc_id, a0, a1, b0, b1, max(struct_pack(n := (least(a1 - si, b1 - sj, n) - greatest(a0 - si, b0 - sj, 0))::int, i := (-si - greatest(a0 - si, b0 - sj, 0))::int, j := (-sj - greatest(a0 - si, b0 - sj, 0))::int)) as m
            from piece p join runs r on r.doc_id = p.doc_id and least(a1 - si, b1 - sj, n) - greatest(a0 - si, b0 - sj, 0) > 0 group by 1, 2, 3, 4, 5) best cross join (select unnest([0, 1]) as k) side),
  blocks as (select doc_id, -m.i as i, -m.j as j, m.n as n from piece where m is not null and k = 0 union all select doc_id, ne::int, nk::int, 0 from sizes left join exams using (doc_id)),
  chain as (select doc_id, coalesce(lag(i + n) over d, 0) as i1, coalesce(i, 0) as i2, coalesce(lag(j + n) over d, 0) as j1, j as j2 from blocks window d as (partition by doc_id order by j, n desc)),
  changed as (select doc_id, i1::bigint as i1, i2::bigint as i2, j1::bigint as j1, j2::bigint as j2 from chain where j2 > j1)"""


@query("sequence_changes", f"with recursive {CHANGES} select doc_id, i1, i2, j1, j2 from changed")
def _(t):
    return D.sequence_changes(t.sql(f"select * from {EXAM} e"), t.words)


@query("token_diff_answers", f"""with recursive {CHANGES},
  gone as (select c.doc_id, c.j1 as block, e.* exclude (doc_id) from changed c join ex e on e.doc_id = c.doc_id and e.pos >= i1 and e.pos < i2),
  added as (select c.doc_id, c.j1 as block, e.* exclude (doc_id) from changed c join fx_words e on e.doc_id = c.doc_id and e.pos >= j1 and e.pos < j2),
  blanks as (select * from gone where regexp_matches(text, '_{{2,}}')), {fill_sql("blanks", "added")},
  rest as (select * from added a where not exists (select 1 from filled f where f.doc_id = a.doc_id and f.block = a.block)),
  lg as (select *, lag(page) over d as pp, lag(y) over d as py from rest window d as (partition by doc_id, block order by pos)),
  ln as (select *, cast(sum(case when pp is null or page <> pp or abs(y - py) > 0.008e0 then 1 else 0 end) over (partition by doc_id, block order by pos) as bigint) as line from lg),
  texts as (select doc_id, block, string_agg(text, ' ' order by pos) as removed from gone group by 1, 2)
  select doc_id, block, blank_pos as place, 0::bigint as part, page, answer, removed, true as from_blank, x, y, w, h from filled
  union all select l.doc_id, l.block, line, 0::bigint, min(page), trim(string_agg(text, ' ' order by pos)), trim(coalesce(any_value(removed), '')), false, {BOX_SQL}
    from ln l left join texts g on g.doc_id = l.doc_id and g.block = l.block group by 1, 2, 3 having count(*) filter (where not {NOISE_SQL.format(c="text")}) > 0""")
def _(t):
    return L.token_diff_answers(t.sql(f"select * from {EXAM} e"), t.words)


@query("answers_per_page", f"""with sp as (select * from {SPANS} s where color >= 15790320 and not regexp_matches(trim(text), '^[\\s.,)(\\]\\[:;\\-–—~∙*※→…/]+$')), {GROUPS},
  an as (select distinct doc_id, page, line, grp from gr) select doc_id, page, count(*) as n from an group by 1, 2""")
def _(t):
    return L.answers_per_page(L.hidden_span_answers(t.sql(f"select * from {SPANS} s"), t.sql(f"select * from {SIZES} z")))


BLANKS = "(select doc_id, cast(floor(pos / 25.0e0) as int) as block, page, pos, '____' as text, x, y, w, h from fx_words where pos % 7 = 3)"
SHIFTED = "(select doc_id, cast(floor(pos / 25.0e0) as int) as block, page, pos, text, x + 0.031e0 * (pos % 3) as x, y, w, h from fx_words where pos % 3 <> 1)"


@query("nearest_blank_fill", f"with recursive bl as (select * from {BLANKS} b), tk as (select * from {SHIFTED} s), {fill_sql('bl', 'tk')} select * from filled")
def _(t):
    return L.nearest_blank_fill(t.sql(f"select * from {BLANKS} b"), t.sql(f"select * from {SHIFTED} s"))


HALF = "(select doc_id, page, pos, round(x + 0.0017e0 * (pos % 5), 4) as x, round(y + 0.0023e0 * (pos % 3), 4) as y, w, h from fx_words where pos % 2 = 0)"
DOUBLED = f"(select * from {HALF} a union all select doc_id, page, pos + 100000, round(x + 0.002e0, 4), round(y + 0.003e0, 4), w, h from {HALF} b)"


@query("dedupe_regions", f"""with recursive one as (select doc_id, page, y, x, min_by(struct_pack(pos, w, h), pos) as r from {DOUBLED} d group by 1, 2, 3, 4),
  nth as (select *, row_number() over (partition by doc_id, page order by y, x) as k from one),
  kept as (select distinct doc_id, page, 0::bigint as k, []::struct(y double, x double)[] as held, false as stays, null::double as y, null::double as x, null::struct(pos int, w double, h double) as r from nth
    union all select doc_id, page, k, case when free then list_append(held, struct_pack(y, x)) else held end, free, y, x, r
      from (select n.*, list_filter(p.held, lambda c: n.y - c.y < 0.004e0) as held, len(list_filter(p.held, lambda c: abs(n.y - c.y) < 0.004e0 and abs(n.x - c.x) < 0.004e0)) = 0 as free
            from kept p join nth n on n.doc_id = p.doc_id and n.page = p.page and n.k = p.k + 1) z)
  select doc_id, page, r.pos as pos, x, y, r.w as w, r.h as h from kept where stays""")
def _(t):
    return L.dedupe_regions(t.sql(f"select * from {DOUBLED} d"))
