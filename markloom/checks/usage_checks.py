"""Usage, token and cost queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom import constants as K
from markloom.checks.registry import query
from markloom.functions import clock, money
from markloom.operators import costs as C
from markloom.operators import usage as U

HOURS = "(values (1, 13, 23), (2, 13, 23), (3, 13, 23), (4, 13, 23), (5, 13, 23), (6, 13, 23)) as h(dow, s, e)"
OFF = f"""ev as (select u.*, cast(dayofweek(created_at + interval '9' hour) as int) as dow, cast(hour(created_at + interval '9' hour) as int) as hr from fx_usage u),
  off as (select ev.*, s is null or hr < s or hr >= e as off_hours from ev left join {HOURS} on h.dow = ev.dow)"""
STAFF = f"""with {OFF}, st as (select staff_id, count(*) as events, cast(sum(pages) as bigint) as pages, sum(cost_usd) as cost_usd, count(*) filter (where not ok) as failed,
  count(*) filter (where off_hours) as off_hours, coalesce(sum(cost_usd) filter (where off_hours), 0) as off_hours_cost, count(*) filter (where kind = 'grade') as n_grade,
  count(*) filter (where kind = 'quick') as n_quick, count(*) filter (where kind = 'trial') as n_trial, min(created_at) as first_at, max(created_at) as last_at from off group by 1)"""


def hours(t):
    return U.hours_table(t.spark)


def dbl(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("double"))
    return df


@query("usage_by_staff", STAFF + " select * replace (cast(cost_usd as double) as cost_usd, cast(off_hours_cost as double) as off_hours_cost) from st")
def _(t):
    return dbl(U.usage_by_staff(t.usage, hours(t)), "cost_usd", "off_hours_cost")


@query("usage_totals", STAFF + """ select cast(sum(events) as bigint) as events, cast(sum(pages) as bigint) as pages, cast(sum(cost_usd) as double) as cost_usd,
  cast(sum(off_hours) as bigint) as off_hours, cast(sum(off_hours_cost) as double) as off_hours_cost from st""")
def _(t):
    return dbl(U.usage_totals(U.usage_by_staff(t.usage, hours(t))), "cost_usd", "off_hours_cost")


BY_HOUR = f"""with {OFF} select cast(r.i as int) as hour, count(event_id) as total, count(event_id) filter (where off_hours) as off
  from range(24) r(i) left join off on off.hr = r.i group by 1"""


@query("usage_by_hour", BY_HOUR)
def _(t):
    return U.usage_by_hour(t.usage, hours(t))


@query("off_hours_events", f"with {OFF} select event_id, dow, hr as hour from off where off_hours")
def _(t):
    return U.off_hours_events(t.usage, hours(t)).select("event_id", "dow", "hour")


@query("recent_off_hours", f"with {OFF} select event_id, created_at from off where off_hours order by created_at desc, event_id desc limit 20")
def _(t):
    return U.recent_off_hours(t.usage, hours(t)).select("event_id", "created_at")


@query("kst_parts", f"with {OFF} select event_id, dow, hr as hour from ev")
def _(t):
    return t.usage.select("event_id", clock.kst_day(F.col("created_at")).alias("dow"), clock.kst_hour(F.col("created_at")).alias("hour"))


def _slots(bad: str) -> str:
    day = "concat('{\"start\":', cast(9 + c_custkey % 3 as varchar), ',\"end\":', cast(c_custkey % 26 as varchar), '}')"
    half = "concat('{\"start\":', cast(10 + c_custkey % 2 as varchar), '.5,\"end\":18}')"
    return f"""(select c_custkey as staff_id, case when c_custkey % 10 = 3 then '{bad}' when c_custkey % 10 = 4 then '[null,null]' when c_custkey % 10 = 5 then '[null,null,null,null,null,null,null]'
      else concat('[null,', {day}, ',', {half}, ',', {half}, ',null,', {day}, ',', {half}, ']') end as work_hours from customer)"""


SLOTS = _slots("{\"start\":1}")
VALID = "(c_custkey % 10 = 5 or (c_custkey % 10 not in (3, 4) and 9 + c_custkey % 3 < c_custkey % 26 and c_custkey % 26 <= 24))"


@query("normalize_hours", f"""select c_custkey as staff_id, {VALID} as valid, case when {VALID} and c_custkey % 10 <> 5 then 9.0e0 + c_custkey % 3 end as monday,
  case when {VALID} and c_custkey % 10 <> 5 then 10.5e0 + c_custkey % 2 end as tuesday from customer""")
def _(t):
    df = U.normalize_hours(t.sql(f"select * from {SLOTS} s"))
    return df.select("staff_id", F.col("hours").isNotNull().alias("valid"), F.expr("hours[1].start").alias("monday"), F.expr("hours[2].start").alias("tuesday"))


@query("describe_hours", f"""select c_custkey as staff_id, case when c_custkey % 10 = 5 then '근무일이 없습니다'
    else concat('월·금 ', printf('%02d', cast(9 + c_custkey % 3 as int)), ':00~', printf('%02d', cast(c_custkey % 26 as int)), ':00 · 화·수·토 ', 10 + c_custkey % 2, '.5:00~18:00') end as text
  from customer where {VALID}""")
def _(t):
    valid = U.normalize_hours(t.sql(f"select * from {SLOTS} s")).filter("hours is not null")
    return U.describe_hours(U.hours_rows(valid, ["staff_id"]), ["staff_id"], valid)


STAFF_DIM = """(select c_custkey as staff_id, c_name as name, c_custkey % 4 <> 0 as active from customer where c_custkey % 3 <> 0)"""


@query("staff_names", f"select event_id, coalesce(name, '(지워진 직원)') as staff_name from fx_usage u left join {STAFF_DIM} s on s.staff_id = u.staff_id")
def _(t):
    return U.staff_names(t.usage, t.sql(f"select * from {STAFF_DIM} s")).select("event_id", "staff_name")


@query("staff_order", f"select staff_id, name, active from {STAFF_DIM} s order by active desc, name")
def _(t):
    return U.staff_order(t.sql(f"select * from {STAFF_DIM} s"))


RECENT = """(select user_id, case when event_id % 5 = 0 then ' ' when event_id % 2 = 0 then concat(' ', upper(event_type), cast(event_id % 3 as varchar)) else concat(event_type, cast(event_id % 3 as varchar)) end as value,
  ts as used_at, event_id as entry_id from events)"""


@query("recent_values", f"""with d as (select *, row_number() over (partition by user_id, lower(trim(value)) order by used_at desc, entry_id desc) as r from {RECENT} e where trim(value) <> ''),
  p as (select *, row_number() over (partition by user_id order by used_at desc, entry_id desc) as place from d where r = 1)
  select user_id, cast(place as int) as place, trim(value) as value from p where place <= 6""")
def _(t):
    return U.recent_values(t.sql(f"select * from {RECENT} e"))


PRICES = "(values " + ", ".join(f"('{m}', {i}::double, {o}::double)" for m, _p, i, o, _e in K.MODEL_CATALOG) + ") as p(model, pin, pout)"


@query("call_cost", f"""select sheet_id, pos, round((((input_tokens + cache_read * 0.1e0) + cache_write * 1.25e0) * pin + output_tokens * pout) / 1000000, 9) as cost_usd
  from fx_calls c left join {PRICES} on p.model = c.model""")
def _(t):
    return C.call_cost(t.calls, C.price_table(t.spark)).select("sheet_id", "pos", F.round("cost_usd", 9).alias("cost_usd"))


@query("sheet_cost", f"""select sheet_id, round(case when count(*) = count(pin) then sum((input_tokens + cache_read * 0.1e0 + cache_write * 1.25e0) * pin + output_tokens * pout) end / 1000000, 10) as cost_usd
  from fx_calls c left join {PRICES} on p.model = c.model group by 1""")
def _(t):
    return C.sheet_cost(t.calls, C.price_table(t.spark)).withColumn("cost_usd", F.round("cost_usd", 10))


SPLIT = """sp as (select count(*) filter (where not j) as transcribe_calls, cast(coalesce(sum(i) filter (where not j), 0) as bigint) as transcribe_in, cast(coalesce(sum(output_tokens) filter (where not j), 0) as bigint) as transcribe_out,
    count(*) filter (where j) as judge_calls, cast(coalesce(sum(i) filter (where j), 0) as bigint) as judge_in, cast(coalesce(sum(output_tokens) filter (where j), 0) as bigint) as judge_out,
    count(distinct sheet_id) as sheets, cast(count(*) filter (where not j) as bigint) as pages
  from (select sheet_id, output_tokens, input_tokens + cache_read + cache_write as i, count(*) over (partition by sheet_id) > 1 and pos = max(pos) over (partition by sheet_id) as j from fx_calls) x)"""


@query("token_stage_split", f"with {SPLIT} select * from sp")
def _(t):
    return C.token_stage_split(t.calls)


@query("staged_calls", """select sheet_id, pos, case when count(*) over (partition by sheet_id) > 1 and pos = max(pos) over (partition by sheet_id) then 'judge' else 'transcribe' end as stage from fx_calls""")
def _(t):
    return C.staged_calls(t.calls).select("sheet_id", "pos", "stage")


IMG = f"""{SPLIT}, im as (select *, greatest(0, transcribe_in::double / transcribe_calls - 750) as ipp from sp),
  ms as (select sheets, pages, (select count(*) from fx_items) as items, ipp * pages as image_tokens, greatest(0, transcribe_in + judge_in - ipp * pages) as other_tokens, (transcribe_out + judge_out)::double as output_tokens from im)"""


@query("image_tokens_per_page", f"with {IMG} select round(ipp, 6) as image_per_page from im")
def _(t):
    return C.image_tokens(C.token_stage_split(t.calls)).select(F.round("image_per_page", 6).alias("image_per_page"))


def measured(t):
    return C.measured(C.token_stage_split(t.calls), t.items.agg(F.count("*").alias("items")))


PARTS = """select part, round(tokens, 4) as tokens, round(usd, 6) as usd, round(coalesce(usd / nullif(sum(usd) over (), 0), 0), 6) as share from (
  select 'image' as part, image_tokens as tokens, image_tokens * 5 / 1e6 as usd from {0} union all select 'other_input', other_tokens, other_tokens * 5 / 1e6 from {0}
  union all select 'output', output_tokens, output_tokens * 25 / 1e6 from {0}) z"""
SCALED = "sc as (select items * k as items, image_tokens * k as image_tokens, other_tokens * k as other_tokens, output_tokens * k as output_tokens from (select *, 12600.0e0 / pages as k from ms) z)"


def rounded(df):
    return df.select("part", F.round("tokens", 4).alias("tokens"), F.round("usd", 6).alias("usd"), F.round("share", 6).alias("share"))


@query("cost_breakdown", f"with {IMG} " + PARTS.format("ms"))
def _(t):
    return rounded(C.cost_breakdown(measured(t)))


@query("cost_projection", f"with {IMG}, {SCALED} " + PARTS.format("sc"))
def _(t):
    return rounded(C.cost_projection(measured(t)))


@query("cost_levers", f"""with {IMG}, {SCALED}, tt as (select image_tokens * 5 / 1e6 as img, (image_tokens * 5 + other_tokens * 5 + output_tokens * 25) / 1e6 as total from sc),
  lv as (select 'edge_2576_1800' as lever, img * (1 - (1800.0e0 / 2576) * (1800.0e0 / 2576)) as usd, total from tt union all select 'edge_2576_1288', img * 0.75e0, total from tt union all select 'compact_output', total * 0.076e0, total from tt)
  select lever, round(usd, 4) as usd, cast(floor(usd * 1415 + 0.5) as bigint) as krw, round(usd / total, 6) as share from lv""")
def _(t):
    return C.cost_levers(measured(t)).withColumn("usd", F.round("usd", 4)).withColumn("share", F.round("share", 6))


@query("cost_unit_rates", f"""with {IMG}, c as (select sum(cost_usd) as spent from fx_sheets)
  select sheets, pages, items, round(items::double / pages, 6) as items_per_page, round(spent::double / sheets, 6) as cost_per_sheet, cast(floor(output_tokens / greatest(1, items) + 0.5) as bigint) as output_per_item, sheets < 30 as small_sample from ms, c""")
def _(t):
    rates = C.cost_unit_rates(measured(t), t.sheets.agg(F.sum("cost_usd").alias("cost_usd")))
    return rates.withColumn("items_per_page", F.round("items_per_page", 6)).withColumn("cost_per_sheet", F.round("cost_per_sheet", 6))


@query("image_size_stats", """with e as (select greatest(width, height)::bigint as edge, width::bigint * height as px from fx_photos),
  r as (select edge, row_number() over (order by edge) - 1 as i, count(*) over () as n from e)
  select (select edge from r where i = n // 2) as median_edge, (select round(avg(px) / 750, 6) from e) as mean_image_tokens""")
def _(t):
    return C.image_size_stats(t.photos).withColumn("mean_image_tokens", F.round("mean_image_tokens", 6))


@query("median_latency", "select round(median(ms) / 1000, 6) as seconds from (select sum(latency_ms) as ms from fx_calls group by sheet_id) z where ms > 0")
def _(t):
    return C.median_latency(t.calls).withColumn("seconds", F.round("seconds", 6))


@query("queue_wait", """with s as (select median(ms) / 1000 as seconds from (select sum(latency_ms) as ms from fx_calls group by sheet_id) z where ms > 0),
  w as (select class_name, count(*) filter (where status in ('queued', 'running')) as waiting from fx_sheets group by 1),
  x as (select class_name, waiting, ceil(waiting / 4.0e0) * seconds as ws from w, s)
  select class_name, waiting, round(ws, 4) as wait_seconds, case when ws <= 0 then '' when ws < 90 then '1분 안' else concat('약 ', cast(ceil(ws / 60) as bigint), '분') end as wait_text from x""")
def _(t):
    out = C.queue_wait(t.sheets, C.median_latency(t.calls), 4, ["class_name"])
    return out.select("class_name", "waiting", F.round("wait_seconds", 4).alias("wait_seconds"), "wait_text")


@query("money_words", """select o_orderkey as sheet_id, cast(floor(o_totalprice * 1415 + 0.5) as bigint) as krw, case when o_orderkey % 9 <> 0 then printf('%.1f%%', (o_orderkey % 5)::double / (o_orderkey % 9) * 100) else '—' end as pct,
  case when o_orderkey % 700 <= 0 then '' when o_orderkey % 700 < 90 then '1분 안' else concat('약 ', cast(ceil((o_orderkey % 700) / 60.0e0) as bigint), '분') end as wait from orders""")
def _(t):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("sheet_id"), money.krw(F.col("o_totalprice")).alias("krw"), money.pct(k % 5, k % 9).alias("pct"), money.describe_wait(k % 700).alias("wait"))


@query("edge_factors", """select sheet_id, idx, width, height, round((1288.0e0 / greatest(width, height)) * (1288.0e0 / greatest(width, height)), 9) as edge_factor,
  round(case when 1288 >= greatest(width, height) then 1.0e0 else (1288.0e0 / greatest(width, height)) * (1288.0e0 / greatest(width, height)) end, 9) as token_factor,
  cast(case when greatest(width, height) <= 1288 then width else floor(width * (1288.0e0 / greatest(width, height)) + 0.5) end as bigint) as fit_width,
  cast(case when greatest(width, height) <= 1288 then height else floor(height * (1288.0e0 / greatest(width, height)) + 0.5) end as bigint) as fit_height from fx_photos""")
def _(t):
    w, h, edge = F.col("width"), F.col("height"), F.lit(1288)
    long_side = F.greatest(w, h)
    return t.photos.select(
        "sheet_id", "idx", "width", "height", F.round(money.edge_factor(long_side, edge), 9).alias("edge_factor"),
        F.round(money.token_factor(long_side, edge), 9).alias("token_factor"),
        money.fit_side(w, h, edge).alias("fit_width"), money.fit_side(h, w, edge).alias("fit_height"),
    )


LONG = "greatest(width, height)"
SQUARED = f"(1288.0e0 / {LONG}) * (1288.0e0 / {LONG})"


@query("edge_factor", f"select sheet_id, idx, width, height, round({SQUARED}, 9) as factor from fx_photos")
def _(t):
    factor = money.edge_factor(F.greatest("width", "height"), F.lit(1288))
    return t.photos.select("sheet_id", "idx", "width", "height", F.round(factor, 9).alias("factor"))


@query("token_factor", f"select sheet_id, idx, width, height, round(case when 1288 >= {LONG} then 1.0e0 else {SQUARED} end, 9) as factor from fx_photos")
def _(t):
    factor = money.token_factor(F.greatest("width", "height"), F.lit(1288))
    return t.photos.select("sheet_id", "idx", "width", "height", F.round(factor, 9).alias("factor"))


@query("fit_size", f"""select sheet_id, idx, cast(case when {LONG} <= 1288 then width else floor(width * (1288.0e0 / {LONG}) + 0.5) end as bigint) as width,
  cast(case when {LONG} <= 1288 then height else floor(height * (1288.0e0 / {LONG}) + 0.5) end as bigint) as height from fx_photos""")
def _(t):
    w, h, edge = F.col("width"), F.col("height"), F.lit(1288)
    return t.photos.select("sheet_id", "idx", money.fit_side(w, h, edge).alias("width"), money.fit_side(h, w, edge).alias("height"))


@query("krw", "select o_orderkey as sheet_id, cast(floor(o_totalprice * 1415 + 0.5) as bigint) as krw from orders")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("sheet_id"), money.krw(F.col("o_totalprice")).alias("krw"))


@query("pct", "select sheet_id, case when sheet_id % 9 <> 0 then printf('%.1f%%', (sheet_id % 5)::double / (sheet_id % 9) * 100) else '—' end as pct from fx_sheets")
def _(t):
    return t.sheets.select("sheet_id", money.pct(F.col("sheet_id") % 5, F.col("sheet_id") % 9).alias("pct"))


@query("describe_wait", """select sheet_id, case when sheet_id % 700 <= 0 then '' when sheet_id % 700 < 90 then '1분 안' else concat('약 ', cast(ceil((sheet_id % 700) / 60.0e0) as bigint), '분') end as wait from fx_sheets""")
def _(t):
    return t.sheets.select("sheet_id", money.describe_wait(F.col("sheet_id") % 700).alias("wait"))
