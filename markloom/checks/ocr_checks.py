"""Recognition benchmark, file reader and writer, and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.checks.registry import query
from markloom.functions import files as FF
from markloom.operators import agreement, costs, ocr, usage
from markloom.session import scratch_path
from markloom.sources import readers, writers
from markloom.streaming import jobs

LABELS = """lab as (select *, case when g not in ('good', 'fair', 'poor', 'blank') then 'skipped' when g <> 'blank' and tr = '' then 'pending' else 'labeled' end as state
  from (select *, lower(trim(grade)) as g, trim(truth) as tr, case when truth_source = '' then 'typed' else trim(truth_source) end as src from fx_manifest) m)"""


def labeled(t):
    return ocr.label_manifest(t.manifest)


@query("read_label_manifest", f"with {LABELS} select state, g as grade, src as truth_source, count(*) as n from lab group by 1, 2, 3")
def _(t):
    path = scratch_path(t.spark, "manifest")
    t.manifest.write.option("header", True).option("emptyValue", "").csv(path)
    raw = readers.read_label_manifest(t.spark, path).na.fill("")
    return ocr.label_manifest(raw).groupBy("state", "grade", "truth_source").agg(F.count("*").alias("n"))


ACCEPTED = "acc as (select distinct row_id, trim(c) as a from (select row_id, unnest(string_split(candidates, '|')) as c from fx_manifest) z where trim(c) <> '')"
SCORED = f"""{LABELS}, {ACCEPTED}, sc as (select o.*, l.g as grade, tr as truth, src = 'assumed' as assumed, lower(tr) = lower(trim(o.text)) as exact,
    lower(tr) <> '' and exists (select 1 from acc where acc.row_id = l.row_id and lower(a) = lower(tr)) as tok,
    lower(trim(o.text)) <> '' and exists (select 1 from acc where acc.row_id = l.row_id and lower(a) = lower(trim(o.text))) as pok
  from fx_ocr o join lab l on l.row_id = o.row_id where state = 'labeled'),
  scored as (select mode, row_id, call_id, text, grade, truth, latency_ms, in_tok, out_tok, error, assumed, exact, tok as truth_correct, pok as pred_correct, not legible as unreadable, legible and not exact as misread,
    not tok and pok as lenient, tok and not pok as harsh from sc)"""


def scored(t):
    return ocr.ocr_score_rows(labeled(t).filter("state = 'labeled'"), t.ocr)


@query("ocr_score_rows", f"with {SCORED} select call_id, row_id, grade, truth, assumed, exact, truth_correct, pred_correct, unreadable, misread, lenient, harsh from scored")
def _(t):
    return scored(t).select("call_id", "row_id", "grade", "truth", "assumed", "exact", "truth_correct", "pred_correct", "unreadable", "misread", "lenient", "harsh")


RATES = ("exact", "unreadable", "misread", "lenient", "harsh")


@query("ocr_report", f"""with {SCORED} select mode, case when grouping(grade) = 1 then 'all' else grade end as grade, count(*) as n,
  {', '.join(f'round(count(*) filter (where {c}) * 100.0e0 / count(*), 4) as {c}' for c in RATES)}, round(median(latency_ms) filter (where latency_ms > 0) / 1000, 4) as median_seconds
  from scored group by grouping sets ((mode, grade), (mode))""")
def _(t):
    report = ocr.ocr_report(scored(t))
    return report.withColumns({c: F.round(c, 4) for c in (*RATES, "median_seconds")})


@query("ocr_gate", f"""with {SCORED}, g as (select mode, count(*) filter (where exact) / count(*)::double as a, count(*) filter (where misread) / count(*)::double as m from scored where grade <> 'blank' group by 1)
  select mode, round(a, 6) as accuracy, round(m, 6) as misread_rate, a >= 0.95 and m < 0.01 as ok from g""")
def _(t):
    return ocr.ocr_gate(scored(t)).withColumns({"accuracy": F.round("accuracy", 6), "misread_rate": F.round("misread_rate", 6)})


@query("leniency_report", f"""with {SCORED}, w as (select * from scored where truth <> '' and not truth_correct),
  e as (select mode, string_agg(concat(truth, '→', text), ', ' order by call_id) as ex from (select *, row_number() over (partition by mode order by call_id) as rn from w where pred_correct) z where rn <= 3 group by 1)
  select w.mode, count(*) as wrong_written, count(*) filter (where pred_correct) as read_as_right, coalesce(any_value(ex), '—') as examples from w left join e on e.mode = w.mode group by 1""")
def _(t):
    return ocr.leniency_report(scored(t))


@query("assumed_label_conflicts", f"with {SCORED} select mode, count(*) filter (where assumed and not exact) as conflicts from scored group by 1")
def _(t):
    return ocr.assumed_label_conflicts(scored(t))


@query("ocr_cost", f"""with {SCORED} select mode, count(*) as n, count(error) as errors, round((sum(in_tok) * 5.0e0 + sum(out_tok) * 25.0e0) / 1000000 * 0.5e0, 6) as cost_usd from scored group by 1""")
def _(t):
    cost = ocr.ocr_cost(scored(t), costs.price_table(t.spark), "claude-opus-5", batched=True)
    return cost.select("mode", "n", "errors", F.round("cost_usd", 6).alias("cost_usd"))


@query("answer_pool", f"with {ACCEPTED} select distinct a as accepted from acc")
def _(t):
    return ocr.answer_pool(t.manifest)


@query("accepted_set", f"with {ACCEPTED} select row_id, a as accepted from acc")
def _(t):
    return ocr.accepted_rows(t.manifest)


@query("canonical", "select row_id, trim(case when row_id % 3 = 0 then split_part(concat(' ', candidates), '|', 1) else answer end) as canonical from fx_manifest")
def _(t):
    answer = F.when(F.col("row_id") % 3 != 0, F.col("answer"))
    return t.manifest.select("row_id", ocr.canonical(answer, F.concat(F.lit(" "), "candidates")).alias("canonical"))


SPECS = """(select p_brand as student, case when min(p_partkey) % 2 = 0 then 'fair' else 'poor' end as grade,
  concat(cast(min(p_partkey) % 9 + 1 as varchar), ',', cast(min(p_partkey) % 5 + 10 as varchar), '-', cast(min(p_partkey) % 5 + 14 as varchar), ', ,30-28') as wrong,
  concat(cast(min(p_partkey) % 7 + 20 as varchar), ' - ', cast(min(p_partkey) % 7 + 22 as varchar)) as blank from part group by p_brand having min(p_partkey) % 4 <> 1)"""
RANGES = """rg as (select student, 'wrong' as what, cast(n as varchar) as no from (select student, unnest(list_concat([k % 9 + 1], generate_series(k % 5 + 10, k % 5 + 14))) as n from ks) z
  union select student, 'blank', cast(n as varchar) from (select student, unnest(generate_series(k % 7 + 20, k % 7 + 22)) as n from ks) z)"""
KS = "ks as (select p_brand as student, min(p_partkey) as k from part group by 1 having min(p_partkey) % 4 <> 1)"


@query("expand_number_ranges", f"with {KS}, {RANGES} select student, no from rg where what = 'wrong'")
def _(t):
    specs = t.sql(f"select student, wrong from {SPECS} s")
    return ocr.expand_number_ranges(specs, "wrong")


BROKEN = "(select p_brand as student, concat('4,', case when min(p_partkey) % 2 = 0 then ' 1-2-3 ' else '5-7' end, ',x-9, 8 - 11') as wrong from part group by p_brand)"


@query("unreadable_ranges", f"select student, unnest(case when contains(wrong, '1-2-3') then ['1-2-3', 'x-9'] else ['x-9'] end) as part from {BROKEN} b")
def _(t):
    return ocr.unreadable_ranges(t.sql(f"select * from {BROKEN} b"), "wrong")


FILL = f"""{KS}, {RANGES}, fl as (select m.*, case when ks.k % 2 = 0 then 'fair' else 'poor' end as sg,
    case when ks.k is null then 'untouched' when truth_source = 'typed' then 'skipped' when b.no is not null then 'blank' when w.no is not null then 'to_type' else 'assumed' end as action
  from fx_manifest m left join ks on ks.student = m.student left join rg b on b.student = m.student and b.no = m.question and b.what = 'blank' left join rg w on w.student = m.student and w.no = m.question and w.what = 'wrong'),
  ft as (select row_id, student, action, case action when 'skipped' then truth when 'untouched' then truth when 'assumed' then answer else '' end as truth, case action when 'skipped' then grade when 'untouched' then grade when 'blank' then 'blank' else sg end as grade,
    case action when 'skipped' then truth_source when 'untouched' then truth_source when 'to_type' then '' else 'assumed' end as truth_source, answer from fl)"""


def filled(t):
    return ocr.fill_truth(t.manifest, t.sql(f"select * from {SPECS} s"))


@query("fill_truth", f"with {FILL} select row_id, action, truth, grade, truth_source from ft")
def _(t):
    return filled(t).select("row_id", "action", "truth", "grade", "truth_source")


@query("label_fill_stats", f"with {FILL} select student, action, count(*) as n from ft group by 1, 2")
def _(t):
    return ocr.label_fill_stats(filled(t))


@query("todo_list", f"with {FILL} select row_id, student, answer as canonical from ft where trim(truth) = '' and trim(grade) not in ('blank', '') order by row_id limit 40")
def _(t):
    return ocr.todo_list(filled(t))[0].select("row_id", "student", "canonical")


@query("todo_counts", f"""with {FILL} select count(*) filter (where trim(truth) = '' and trim(grade) not in ('blank', '')) as pending, count(*) filter (where trim(grade) = '') as unlabeled,
  greatest(0, count(*) filter (where trim(truth) = '' and trim(grade) not in ('blank', '')) - 40) as not_shown from ft""")
def _(t):
    return ocr.todo_list(filled(t))[1]


# --- files ------------------------------------------------------------------------------------------


@query("read_run_json", """select sheet_id as pair_no, title, cast(printed_total as bigint) as n_items, case when sheet_id % 50 = 0 then 'failed' else 'ok' end as state from fx_sheets""")
def _(t):
    path = scratch_path(t.spark, "runs")
    failed = F.when(F.col("sheet_id") % 50 == 0, F.lit("timeout"))
    rows = t.sheets.select(
        F.col("sheet_id").alias("pair_no"), F.struct("title", F.lit("T").alias("teacher"), "cut_line").alias("sheet"),
        F.col("printed_total").alias("n_items"), failed.alias("error"),
    )
    # indented lists of some 200 runs a file
    lists = rows.groupBy(F.floor(F.col("pair_no") / 800).alias("part")).agg(F.collect_list(F.struct(*rows.columns)).alias("runs"))
    lists.select("part", F.to_json("runs", {"pretty": "true"}).alias("value")).write.partitionBy("part").text(path)
    done, bad = readers.read_run_json(t.spark, path)
    ok = done.select("pair_no", F.col("sheet.title").alias("title"), "n_items", F.lit("ok").alias("state"))
    heads = t.sheets.select(F.col("sheet_id").alias("pair_no"), "title", F.col("printed_total").cast("bigint").alias("n_items"))
    return ok.unionByName(bad.join(heads, "pair_no").select("pair_no", "title", "n_items", F.lit("failed").alias("state")))


@query("rename_short_keys", """select sheet_id, no, prompt, direction, case when seq % 3 = 0 then prefix end as prefix, written, blank from fx_items""")
def _(t):
    short = F.struct(
        F.col("no").alias("n"), F.col("prompt").alias("p"), F.col("direction").alias("d"), F.when(F.col("seq") % 3 == 0, F.col("prefix")).alias("x"),
        F.col("written").alias("w"), F.col("blank").alias("b"), F.lit(0.5).alias("confidence"),
    )
    rows = t.items.select("sheet_id", F.inline(readers.expand_short_items(F.to_json(F.array(short)))))
    return rows.select("sheet_id", "no", "prompt", "direction", "prefix", "written", "blank")


@query("pick_items", """select i.sheet_id, i.seq, i.no, i.written from fx_items i
  join (select coalesce(a.sheet_id, b.sheet_id) as sheet_id, coalesce(a.no, b.no) as no, coalesce(w, false) as w, b.no is not null as m, a.no is not null as k from (select sheet_id, no, bool_or(not coalesce(correct, false)) as w from fx_items group by 1, 2) a
    full outer join (select distinct sheet_id, trim(mark_no) as no from fx_marks) b on a.sheet_id = b.sheet_id and a.no = b.no) d on d.sheet_id = i.sheet_id and d.no = i.no where k and w <> m""")
def _(t):
    pairs = agreement.symmetric_difference(t.items, t.marks)
    return readers.pick_items(t.items, pairs=pairs).select("sheet_id", "seq", "no", "written")


@query("write_summary_report", """select concat('| ', sheet_id, ' | ', title, ' | ', status, ' | ', coalesce(verdict, '–'), ' |') as value from fx_sheets""")
def _(t):
    path = scratch_path(t.spark, "summary")
    writers.write_summary_report(t.sheets.select("sheet_id", "student_name", "title", "status", "verdict"), path)
    return t.spark.read.text(path)


EXAM_ROWS = """(select p_size as exam_id, p_partkey, cast(row_number() over (partition by p_size order by p_partkey) as int) as number, p_name as answer from part)"""


@query("write_exam_template", f"""select printf('BJ-L%d-CH%02d', cast(exam_id % 3 as int), cast(exam_id as int)) as code, concat('Unit ', exam_id) as name, cast(number as varchar) as number, answer as canonical from {EXAM_ROWS} e""")
def _(t):
    from markloom.operators.sequences import position

    rows = t.sql("select p_size as exam_id, p_partkey, p_name as answer from part")
    placed = position(rows, ["exam_id"], ["p_partkey"], F.floor(F.col("p_partkey") / 4096), "number").withColumn("number", (F.col("number") + 1).cast("int"))
    answers = placed.withColumns({"page": F.lit(1), "x": F.lit(0.1), "y": F.lit(0.2), "w": F.lit(0.3), "h": F.lit(0.01)})
    exams = rows.select("exam_id").distinct().select(
        "exam_id", F.concat(F.lit("Level "), (F.col("exam_id") % 3).cast("string")).alias("level"), F.col("exam_id").alias("chapter"),
        F.concat(F.lit("문법 Ch."), "exam_id", F.lit(". Unit "), "exam_id", F.lit(" 시험지.pdf")).alias("file"), F.lit("hidden_white").alias("method"),
    )
    pages = exams.select("exam_id", F.lit(1).alias("page"), F.lit(595.3).alias("width"), F.lit(841.9).alias("height"))
    path = scratch_path(t.spark, "templates")
    writers.write_exam_templates(writers.exam_templates(answers, exams, pages), path)
    back = t.spark.read.json(path)
    return back.select("code", "name", F.explode("questions").alias("q")).select("code", "name", "q.number", F.col("q.key.canonical").alias("canonical"))


CHAPTERS = "(select p_partkey as id, concat('Level ', cast(p_size % 4 as varchar)) as level, concat('문법 ', case when p_partkey % 3 = 0 then 'ch_' when p_partkey % 3 = 1 then 'Ch. ' else 'Part' end, cast(p_size as varchar), '. ', p_name, ' 시험지.pdf') as file from part)"


@query("chapter_code", f"""select id, case when id % 3 <> 2 then printf('BJ-%s-CH%02d', replace(replace(level, ' ', ''), 'Level', 'L'), cast(regexp_extract(file, '[Cc]h\\s*\\.?\\s*_?\\s*(\\d{{1,2}})', 1) as int)) end as code from {CHAPTERS} c""")
def _(t):
    df = t.sql(f"select * from {CHAPTERS} c").withColumn("ch", FF.chapter_number(F.col("file")))
    return df.select("id", F.when(F.col("ch").isNotNull(), FF.chapter_code(F.col("level"), F.col("ch"))).alias("code"))


# --- streaming ------------------------------------------------------------------------------------------


def event_stream(t):
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


HOURS = "(values (1, 13, 23), (2, 13, 23), (3, 13, 23), (4, 13, 23), (5, 13, 23), (6, 13, 23)) as h(dow, s, e)"


@query("stream_usage_by_hour", f"""select cast(r.i as int) as hour, count(event_id) as total, count(event_id) filter (where s is null or hr < s or hr >= e) as off from range(24) r(i)
  left join (select event_id, dayofweek(ts + interval '9' hour) as dow, hour(ts + interval '9' hour) as hr from events) v on v.hr = r.i left join {HOURS} on h.dow = v.dow group by 1""")
def _(t):
    events = event_stream(t).select("event_id", F.col("ts").alias("created_at"))
    return jobs.stream_usage_by_hour(t.spark, events, usage.hours_table(t.spark))


@query("stream_first_ref_wins", "select distinct concat(event_type, '|', cast(user_id as varchar)) as fingerprint from events")
def _(t):
    refs = event_stream(t).select(F.concat("event_type", F.lit("|"), F.col("user_id").cast("string")).alias("fingerprint"), "event_id")
    return jobs.stream_first_ref_wins(t.spark, refs).select("fingerprint")


STATUS = "case event_type when 'view' then 'queued' when 'click' then 'running' when 'purchase' then 'graded' when 'signup' then 'cancelled' else 'failed' end"


@query("stream_latest_status", f"""with l as (select user_id, {STATUS} as status, ts, event_id from events),
  f as (select user_id, case when max_by(status, {{'t': ts, 'e': event_id}}) filter (where status in ('uploading', 'queued', 'running', 'cancelled')) = 'cancelled' then 'cancelled' else max_by(status, {{'t': ts, 'e': event_id}}) end as status, count(*) as changes from l group by 1)
  select status, count(*) as sheets, cast(sum(changes) as bigint) as changes from f group by 1""")
def _(t):
    changes = event_stream(t).select(F.col("user_id").alias("sheet_id"), F.expr(STATUS).alias("status"), F.col("ts").alias("changed_at"), F.col("event_id").alias("change_id"))
    return jobs.stream_latest_status(t.spark, changes)
