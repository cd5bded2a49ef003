"""Known cases of the grading rules."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions import clock, files, money, text, titles, verdicts
from markloom.operators import agreement, costs, drift, matching, pages, reference, roster, trials, usage, verdict

ITEM = "sheet_id long, seq long, no string, prompt string, direction string, prefix string, written string, blank boolean, legible boolean, confidence double, correct boolean, teacher_correct boolean, expected string, note string"


def items(spark, nos, sheet=1, **over):
    rows = []
    for seq, no in enumerate(nos):
        row = dict(
            sheet_id=sheet, seq=seq, no=str(no), prompt=f"p{no}", direction="en2ko", prefix="", written="뜻", blank=False, legible=True,
            confidence=0.9, correct=True, teacher_correct=None, expected="뜻", note="",
        )
        row.update({k: (v(seq) if callable(v) else v) for k, v in over.items()})
        rows.append(tuple(row[c.split()[0]] for c in ITEM.split(", ")))
    return spark.createDataFrame(rows, ITEM)


def sheets(spark, printed=0, pages_=1, cut="", missing=0, sheet=1, title="t"):
    return spark.createDataFrame(
        [(sheet, printed, pages_, cut, missing, "", title)],
        "sheet_id long, printed_total int, page_count int, cut_line string, missing int, transcript_cut string, title string",
    )


@pytest.mark.parametrize("cut,n,want", [
    ("-8 까지 pass", 50, 8), ("( -10%까지 PASS )", 48, 4), ("커트라인 -7개", 50, 7), ("/20(컷 -5)", 20, 5), ("-12칸", 60, 12),
    ("어법&구문 -3 까지 PASS", 15, 3), ("없음", 30, None), ("", 30, None), (None, 30, None), ("-5", 0, None),
])
def test_cut_line(one, cut, n, want):
    assert one(verdicts.parse_cut(F.lit(cut).cast("string"), F.lit(n))) == want


def test_verdict(one):
    v = lambda w, c: one(verdicts.verdict(F.lit(w), F.lit(c).cast("int")))
    assert (v(8, 8), v(9, 8), v(3, None)) == ("pass", "fail", None)


@pytest.mark.parametrize("raw,want", [
    ("  Accept ", "accept"), ("~ 때문에", "~ 때문에"), ("Ｕｎｉｔ　３３", "unit 33"), ("​a", " a"), ("a \t b", "a b"),
    ("ﬁne", "fine"), ("가́", "가́"), (None, ""),
])
def test_norm(one, raw, want):
    assert one(text.norm(F.lit(raw).cast("string"))) == want


def test_number_key(one):
    key = lambda s: one(text.num_key(F.lit(s)))
    assert (key("3)"), key(" 12"), key("A-3"), key("9" * 30)) == (3, 12, K.NO_NUMBER, K.NO_NUMBER)


def levels(spark, df, sh, key=None):
    return [(r.level, r.text) for r in drift.drift_warnings(df, sh, key).orderBy("check_no", "section").collect()]


def test_drift_clean_and_sections(spark):
    assert levels(spark, items(spark, range(1, 51)), sheets(spark, 50)) == []
    found = levels(spark, items(spark, [*range(1, 15), "1)", "2)", "3)"]), sheets(spark, 17))
    assert [level for level, _ in found] == ["info"]


def test_drift_duplicate_gap_total(spark):
    assert any("중복" in t for _, t in levels(spark, items(spark, [1, 2, 2]), sheets(spark)))
    assert ("drift", "1번째 묶음의 번호가 비었습니다: 3") in levels(spark, items(spark, [1, 2, 4, 5]), sheets(spark))
    assert any("인쇄된 문항 수" in t for _, t in levels(spark, items(spark, range(1, 53)), sheets(spark, 50)))
    half = levels(spark, items(spark, range(1, 48)), sheets(spark, 60))
    assert [level for level, _ in half] == ["incomplete"] and "뒷면" in half[0][1] and "47문항만" in half[0][1]
    both = levels(spark, items(spark, range(1, 47)), sheets(spark, 48, 2))
    assert "2장을 올렸는데" in both[0][1] and "2칸을 놓친 것이니 검수" in both[0][1]
    gone = levels(spark, items(spark, [n for n in range(1, 50) if n != 7]), sheets(spark, 50))
    assert {level for level, _ in gone} == {"drift"}


def test_gap_text_is_cut_at_fifteen_even_for_a_misread_number(spark):
    (_, t), *_ = levels(spark, items(spark, [1, 90000000]), sheets(spark))
    assert t.endswith("2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16 …")


def test_drift_prefix_and_language(spark):
    df = items(spark, [38, 39], direction="ko2en", prefix=lambda s: "pv"[s], written=lambda s: ("victim", "virtual")[s])
    assert any("38" in t and "첫 글자" in t for _, t in levels(spark, df, sheets(spark)))
    assert any("31(한글)" in t for _, t in levels(spark, items(spark, [31], direction="ko2en", written="제안"), sheets(spark)))
    assert levels(spark, items(spark, [3], written="~ 때문에"), sheets(spark)) == []


@pytest.mark.parametrize("n,wrong,printed,cut,want", [
    (47, 3, 60, "-8 까지 pass", (None, False, False, -5)), (46, 3, 48, "-6 까지 pass", ("pass", True, False, -3)),
    (50, 7, 0, "커트라인 -7개", ("pass", True, True, 0)), (50, 2, 0, "커트라인 -7개", ("pass", True, False, -5)),
])
def test_sheet_verdict(spark, n, wrong, printed, cut, want):
    df = items(spark, range(1, n + 1), correct=lambda s: s >= wrong)
    r = verdict.sheet_verdict(df, sheets(spark, printed, cut=cut)).first()
    assert (r.verdict, r.robust, r.near_boundary, r.margin) == want


def test_percent_cut_counts_printed_items(spark):
    assert verdict.sheet_verdict(items(spark, range(1, 47)), sheets(spark, 48, cut="-10%까지 PASS")).first().cut == 4


def test_unjudged_items_move_to_missing(spark):
    note = lambda s: K.UNJUDGED_MARK if s == 9 else ""
    flip = verdict.sheet_verdict(items(spark, range(1, 11), correct=lambda s: s > 1, note=note), sheets(spark, cut="-2")).first()
    safe = verdict.sheet_verdict(items(spark, range(1, 11), note=note), sheets(spark, cut="-5")).first()
    assert (flip.verdict, flip.missing, safe.verdict, safe.n) == (None, 1, "pass", 9)
    kept = verdict.sheet_verdict(items(spark, range(1, 11), correct=lambda s: s > 1, note=note), sheets(spark, cut="-2"), exclude_unjudged=False)
    assert kept.first().verdict == "pass"


def test_open_item_counts_again_once_a_person_judged_it(spark):
    sh = sheets(spark, cut="-2")
    df = items(spark, range(1, 11), correct=lambda s: None if s == 9 else s > 1, note=lambda s: K.UNJUDGED_MARK if s == 9 else "")
    assert verdict.recount_verdict(df, sh).first().verdict is None
    judged = df.withColumn("teacher_correct", F.when(F.col("seq") == 9, F.lit(True)))
    assert verdict.recount_verdict(judged, sh).first().verdict == "pass"


def teacher(spark, n, wrong, marks, cut, pass_fail="unmarked", missing=0):
    df = items(spark, range(1, n + 1), correct=lambda s: str(s + 1) not in wrong)
    m = spark.createDataFrame([(1, x) for x in marks], "sheet_id long, mark_no string")
    sh = spark.createDataFrame([(1, cut, missing, pass_fail)], "sheet_id long, cut_text string, missing long, pass_fail string")
    return agreement.teacher_mark_compare(df, m, sh).first()


def test_teacher_marks(spark):
    r = teacher(spark, 50, {"16", "39", "46"}, ["16", "39", "46", "47"], "")
    assert (r.theirs_only, r.ours_only, r.agree, r.verdict_match) == (1, 0, 49, None)
    prose = teacher(spark, 17, set(), ["1) 동명사 - decide", "2) to - keep"], "")
    assert (prose.theirs_only, prose.unmatched) == (0, 2)
    near = teacher(spark, 48, set("12345"), ["1", "2", "3", "4"], "( -10%까지 PASS )", "pass")
    assert (near.cut, near.verdict, near.teacher_verdict, near.verdict_match, near.near_boundary) == (4, "fail", "pass", False, True)
    written = teacher(spark, 50, {str(i) for i in range(1, 13)}, ["1", "2", "3"], "-8", "fail")
    assert written.teacher_verdict == "fail" and written.verdict_match


def test_merge_pages_keeps_the_complete_reading(spark):
    a = items(spark, ["47"], written="흐림", confidence=0.4).withColumn("page", F.lit(0))
    b = items(spark, ["47"], written="또렷", confidence=0.95).withColumn("page", F.lit(1))
    blank = items(spark, ["47"], written="", blank=True, confidence=0.99).withColumn("page", F.lit(2))
    rows = a.unionByName(b).unionByName(blank).withColumnRenamed("seq", "pos")
    assert [r.written for r in pages.merge_items(rows, rows.select("sheet_id", "page")).collect()] == ["또렷"]


def test_single_page_is_left_untouched(spark):
    rows = items(spark, ["2", "1", "2"]).withColumn("page", F.lit(0)).withColumnRenamed("seq", "pos")
    merged = pages.merge_items(rows, rows.select("sheet_id", "page").distinct())
    assert sorted(r.no for r in merged.collect()) == ["1", "2", "2"]


@pytest.mark.parametrize("a,b,low,high", [
    ('M4 워드마스터 중등실력 "Unit 33-34', "M4 워드마스터 중등실력 Unit 33-34", 0.9, 1), ("워드마스터 Unit 33-34", "워드마스터 Unit 35-36", 0, 0),
    ("0804 워드마스터 Unit 33-34", "0804 워드마스터 Unit 35-36", 0, 0.599), ("문법 추가시험", "문법 추가시험 3회", 0.6, 1), ("", "Ch.13 문법", 0, 0),
    ("M4 워드마스터 중등실력 Unit 33-34", "08040805워드마스터unit33-34 단어", 0.6, 1), ("Ch.13 문법", "Ch.13 문법", 1, 1),
])
def test_title_score(spark, a, b, low, high):
    normed = spark.createDataFrame([(a, b)], "a string, b string").select(text.norm(F.col("a")).alias("a"), text.norm(F.col("b")).alias("b"))
    assert low <= normed.select(titles.title_score(F.col("a"), F.col("b"))).first()[0] <= high


def test_title_numbers(one):
    nums = lambda s: set(one(titles.title_numbers(text.norm(F.lit(s)))))
    assert nums("0804 unit 33-34") == {804, 33, 34}
    assert nums("08040805워드마스터unit33-34") == {33, 34}
    assert nums("Unit ３３－３４") == {33, 34}


WORDS = "abandon abolish abrupt absorb abstract absurd abundant accelerate accommodate accompany".split()


def match(spark, title, prompts, keys):
    sh = spark.createDataFrame([(1, title)], "sheet_id long, title string")
    it = spark.createDataFrame([(1, str(i), p) for i, p in enumerate(prompts)], "sheet_id long, no string, prompt string")
    kt = spark.createDataFrame([(k.lower(), k) for k in keys], "slug string, title string")
    ki = spark.createDataFrame([(k.lower(), p) for k, ps in keys.items() for p in ps], "slug string, prompt string")
    return matching.match_answer_key(sh, it, kt, ki).first()


def test_key_choice(spark):
    r = match(spark, "ch.13 문법", WORDS, {"Ch.13 문법": [], "전혀 다른 시험": WORDS})
    assert (r.how, r.slug) == ("제목", "ch.13 문법")
    assert match(spark, 'M4 워드마스터 "Unit 33-34', [], {"M4 워드마스터 Unit 33-34": WORDS}).how == "제목 근사"
    assert match(spark, "워드마스터 Unit 33-34", [], {"워드마스터 Unit 35-36": WORDS}).how is None
    two = match(spark, "3과 본문 암기 테스트", [], {"3과 본문 암기 테스트 A": [], "3과 본문 암기 테스트 B": []})
    assert two.how is None and len(two.ambiguous) == 2
    assert match(spark, "", WORDS, {"08040805워드마스터unit33-34 단어": WORDS}).how == "문항"
    assert match(spark, "전혀 다른 제목", WORDS[:4], {"쪽지시험": WORDS[:4]}).how is None
    assert match(spark, "모르는 제목", WORDS, {"A 시험": WORDS, "B 시험": WORDS}).how is None
    torn = match(spark, "Ch.13 문법 추가시험 2", WORDS, {"Ch.13 문법 추가시험": [], "전혀 다른 시험": WORDS})
    assert torn.how is None and len(torn.ambiguous) == 2


def test_apply_reference(spark):
    df = items(
        spark, [1, 2, 3, 4, 5], written=lambda s: ["뜻", "다름", "", "뜻", " 뜻 "][s], blank=lambda s: s == 2, legible=lambda s: s != 3,
        prompt=lambda s: "other" if s == 4 else f"p{s + 1}",
    )
    ref = spark.createDataFrame([(1, str(i), f"p{i}", "뜻", i) for i in range(1, 6)], "sheet_id long, no string, prompt string, expected string, pos int")
    got = {r.no: (r.action, r.correct, r.note) for r in reference.apply_reference(df, ref).collect()}
    assert got == {
        "1": ("pre", True, ""), "2": ("todo", None, None), "3": ("pre", False, "무응답"), "4": ("pre", False, "판독불가"), "5": ("todo", None, None)
    }


def diff_rows(spark, rows):
    cols = "sheet_id long, base_verdict string, trial_verdict string, base_near boolean, n long, agree long, wrong_only_base long, wrong_only_trial long, written_diffs long, only_base long, trial_cost double"
    df = spark.createDataFrame(rows, cols).withColumn("verdict_match", F.col("base_verdict") == F.col("trial_verdict"))
    for c in ("base_cost", "base_ms", "trial_ms", "base_in", "trial_in", "base_out", "trial_out"):
        df = df.withColumn(c, F.lit(1))
    return trials.trial_summary(df, []).first()


def test_trial_summary(spark):
    r = diff_rows(spark, [
        (1, "pass", "fail", True, 10, 9, 0, 1, 0, 0, 1.0), (2, "pass", "fail", False, 10, 10, 0, 0, 0, 0, None),
        (3, None, "pass", False, 10, 10, 0, 0, 0, 0, 1.0), (4, "pass", None, False, 10, 10, 0, 0, 0, 0, 1.0),
    ])
    assert (r.compared, r.flipped, r.flipped_at_boundary, r.flipped_with_margin) == (2, 2, 1, 1)
    assert (r.incomparable, r.trial_undecided, r.all_compared_pass, r.no_price) == (1, 1, False, 1)
    assert diff_rows(spark, [(1, None, None, False, 1, 1, 0, 0, 0, 0, 1.0)]).all_compared_pass is True


def test_bias(one):
    b = lambda x, y: one(trials.trial_bias(F.lit(x), F.lit(y)))
    assert (b(3, 0), b(0, 3), b(1, 0), b(2, 2)) == ("lenient", "strict", "balanced", "balanced")


def test_kst_and_off_hours(spark):
    stamps = ["2026-08-09 20:00:00", "2026-08-10 13:59:00", "2026-08-10 14:00:00", "2026-08-09 06:00:00"]
    ev = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "event_id int, s string").withColumn("created_at", F.expr("cast(s as timestamp_ntz)"))
    got = [(r.dow, r.hour, r.off_hours) for r in usage.with_off_hours(ev, usage.hours_table(spark)).orderBy("event_id").collect()]
    assert got == [(1, 5, True), (1, 22, False), (1, 23, True), (0, 15, True)]


def test_stage_split(spark):
    rows = [(1, 0, 100, 10), (1, 1, 100, 10), (1, 2, 50, 5), (2, 0, 70, 7)]
    calls = spark.createDataFrame(rows, "sheet_id int, pos int, input_tokens long, output_tokens long").withColumns({"cache_read": F.lit(0), "cache_write": F.lit(None).cast("int")})
    r = costs.token_stage_split(calls).first()
    assert (r.transcribe_calls, r.judge_calls, r.sheets, r.pages, r.transcribe_in, r.judge_out) == (3, 1, 2, 3, 270, 5)


def test_call_cost(spark):
    calls = spark.createDataFrame([("claude-opus-5", 0, 0, 1000000, 0), ("claude-opus-5", 0, 0, 0, 1000000), ("unknown", 5, 5, 0, 0)],
                                  "model string, input_tokens long, output_tokens long, cache_read long, cache_write long")
    got = [r.cost_usd for r in costs.call_cost(calls, costs.price_table(spark)).orderBy("cache_write", "cache_read").collect()]
    assert got == [None, 0.5, 6.25]


def test_cost_shares_of_a_measured_month(spark):
    m = spark.createDataFrame([(13, 16, 364, 102000.0, 52000.0, 50600.0)], "sheets int, pages int, items int, image_tokens double, other_tokens double, output_tokens double")
    parts = {r.part: r for r in costs.cost_breakdown(m).collect()}
    assert abs(sum(r.usd for r in parts.values()) - 2.04) < 0.01
    assert parts["output"].share > 0.6 and abs(parts["image"].share - 0.25) < 0.01
    assert 1550 < sum(r.usd for r in costs.cost_projection(m).collect()) < 1650
    empty = m.withColumn("pages", F.lit(0))
    assert sum(r.usd for r in costs.cost_projection(empty).collect()) == 0


def test_queue(spark):
    calls = spark.createDataFrame([(i, ms) for i, ms in enumerate([30000, 35000, 40000, 300000, 0])], "sheet_id int, latency_ms long")
    assert costs.median_latency(calls).first().seconds == 37.5
    assert costs.median_latency(calls.withColumn("latency_ms", F.lit(0))).first().seconds is None
    waiting = spark.createDataFrame([("queued",)] * 20, "status string")
    r = costs.queue_wait(waiting, spark.range(1).select(F.lit(150.0).alias("seconds")), 4).first()
    assert (r.wait_seconds, r.wait_text) == (750.0, "약 13분")


def test_roster(spark):
    rows = [("confirmed", "fail"), ("confirmed", "pass"), ("confirmed", None), ("graded", None), ("cancelled", "fail")]
    df = spark.createDataFrame(rows, "status string, final_verdict string")
    assert [r.bucket for r in roster.split_roster(df).collect()] == ["retest", "passed", "pending", "pending"]


@pytest.mark.parametrize("name,want", [
    ("08040805워드마스터unit33-34 단어 답지.pdf", True), ("0827_M9(A,B)_Day1-3_재시_답지.pdf", True), ("0827_시험지.pdf", False),
    ("0827_답안지.pdf", False), ("답지 오답노트.pdf", False),
])
def test_key_files(one, name, want):
    assert one(files.is_answer_key(F.lit(name))) is want


def test_file_titles(one):
    assert one(files.title_from_name(F.lit("8월27일_교과서 3과 어휘 test 답지_커트 -10 김은진T.pdf"))) == "8월27일 교과서 3과 어휘 test 커트 -10"


@pytest.mark.parametrize("now,want", [("2026-05-31 08:00:00", "2026-03-31 08:00:00"), ("2026-04-30 00:00:00", "2026-02-28 00:00:00")])
def test_retest_cutoff(one, now, want):
    assert str(one(clock.retest_cutoff(F.expr(f"timestamp_ntz '{now}'")))) == want


def test_short_answers(one):
    short = lambda w, e: one(text.too_short(F.lit(w), F.lit(e)))
    assert short("current carry left", "The current will carry us to the left") is True
    assert short("left", "left side") is False


def test_hidden_and_odd(one):
    assert one(text.mark_hidden(F.lit("a​b"))) == "a⟨U+200B⟩b"
    assert one(text.odd_chars(F.lit("aа​é가😀a"))) == "а U+0430, é U+00E9, 😀 U+1F600"
    assert one(text.odd_chars(F.lit("plain 가"))) is None


def test_wilson(one):
    low = lambda k, n: round(one(verdicts.wilson_lower(F.lit(k), F.lit(n))) * 100, 1)
    assert (low(7, 7), low(30, 30), low(100, 100), low(196, 200)) == (64.6, 88.6, 96.3, 95.0)


def test_words_for_money(one):
    assert one(money.pct(F.lit(1), F.lit(0)), money.pct(F.lit(1), F.lit(3)), money.krw(F.lit(2.0)), money.round2(F.lit(0.125))) == ("—", "33.3%", 2830, 0.13)


def test_describe_hours(spark):
    text_ = usage.describe_hours(usage.hours_table(spark).withColumn("k", F.lit(1)), ["k"]).first().text
    assert text_ == "월·화·수·목·금·토 13:00~23:00"


def test_letter_pairs_strip_a_title_once(one):
    """Without a binding the title is stripped again for every pair."""
    pairs = titles.letter_pairs(F.lit("ab  a b"))
    assert one(pairs, titles.letter_pairs(F.lit(" x ")), titles.letter_pairs(F.lit(None).cast("string"))) == (["ab", "ba"], ["x"], [])
    assert str(titles.dice(pairs, titles.letter_pairs(F.lit("abc")))).count("regexp_replace") == 2
    assert one(titles.dice(pairs, titles.letter_pairs(F.lit("abc")))) == 0.5


@pytest.mark.parametrize("raw", ["Ab c", "Ab  c", " Ab", "Ab ", "A\tb", "", " ", "Ab\n", "Éa", "ﬁ x", "\x7fA", "가 나"])
def test_clean_text_is_normalised_like_any_other(one, raw):
    want = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", raw).strip().lower())
    assert one(text.norm(F.lit(raw))) == want
