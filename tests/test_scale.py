"""Ordered operators with tiny buckets, long lists, and greedy jobs against brute force."""

import difflib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from markloom.checks import all_queries
from markloom.checks.views import Tables
from markloom.operators import agreement, drift, layout, lifecycle, matching, reference, sequence_diff, sequences, trials
from markloom.session import scratch_path, written
from markloom.sources import writers

SF = "/root/testdata/sf0.001"


def test_lag_and_running_sum_over_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("seq"), (F.col("id") * 7 % 11).alias("v"))
    w = Window.partitionBy("k").orderBy("seq")
    want = rows.select("k", "seq", F.lag("v").over(w).alias("prev"), F.sum("v").over(w).alias("total"))
    bucket = sequences.seq_bucket("seq", 16)
    got = sequences.lag_within(rows, ["k"], ["seq"], bucket, "v", "prev")
    got = sequences.running_sum(got, ["k"], ["seq"], bucket, F.col("v"), "total").select("k", "seq", "prev", "total")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_null_keys_keep_their_order(spark):
    rows = spark.createDataFrame([(None, i) for i in range(40)], "k string, seq int")
    placed = sequences.position(rows, ["k"], ["seq"], sequences.seq_bucket("seq", 4), "at")
    assert all(r.seq == r["at"] for r in placed.collect())


def test_fold_text_cuts_every_key_alike(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("o")).filter("k = 0 or o < 8")
    out = sequences.fold_text(rows, ["k"], F.col("o").cast("string"), ["o"], "t", width=10).collect()
    texts = {k: [r.t for r in sorted(out, key=lambda r: r.part) if r.k == k] for k in (0, 1)}
    assert texts[1] == ["1, 3, 5, 7"] and len(texts[0]) == 5 and sorted(r.part for r in out if r.k == 0) == [0, 1, 2, 3, 4]
    assert ", ".join(texts[0]) == ", ".join(str(i) for i in range(0, 100, 2))


def test_fingerprint_is_the_whole_list_at_any_size(spark):
    items = spark.range(25_000).select((F.col("id") % 2).alias("sheet_id"), F.col("id").alias("seq"), F.col("id").cast("string").alias("no"))
    sheets = spark.range(2).select(F.col("id").alias("sheet_id"), F.lit("T").alias("title"))
    got = {r.sheet_id: r.fingerprint for r in reference.ref_fingerprint(items.filter("sheet_id = 0 or seq < 9"), sheets).collect()}
    assert got[1] == "t|1,3,5,7" and got[0] == "t|" + ",".join(str(i) for i in range(0, 25_000, 2))


def test_first_rows_cuts_before_the_shuffle(spark):
    df = sequences.first_rows(spark.range(1000).withColumn("k", F.col("id") % 3), ["k"], [F.col("id")], 4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_regions_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(d, 1, i, round(rng.random() * 0.05, 4), round(rng.random() * 0.2, 4), 0.1, 0.001) for d in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id int, page int, pos int, x double, y double, w double, h double")
    want = set()
    for d in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (r[4], r[3])):
            if not any(abs(r[4] - k[4]) < 0.004 and abs(r[3] - k[3]) < 0.004 for k in kept):
                kept.append(r)
        want |= {r[:3] for r in kept}
    assert {(r.doc_id, r.page, r.pos) for r in layout.dedupe_regions(df).collect()} == want


def test_every_blank_gets_the_nearest_free_token(spark):
    """Checks the pairs themselves: none twice, none too far, none nearer left over when its blank's turn came."""
    rng = random.Random(7)
    schema = "doc_id int, block int, page int, pos int, text string, x double, y double, w double, h double"
    place = lambda i, t: (1, i % 2, 1 + i % 3 // 2, i, t, round(rng.random(), 3), round(rng.random() * 0.3, 3), 0.1, 0.01)
    blanks, tokens = [place(i, f"____{i}") for i in range(60)], [place(i, f"w{i}") for i in range(1000, 1200)]
    got = {r.blank_pos: r.token_pos for r in layout.nearest_blank_fill(*(spark.createDataFrame(x, schema) for x in (blanks, tokens))).collect()}
    assert len(set(got.values())) == len(got) > 30
    by_pos = {t[3]: t for t in tokens}
    for b in blanks:
        earlier = {t for pos, t in got.items() if pos < b[3]}
        gaps = {t[3]: abs(t[5] - b[5]) for t in tokens if t[1:3] == b[1:3] and abs(t[6] - b[6]) < 0.02 and t[3] not in earlier}
        assert (b[3] in got) == bool(gaps)
        if gaps:
            assert by_pos[got[b[3]]][1:3] == b[1:3] and gaps[got[b[3]]] == min(gaps.values())


def opcodes(a, b):
    """The rule in plain recursion, by the standard library."""
    return [c[1:] for c in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if c[0] != "equal" and c[4] > c[3]]


def edited(rng, words, n, kinds):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words) + 1)
        words[at : at + rng.randint(0, 3)] = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(0, 4))]
    if n > 3:  # a moved stretch
        at, to = rng.randrange(len(words) + 1), rng.randrange(len(words) + 1)
        part = words[at : at + 15]
        del words[at : at + 15]
        words[to:to] = part
    return words


@pytest.mark.parametrize("pairs", [2_000_000, 30])
def test_matching_blocks_against_plain_recursion(monkeypatch, pairs):
    monkeypatch.setattr(sequence_diff, "_FEW_PAIRS", pairs)
    for seed in range(300):
        rng = random.Random(seed)
        kinds = rng.choice([2, 5, 30])
        a = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(0, 60))]
        b = edited(rng, a, rng.randint(0, 8), kinds) if seed % 2 else [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(0, 60))]
        assert sequence_diff.changes(a, b) == opcodes(a, b)


@pytest.mark.parametrize("large", [0, 10**9])
def test_documents_cut_at_certain_runs_give_the_same_changes(spark, large):
    exam, key, want = [], [], set()
    for doc in range(40):
        rng = random.Random(doc)
        kinds = rng.choice([3, 20, 500])
        a = [f"w{rng.randrange(kinds)}" for _ in range(rng.choice([0, 5, 60, 300]))]
        if doc % 5 == 0:
            a += a[:40]  # repeated stretches are not certain
        b = edited(rng, a, rng.randint(0, 12), kinds)
        exam += [(doc, i, t) for i, t in enumerate(a)]
        key += [(doc, i, t) for i, t in enumerate(b)]
        want |= {(doc, *c) for c in opcodes(a, b)}
    exam, key = (spark.createDataFrame(x, "doc_id int, pos int, text string") for x in (exam, key))
    # buckets of 16 positions: every document spans several
    found = sequence_diff.sequence_changes(exam, key, gram=4, large=large, size=16)
    assert {tuple(r) for r in found.collect()} == want
    if not large:
        assert sequence_diff.certain_runs(exam, key, 4, 16).count() > 30


def test_a_long_document_is_many_tasks_work(spark):
    n = 60_000
    word = F.concat(F.lit("w"), F.pmod(F.xxhash64("id"), F.lit(5000)))
    key = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("pos"), word.alias("text"))
    exam = key.withColumn("text", F.when(F.col("pos") % 20 == 7, F.lit("____")).otherwise(F.col("text")))
    found = sequence_diff.sequence_changes(exam, key)
    assert {tuple(r) for r in found.collect()} == {(1, i, i + 1, i, i + 1) for i in range(7, n, 20)}
    assert sequence_diff.certain_runs(exam, key).agg(F.sum("n")).first()[0] > 0.9 * n


def test_rules_in_rounds_need_no_python(spark):
    for name in ("dedupe_regions", "nearest_blank_fill"):
        assert "Python" not in all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def stored_plans(monkeypatch, module):
    """Plans of the tables that a module stores on its way."""
    plans = []

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(module, "written", noted)
    return plans


def test_rounds_over_regions_broadcast_nothing(spark, monkeypatch):
    """Positions look small in files: Spark would collect all of them on the driver."""
    plans = stored_plans(monkeypatch, layout)
    out = all_queries()["dedupe_regions"](spark, SF)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_answers_from_a_key_broadcast_no_tokens(spark, monkeypatch):
    plans = stored_plans(monkeypatch, layout)
    out = all_queries()["token_diff_answers"](spark, SF)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    # the first plan, the comparison, broadcasts its list of long documents
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans[1:])


def test_sums_over_buckets_are_not_joined_back(spark):
    """A null-safe join of the buckets' sums would shuffle all rows once more."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.col("id") % 5).alias("v"))
    bucket = F.floor(F.col("o") / 100)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (
        sequences.running_sum(rows, ["k"], ["o"], bucket, F.col("v"), "s"), sequences.lag_within(rows, ["k"], ["o"], bucket, "v", "p"),
    )]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not any("Join" in p for p in plans)


@pytest.mark.parametrize("large", [10, 10_000])
def test_only_large_keys_are_cut(spark, large):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 > 0, 7).when(F.col("id") > 20, F.col("id") % 400).alias("k"), (F.col("id") * 7919 % 4000).alias("o"))
    want = rows.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy("o")) - 1).withColumn("at", F.col("at").cast("bigint"))
    got = sequences.position(rows, ["k"], ["o"], F.floor(F.col("o") / 16), "at", large=large)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    cut = sequences.cut_large(rows, ["k"], F.floor(F.col("o") / 16), large).filter("_cut is not null")
    assert {r.k for r in cut.select("k").distinct().collect()} >= ({7} if large == 10 else set()) and (large == 10 or cut.isEmpty())


def test_similarity_join_finds_every_pair_above_the_floor(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
    title = lambda: " ".join([word() for _ in range(rng.randint(1, 3))] + [str(rng.randint(1, 6)) for _ in range(rng.randint(0, 3))])
    left, right = sorted({title() for _ in range(150)}), sorted({title() for _ in range(150)})
    sh = spark.createDataFrame([(t,) for t in left], "title string")
    ks = spark.createDataFrame([(t, t) for t in right], "slug string, title string")
    from markloom.functions.titles import title_score

    every = sh.crossJoin(ks.select("slug")).withColumn("score", title_score(F.col("title"), F.col("slug"))).filter("score >= 0.5")
    want = {(r.title, r.slug) for r in every.collect()}
    got = {(r.title, r.slug) for r in matching.title_similarity_join(sh, ks).collect()}
    assert got == want and len(want) > 100


def test_prompt_overlap_is_whole_whatever_counts_as_common(spark):
    rng = random.Random(11)
    draw = lambda n: rng.sample(["hot"] * 0 + [f"w{i}" for i in range(25)] + ["h1", "h2", "h3"] * 3, n)
    left = {s: set(draw(rng.randint(1, 8))) for s in range(80)}
    right = {f"k{k}": set(draw(rng.randint(1, 8))) for k in range(60)}
    si = spark.createDataFrame([(s, p) for s, ps in left.items() for p in ps], "sheet_id long, prompt string")
    ki = spark.createDataFrame([(k, p) for k, ps in right.items() for p in ps], "slug string, prompt string")
    want = {}
    for s, a in left.items():
        for k, b in right.items():
            if len(a & b) / min(len(a), len(b)) >= matching.PROMPT_FLOOR:
                want[s, k] = len(a & b)
    for common in (0, 4, 20, 64):
        got = {(r.sheet_id, r.slug): r.hits for r in matching.prompt_overlap_join(si, ki, common=common).collect()}
        assert got == want


def test_prompts_of_the_same_keys_are_joined_as_one(spark):
    """Twelve keys share 200 prompts: one class of weight 200, so 12 postings instead of 2400."""
    shared = [(f"k{k}", f"p{i}") for k in range(12) for i in range(200)] + [(f"k{k}", f"own{k}-{i}") for k in range(12) for i in range(20)]
    sheets = [(s, f"p{i}") for s in range(5) for i in range(200) if (i + s) % 9] + [(s, f"own{s}-{i}") for s in range(5) for i in range(20)]
    si, ki = spark.createDataFrame(sheets, "sheet_id long, prompt string"), spark.createDataFrame(shared, "slug string, prompt string")
    want = {}
    for s in range(5):
        own = {p for x, p in sheets if x == s}
        for k in range(12):
            key = {p for x, p in shared if x == f"k{k}"}
            if len(own & key) / min(len(own), len(key)) >= matching.PROMPT_FLOOR:
                want[s, f"k{k}"] = len(own & key)
    for common in (4, 64):
        assert {(r.sheet_id, r.slug): r.hits for r in matching.prompt_overlap_join(si, ki, common=common).collect()} == want
    sets = matching._prompt_sets(ki, "slug")
    assert matching._members(sets, "prompt", "slug", "class").select("class").distinct().count() == 13


def test_sheets_with_one_list_store_one_sheets_prompts(spark, monkeypatch):
    stored = []

    def noted(df, label):
        out = written(df, label)
        stored.append((label, out.count()))
        return out

    monkeypatch.setattr(matching, "written", noted)
    sheets = [(s, f"P{i} ") for s in range(40) for i in range(30)] + [(s, f"P{i}") for s in range(40, 50) for i in (*range(30), 3)]
    si, ki = spark.createDataFrame(sheets, "sheet_id long, prompt string"), spark.createDataFrame([("k", f"p{i}") for i in range(25)], "slug string, prompt string")
    found = {tuple(r) for r in matching.prompt_overlap_join(si, ki).collect()}
    assert found == {(s, "k", 25, 1.0) for s in range(50)}
    assert max(n for label, n in stored if label == "prompt-sets") == 60  # two lists, one set


def test_lists_known_beforehand_give_the_rows_of_every_sheets_items(spark):
    rng = random.Random(9)
    lists = spark.createDataFrame([(s, rng.choice(["a", "b", "c", "none", None])) for s in range(60)], "sheet_id long, list string")
    items = spark.createDataFrame([(a, f"P{i}") for a, n in (("a", 20), ("b", 9), ("c", 9)) for i in range(n)] + [("b", "own"), ("c", "p3")], "list string, prompt string")
    keys = spark.createDataFrame([("k1", "K1"), ("k2", "K2"), ("k3", "K3")], "slug string, title string")
    key_items = spark.createDataFrame([("k1", f"p{i}") for i in range(18)] + [("k2", f"p{i}") for i in range(9, 20)] + [("k3", "z")], "slug string, prompt string")
    sheets = lists.select("sheet_id", F.when(F.col("sheet_id") % 9 == 0, "k2").otherwise("?").alias("title"))
    spelled = lists.join(items, "list").select("sheet_id", "prompt")
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    got = matching.prompt_overlap_join(items, key_items, lists=lists)
    assert same(got, matching.prompt_overlap_join(spelled, key_items)) and got.count() > 40
    got = matching.match_answer_key(sheets, items, keys, key_items, lists)
    assert same(got, matching.match_answer_key(sheets, spelled, keys, key_items)) and got.count() == 60
    assert {"제목", "문항"} <= {r.how for r in got.collect()}


def test_exam_items_are_derived_once_a_list(spark):
    """Sheets times parts of their exam grow with the square of the tables; their lists do not."""
    t = Tables(spark, SF)
    exam = t.part.filter("p_partkey in (3, 5, 8)").select("p_size", "p_type").unionByName(spark.createDataFrame([(None, "X")], "p_size int, p_type string"))
    t.__dict__["exams"] = spark.range(-200, 2000).withColumnRenamed("id", "sheet_id").crossJoin(exam).filter("sheet_id % 50 = 7 or p_size % 3 = sheet_id % 3 or p_size is null")
    lists, items = t.exam_lists
    got, want = lists.join(items, "list").select("sheet_id", "prompt"), t.exam_items.select("sheet_id", "prompt")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert lists.count() == lists.select("sheet_id").distinct().count()
    assert items.count() < want.count() / 5


def test_sheets_with_an_equal_title_are_not_collected(spark, monkeypatch):
    plans = stored_plans(monkeypatch, matching)
    all_queries()["match_answer_key"](spark, SF)
    assert any("SortMergeJoin" in line and "LeftAnti" in line for p in plans for line in p.splitlines())


def test_notes_read_the_matches_once(spark):
    rows = [(1, "k", "제목", "w", []), (2, "k", "문항", "w", []), (3, "k", "문항", None, None), (4, None, None, None, [("A", 0.9), ("B", 0.8)]), (5, None, None, None, []), (6, None, None, None, None)]
    matches = spark.createDataFrame(rows, "sheet_id long, slug string, how string, why string, ambiguous array<struct<title:string,score:double>>")
    notes = reference.key_match_notes(matches)
    got = {r.sheet_id: r.text for r in notes.collect()}
    assert set(got) == {2, 3, 4} and got[2].startswith("🔶 정답지를 「문항」로 붙였습니다 — w ") and "「A」, 「B」" in got[4]
    assert "Union" not in notes._jdf.queryExecution().optimizedPlan().toString()


def test_a_frequent_beginning_spreads_over_ranges(spark):
    files = spark.range(20_000).select(F.lit("cam").alias("folder"), F.format_string("IMG_20260101_%06d.jpg", F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("int")).alias("name"), F.col("id"))
    files = files.dropDuplicates(["name"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    sizes = [r["count"] for r in sequences.ranged(files, ["folder"], ["name"]).groupBy("_range").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 3 and max(sizes) < 0.5 * sum(sizes)
    placed = sequences.ranked_position(files, ["folder"], ["name"], "at").orderBy("at").collect()
    assert [r.at for r in placed] == list(range(len(placed))) and [r.name for r in placed] == sorted(r.name for r in placed)


def test_hot_fold_gives_the_same_parts(spark):
    rows = spark.range(30_000).select((F.col("id") % 7 == 0).cast("int").alias("k"), (F.col("id") * 7919 % 30_000).alias("o"), F.concat(F.lit("v"), "id").alias("v"))
    one, two = (sequences.fold_text(rows, ["k"], F.col("v"), ["o"], "t", width=1000, hot=hot) for hot in (True, False))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty() and one.count() == 31


def test_days_are_pruned(spark):
    path = scratch_path(spark, "by-day")
    moments = spark.range(4000).select(F.col("id").alias("sheet_id"), F.when(F.col("id") % 50 > 0, F.timestamp_seconds(F.col("id") * 2500)).alias("created_at"))
    writers.write_by_day(moments, path)
    stored = spark.read.parquet(path)
    for found, plain in (
        (lifecycle.scan_day(stored, "1970-02-03"), lifecycle.scan_day(moments, "1970-02-03")),
        (lifecycle.scan_usage_between(stored, "1970-03-01", "1970-03-04"), lifecycle.scan_usage_between(moments, "1970-03-01", "1970-03-04")),
    ):
        assert found.columns == plain.columns and sorted(found.collect()) == sorted(plain.collect()) and plain.count() > 20
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(created_at_day" in plan
    one = lifecycle.scan_usage_between(stored, "1970-02-03", "1970-02-03")
    one.collect()
    leaves = one._jdf.queryExecution().executedPlan().collectLeaves()
    files = max(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles"))
    assert files <= writers.DAY_FILES < len(stored.inputFiles()) / 10


def test_only_large_keys_go_through_ranges(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(sequences, "written", lambda df, label: (stored.append(label), written(df, label))[1])
    rows = spark.range(6000).select(F.when(F.col("id") % 2 > 0, 7).when(F.col("id") > 40, F.col("id") % 400).alias("k"), (F.col("id") * 7919 % 6000).alias("o"))
    want = rows.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy("o")).cast("bigint") - 1)
    for large in (10_000, 1000, 10):
        got = sequences.ranked_position(rows, ["k"], ["o"], "at", large)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        assert ("ranged" in stored) == (large < 10_000)
    assert {r.k for r in sequences.large_keys(rows, ["k"], 1000).collect()} == {7}


def test_queries_read_the_line_items_once(spark):
    for name in ("run_variance", "unstable_items", "sheet_run_diff", "apply_reference", "teacher_mark_compare", "reading_preservation"):
        assert "lineitem.parquet" not in all_queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString(), name


def test_runs_of_a_sheet_against_the_comparison_of_each(spark):
    rng = random.Random(3)
    row = lambda *keys: (*keys, rng.randrange(9), rng.choice(["1", "2", "3", "4", None]), rng.choice(["a", " A", "b"]), rng.choice([True, False, None]))
    base = spark.createDataFrame([row(s) for s in range(12) for _ in range(rng.randint(1, 6))], "sheet_id int, seq int, no string, written string, correct boolean")
    mine = spark.createDataFrame([row(s * 2 + k, s) for s in range(14) for k in (0, 1) for _ in range(rng.randint(0, 6))], "trial_id int, sheet_id int, seq int, no string, written string, correct boolean")
    # one reading a number, so that the last one is certain
    base, mine = base.dropDuplicates(["sheet_id", "no"]).localCheckpoint(), mine.dropDuplicates(["trial_id", "sheet_id", "no"]).localCheckpoint()
    runs = spark.range(28).selectExpr("cast(id as int) as trial_id", "cast(id div 2 as int) as sheet_id", "if(id % 3 = 0, 'pass', 'fail') as verdict").filter("trial_id % 7 <> 5")
    bases = base.groupBy("sheet_id").agg(F.count("*").alias("n")).selectExpr("sheet_id", "n", "'pass' as verdict", "true as near_boundary", "1 as margin")
    keys = ("trial_id", "sheet_id")
    theirs = base.join(runs.select(*keys), "sheet_id")
    want = trials.sheet_run_diff(trials.run_diff_items(theirs, mine.join(runs, [*keys], "left_semi"), keys), bases, runs, keys)
    got = trials.runs_diff(base, mine, bases, runs).select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 21


def test_runs_and_sheets_are_joined_once_and_not_collected(spark):
    """Stored base runs and runs look small in files: Spark would collect all of them on the driver."""
    base = spark.range(400).selectExpr("id div 8 as sheet_id", "id % 8 as seq", "string(id % 8) as no", "'a' as written", "id % 3 = 0 as correct")
    runs = written(spark.range(100).selectExpr("id as trial_id", "id div 2 as sheet_id", "'pass' as verdict", "id as trial_cost"), "runs")
    bases = written(base.groupBy("sheet_id").agg(F.count("*").alias("n")).selectExpr("*", "'pass' as verdict", "true as near_boundary", "1 as margin", "sheet_id as base_cost"), "base-runs")
    got = trials.runs_diff(base, runs.select("trial_id", "sheet_id").join(base, "sheet_id").localCheckpoint(), bases, runs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 3
    assert "REPARTITION_BY_NUM" in plan  # readings of all runs do not share a few tasks
    assert {(r.trial_cost, r.base_cost, r.n, r.agree, r.only_base) for r in got.collect()} == {(i, i // 2, 8, 8, 0) for i in range(100)}


def test_drift_warnings_shuffle_the_items_once(spark):
    rng = random.Random(5)
    no = lambda: rng.choice(["1", "2", " 2", "3", "7", "12", "30", "x", None])
    row = lambda sheet, seq: (sheet, seq, no(), rng.choice(["a", " A", "ａ", "", None]), rng.choice(["ko2en", "en2ko"]), rng.choice(["", "b"]), rng.choice(["ab", "", "제안", "bc"]))
    rows = [row(s, i) for s in range(9) for i in range(60 if s == 4 else rng.randint(1, 9))]
    items = spark.createDataFrame(rows, "sheet_id long, seq long, no string, prompt string, direction string, prefix string, written string")
    items = written(items, "items")
    key = items.filter("seq % 3 < 2").selectExpr("sheet_id", "no", "if(seq % 2 = 0, upper(prompt), 'z') as prompt", "seq as pos")
    sheets = spark.range(8).selectExpr("id as sheet_id", "cast(id % 3 * 4 as int) as printed_total", "cast(1 + id % 2 as int) as page_count")
    for some in (key, None):
        got = drift.drift_warnings(items, sheets, some)
        for large in (20, 0):  # one sheet, then all of them by their numbers and positions
            other = drift.drift_warnings(items, sheets, some, large=large)
            assert got.exceptAll(other).isEmpty() and other.exceptAll(got).isEmpty()
    assert {r.check_no for r in drift.drift_warnings(items, sheets, key).collect()} == set(range(1, 9))
    plain = lambda df: df.withColumn("prompt", F.translate("prompt", "ａＡ", "aA"))
    plain(items).write.parquet(path := scratch_path(spark, "plain"))
    plan = drift.drift_warnings(spark.read.parquet(path), sheets, plain(key))._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert plan.count("Exchange hashpartitioning") + plan.count("BroadcastExchange") <= 2  # items with their key, and sheets


def test_region_rows_are_spread_and_narrow(spark):
    spots = spark.range(40_000).selectExpr("id % 50 as doc_id", "1 as page", "id div 50 % 400 as pos", "id div 50 % 20 / 20.0d as x", "id div 1000 % 20 / 20.0d as y", "id % 3 / 10.0d as w", "0.01d as h").coalesce(1)
    rows = []
    count = lambda df, label: (rows.append((label, df.rdd.getNumPartitions())), written(df, label))[1]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(layout, "written", count)
        kept = layout.dedupe_regions(spots)
    want = spots.groupBy("doc_id", "page", "y", "x").agg(F.min("pos").alias("pos"))
    assert kept.select(*want.columns).exceptAll(want).isEmpty() and kept.count() == want.count()
    pairs = spots.select("doc_id", "page", "y", "x", "pos", "w", "h")
    assert kept.select(*pairs.columns).exceptAll(pairs).isEmpty()
    assert dict(rows)["touching"] >= 8  # not one task, however few bytes they take


def test_marks_meet_items_without_a_join(spark):
    results = spark.createDataFrame([(1, "1", True), (1, "1", False), (1, "2", None), (1, "3", True), (1, None, True), (None, "1", True)], "sheet_id long, no string, correct boolean")
    marks = spark.createDataFrame([(1, " 3 "), (1, "3"), (1, "9"), (1, " "), (2, "1"), (None, "1")], "sheet_id long, mark_no string")
    pairs = agreement.mark_items(results, marks)
    got = sorted((tuple(r) for r in pairs.collect()), key=str)
    assert got == sorted([
        (1, "1", True, True, False), (1, "2", True, True, False), (1, "3", True, False, True), (1, None, True, False, False),
        (1, "9", False, False, True), (2, "1", False, False, True), (None, "1", True, False, False), (None, "1", False, False, True),
    ], key=str)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "REPARTITION_BY_NUM" in plan
