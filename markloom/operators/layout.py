"""Answers and regions from document layout tables.

Coordinates are page fractions. A page is a bounded area and coordinates carry four digits, so
copies are merged by position first; rules that take things in order then go in rounds over neighbours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions import files as FF
from markloom.functions.text import is_mojibake, is_noise, text_or_empty, trimmed
from markloom.operators import sequence_diff as D
from markloom.operators import sequences as S
from markloom.session import shuffled, written

BOX = ("x", "y", "w", "h")
HEADER, FOOTER = 0.10, 0.97


def bbox_union(df: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    """Smallest box around each group, four digits."""
    x0, y0 = F.min("x"), F.min("y")
    x1, y1 = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return df.groupBy(*keys).agg(
        F.round(x0, 4).alias("x"), F.round(y0, 4).alias("y"), F.round(x1 - x0, 4).alias("w"), F.round(y1 - y0, 4).alias("h"), *extra
    )


def number_lines(tokens: DataFrame, keys: list[str], tol: float = 0.008) -> DataFrame:
    """Add line: a new one starts where the page changes or y moves by more than tol from the previous token."""
    bucket = S.seq_bucket("pos")
    at = tokens.withColumn("_at", F.struct("page", "y"))
    lagged = S.lag_within(at, keys, ["pos"], bucket, "_at", "_before")
    b = F.col("_before")
    starts = b.isNull() | (F.col("page") != b["page"]) | (F.abs(F.col("y") - b["y"]) > tol)
    return S.running_sum(lagged.withColumn("_new", starts.cast("int")), keys, ["pos"], bucket, F.col("_new"), "line").drop("_at", "_before", "_new")


def tokens_to_lines(tokens: DataFrame, keys: list[str], tol: float = 0.008) -> DataFrame:
    """(keys, line, page, part, text, box, n_tokens, n_words) of every line; n_words counts tokens that are not mere punctuation."""
    lines = number_lines(tokens, keys, tol)
    boxes = bbox_union(
        lines, [*keys, "line"], F.min("page").alias("page"), F.count("*").alias("n_tokens"), F.count_if(~is_noise(F.col("text"))).alias("n_words")
    )
    texts = S.fold_text(lines, [*keys, "line"], F.col("text"), ["pos"], "text", sep=" ")
    return boxes.join(shuffled(texts), [*keys, "line"]).withColumn("text", trimmed(F.col("text")))


def merge_adjacent_spans(spans: DataFrame, gap: float = 1.0) -> DataFrame:
    """Join spans of a line whose distance to the previous span's right edge is below gap.

    ``spans``: (doc_id, page, line, pos, text, x0, y0, x1, y1).
    """
    keys = ["doc_id", "page", "line"]
    bucket = S.seq_bucket("pos")
    lagged = S.lag_within(spans, keys, ["pos"], bucket, "x1", "_edge")
    apart = F.coalesce(F.col("x0") - F.col("_edge") >= gap, F.lit(False)).cast("int")
    grouped = S.running_sum(lagged.withColumn("_apart", apart), keys, ["pos"], bucket, F.col("_apart"), "grp")
    group = [*keys, "grp"]
    boxes = grouped.groupBy(*group).agg(
        F.min_by("x0", "pos").alias("x0"), F.min("y0").alias("y0"), F.max_by("x1", "pos").alias("x1"), F.max("y1").alias("y1")
    )
    texts = S.fold_text(grouped, group, F.col("text"), ["pos"], "text", sep="")
    return boxes.join(shuffled(texts), group)


def _plain_noise(c: Column) -> Column:
    return c.rlike(f"^[{K.NOISE_CHARS}/]+$")


def hidden_span_answers(spans: DataFrame, sizes: DataFrame, gap: float = 1.0) -> DataFrame:
    """Answers printed in near-white: every colour channel at least 0xF0.

    ``spans`` adds color; ``sizes``: (doc_id, page, width, height) in points.
    """
    channels = [F.shiftright("color", s).bitwiseAND(255) for s in (16, 8, 0)]
    text = trimmed(F.col("text"))
    white = spans.filter(F.least(*channels) >= 0xF0).withColumn("text", text).filter((F.col("text") != "") & ~_plain_noise(F.col("text")))
    # every span that is left has a character that is not noise, and so has what they are merged into
    kept = merge_adjacent_spans(white, gap).withColumn("answer", trimmed(F.col("text"))).join(sizes, ["doc_id", "page"])
    w, h = F.col("width"), F.col("height")
    return kept.select(
        "doc_id", "page", "line", "grp", "part", "answer",
        F.round(F.col("x0") / w, 4).alias("x"), F.round(F.col("y0") / h, 4).alias("y"),
        F.round((F.col("x1") - F.col("x0")) / w, 4).alias("w"), F.round((F.col("y1") - F.col("y0")) / h, 4).alias("h"),
    )


def in_body(y: Column) -> Column:
    return (y >= HEADER) & (y <= FOOTER)


def question_numbers(words: DataFrame) -> DataFrame:
    number = F.regexp_extract("text", r"^([0-9]{1,3})[.)]$", 1)
    found = words.withColumn("number", F.nullif(number, F.lit("")).try_cast("int"))
    return found.filter(F.col("number").isNotNull() & in_body(F.col("y"))).select("doc_id", "page", "pos", "number", *BOX)


def layout_regions(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Answer regions of three kinds: underscore blanks, ruled lines, circled choices (with their index).

    ``words``: (doc_id, page, pos, text, x, y, w, h); ``lines``: (doc_id, page, pos, x, y, w, h, height_pt, page_height).
    """
    none = F.lit(None).cast("int").alias("index")
    base = ["doc_id", "page", "pos", *[F.round(c, 4).alias(c) for c in BOX]]
    blanks = words.filter(F.col("text").rlike("_{3,}") & in_body(F.col("y")) & (F.col("w") >= 0.04))
    rules = lines.filter((F.col("height_pt") <= 2.5) & (F.col("w") >= 0.05) & in_body(F.col("y")))
    up, down = F.lit(14.0) / F.col("page_height"), F.lit(2.0) / F.col("page_height")
    # writing sits on the line: 14 points above it and 2 below
    rules = rules.withColumns({"x": F.round("x", 4), "y": F.round(F.col("y") - up, 4), "h": up + down})
    circled = F.expr(f"instr('{K.CIRCLED}', substring(text, 1, 1))")
    choices = words.filter(text_or_empty(F.col("text")) != "").withColumn("index", circled.cast("int")).filter("index > 0")
    return (
        blanks.select(F.lit("underscore").alias("kind"), *base, none)
        .unionByName(dedupe_regions(rules.select("doc_id", "page", "pos", *BOX)).select(F.lit("rule").alias("kind"), *base, none))
        .unionByName(choices.select(F.lit("choice").alias("kind"), *base, "index"))
    )


def dedupe_regions(regions: DataFrame, tol: float = 0.004) -> DataFrame:
    """Drop a region within tol (both axes) of one already kept, in reading order.

    Equal positions merge first, those of one position in several tasks.  Neighbours are joined over a grid of cells
    of tol; a cell holds a bounded number of positions of four digits.  Then, in rounds, a region without an open neighbour before it is kept
    and drops its neighbours after it, which is the rule in reading order wherever regions don't touch.
    """
    page = ["doc_id", "page"]
    spot = [*page, "y", "x"]
    # column by column, as numbers are merged in place where a struct would be sorted; all of them take the same row
    rest = [c for c in regions.columns if c not in spot]
    least = lambda df, keys: S.spread(df, *keys).groupBy(*keys).agg(*[F.min_by(c, "pos").alias(c) for c in rest])
    salted = regions.withColumn("_salt", F.pmod(F.xxhash64("pos"), F.lit(16)))
    same = written(least(least(salted, [*spot, "_salt"]), spot), "spots")
    cell = lambda c: F.floor(F.col(c) / tol)
    around = F.explode(F.array(*[F.struct((cell("y") + i).alias("_cy"), (cell("x") + j).alias("_cx")) for i in (-1, 0) for j in (-1, 0, 1)]))
    after = same.select(*page, F.col("y").alias("ly"), F.col("x").alias("lx"), around.alias("_c")).select(*page, "ly", "lx", "_c.*")
    before = same.select(*page, "y", "x", cell("y").alias("_cy"), cell("x").alias("_cx"))
    close = (F.abs(F.col("ly") - F.col("y")) < tol) & (F.abs(F.col("lx") - F.col("x")) < tol)
    earlier = (F.col("y") < F.col("ly")) | ((F.col("y") == F.col("ly")) & (F.col("x") < F.col("lx")))
    grid = [*page, "_cy", "_cx"]
    touching = written(S.spread(after, *grid).join(shuffled(S.spread(before, *grid)), grid).filter(close & earlier).select(*spot, "ly", "lx"), "touching")
    later = [*page, "ly", "lx"]
    dropped = []
    while not touching.isEmpty():
        waiting = touching.select(*page, F.col("ly").alias("y"), F.col("lx").alias("x")).distinct()
        gone = written(touching.join(shuffled(waiting), spot, "left_anti").select(*later).distinct(), "dropped")
        as_first = gone.select(*page, F.col("ly").alias("y"), F.col("lx").alias("x"))
        dropped.append(as_first)
        touching = written(touching.join(shuffled(gone), later, "left_anti").join(shuffled(as_first), spot, "left_anti"), "touching")
    if dropped:
        same = same.join(shuffled(reduce(DataFrame.unionAll, dropped)), spot, "left_anti")
    return same.select(*regions.columns)


def number_region_match(numbers: DataFrame, regions: DataFrame) -> DataFrame:
    """Each region's question number: nearest left on its line, else the line above; NULL for orphans.

    Computed per distinct position and joined back, so copies of a page element cost nothing.
    """
    band = 0.045
    page = ["doc_id", "page"]
    marks = numbers.groupBy(*page, F.col("y").alias("ny"), F.col("x").alias("nx")).agg(F.min("number").alias("number"))
    spots = regions.select(*page, "y", "x").distinct()
    row = lambda c: F.floor(F.col(c) / band)
    near = spots.withColumn("_row", F.explode(F.array(row("y") - 1, row("y"), row("y") + 1)))
    pairs = near.join(marks.withColumn("_row", row("ny")), [*page, "_row"])
    drop = F.col("y") - F.col("ny")
    beside = (F.abs(drop) < 0.02) & (F.col("nx") <= F.col("x") + 0.01)
    above = (drop > 0) & (drop < band)
    best = lambda cond: F.max(F.when(cond, F.struct("ny", "nx", "number")))
    found = pairs.filter(beside | above).groupBy(*page, "y", "x").agg(best(beside).alias("_b"), best(above).alias("_a"))
    answer = found.select(*page, "y", "x", F.coalesce("_b.number", "_a.number").alias("question"))
    return regions.join(answer, [*page, "y", "x"], "left")


def nearest_blank_fill(blanks: DataFrame, tokens: DataFrame, tol: float = 0.02) -> DataFrame:
    """Pair every blank with the unused token closest in x among those within tol in y, blanks in order.

    Both tables: (doc_id, block, page, pos, text, x, y, w, h).  In rounds, every blank asks the nearest token
    that has not refused it, and a token keeps the first blank of those that ask.  As all tokens prefer blanks
    in one order, this ends with what the blanks would take one after the other.  A noise token refuses
    nobody and fills nothing.
    """
    page = ["doc_id", "block", "page"]
    line = F.floor(F.col("y") / tol)
    left = blanks.select(*page, F.col("pos").alias("blank_pos"), F.col("x").alias("_bx"), F.col("y").alias("_by"), F.explode(F.array(line - 1, line, line + 1)).alias("_line"))
    right = tokens.select(*page, F.col("pos").alias("token_pos"), "x", "y", is_noise(F.col("text")).alias("noise"), line.alias("_line"))
    near = left.join(shuffled(right), [*page, "_line"]).filter(F.abs(F.col("y") - F.col("_by")) < tol)
    choice = F.row_number().over(Window.partitionBy(*page, "blank_pos").orderBy(F.abs(F.col("x") - F.col("_bx")), "token_pos"))
    wishes = written(near.select(*page, "blank_pos", "token_pos", "noise", choice.alias("nth")), "wishes")
    turn = wishes.filter("nth = 1").select(*page, "blank_pos", "nth")
    while True:
        asked = turn.join(shuffled(wishes), [*page, "blank_pos", "nth"])
        first = F.min("blank_pos").over(Window.partitionBy(*page, "token_pos"))
        asked = written(asked.withColumn("refused", ~F.col("noise") & (F.col("blank_pos") > first)), "asked")
        if asked.filter("refused").isEmpty():
            break
        turn = asked.select(*page, "blank_pos", (F.col("nth") + F.col("refused").cast("int")).alias("nth"))
    pairs = asked.filter("not noise").select("doc_id", "block", "blank_pos", "token_pos")
    filled = tokens.select("doc_id", "block", F.col("pos").alias("token_pos"), "page", "text", *BOX)
    shown = blanks.select("doc_id", "block", F.col("pos").alias("blank_pos"), F.col("text").alias("removed"))
    joined = pairs.join(shuffled(filled), ["doc_id", "block", "token_pos"]).join(shuffled(shown), ["doc_id", "block", "blank_pos"])
    return joined.withColumn("answer", trimmed(F.col("text"))).drop("text")


def token_diff_answers(exam: DataFrame, key: DataFrame, large: int = D.LARGE) -> DataFrame:
    """Answers in the stretches where a key differs from its exam.

    Both tables: (doc_id, pos, page, text, x, y, w, h), positions dense from 0.  They are compared token by
    token (``sequence_diff``).  A changed block whose exam side has blanks pairs each blank with the token at
    its place; any other block (or one without a single pair) is cut into lines.  Columns: doc_id, block
    (where it starts in the key), place, part, page, answer, removed, from_blank and the box.
    """
    ids = ["doc_id", "block"]
    blocks = written(D.sequence_changes(exam, key, large=large), "changes")
    removed = written(D.tokens_of(blocks, exam, "i1", "i2"), "removed")
    added = written(D.tokens_of(blocks, key, "j1", "j2"), "added")
    blanks = removed.filter(F.col("text").rlike("_{2,}"))
    pairs = written(nearest_blank_fill(blanks, added.join(shuffled(blanks.select(*ids).distinct()), ids, "left_semi")), "blank-pairs")
    paired = pairs.select(*ids, F.col("blank_pos").alias("place"), F.lit(0).cast("bigint").alias("part"), "page", "answer", "removed", F.lit(True).alias("from_blank"), *BOX)
    done = shuffled(pairs.select(*ids).distinct())
    lines = tokens_to_lines(added.join(done, ids, "left_anti"), ids).filter("n_words > 0")
    # the words a block replaces belong to one document row
    words = removed.join(done, ids, "left_anti").groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_w"))
    gone = words.select(*ids, trimmed(F.array_join(F.transform("_w", lambda w: w["text"]), " ")).alias("removed"))
    split = lines.join(shuffled(gone), ids, "left").select(
        *ids, F.col("line").cast("long").alias("place"), "part", "page", F.col("text").alias("answer"), F.coalesce("removed", F.lit("")).alias("removed"), F.lit(False).alias("from_blank"), *BOX
    )
    return paired.unionByName(split)


def answers_per_page(answers: DataFrame) -> DataFrame:
    return answers.groupBy("doc_id", "page").agg(F.count("*").alias("n"))


def page_layout_class(pages: DataFrame) -> DataFrame:
    """Kind of every page from its text length, drawings and images."""
    text = trimmed(F.col("text"))
    size = F.length(text)
    kind = (
        F.when((size > 200) & is_mojibake(text), "mojibake")
        .when(size > 200, "text")
        .when(F.col("n_draw") > 300, "outlined")
        .when((F.col("n_img") > 0) & (size < 50), "scanned")
        .otherwise("sparse")
    )
    return pages.withColumn("kind", kind)


def document_flags(docs: DataFrame) -> DataFrame:
    """Per document: image-based exam or key, and a key with hardly more words than its exam.

    ``docs``: (doc_id, exam_tokens, exam_images, key_tokens, key_images).
    """
    heavy = lambda s: F.col(f"{s}_images") > F.greatest(F.col(f"{s}_tokens"), F.lit(30))
    mixed = lambda s: ~heavy(s) & (F.col(f"{s}_images") > F.col(f"{s}_tokens") * 0.15)
    any_heavy = heavy("exam") | heavy("key")
    empty = ~any_heavy & (F.col("key_tokens") - F.col("exam_tokens") < 5)
    return docs.select(
        "doc_id", heavy("exam").alias("exam_image_based"), heavy("key").alias("key_image_based"),
        mixed("exam").alias("exam_has_images"), mixed("key").alias("key_has_images"), empty.alias("key_not_filled"),
    )


def page_kind_summary(classified: DataFrame, numbers: DataFrame, matched: DataFrame) -> DataFrame:
    """Per document: dominant page kind (first seen wins ties), pages, distinct numbers, regions and orphans."""
    kinds = classified.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.min("page").alias("first"))
    layer = kinds.groupBy("doc_id").agg(
        F.max_by("kind", F.struct(F.col("n"), -F.col("first"))).alias("layer"), F.sum("n").alias("pages")
    )
    nums = numbers.groupBy("doc_id").agg(F.count_distinct("number").alias("numbers"))
    regs = matched.groupBy("doc_id").agg(F.count("question").alias("regions"), F.count_if(F.col("question").isNull()).alias("orphans"))
    out = layer.join(nums, "doc_id", "left").join(regs, "doc_id", "left")
    return out.na.fill(0, ["numbers", "regions", "orphans"])


def parse_answer_lines(texts: DataFrame) -> DataFrame:
    """Numbered answers in key texts: '1. 정답: ②' lines and number / prompt / answer on three lines.

    Lines are read off the document's own row, so looking two lines ahead needs no window.
    """
    lines = texts.select("doc_id", F.transform(F.split("text", "\n"), lambda x: trimmed(x)).alias("_l"))
    triple = F.transform("_l", lambda x, i: F.struct(i.alias("i"), x.alias("a"), F.get("_l", i + 1).alias("b"), F.get("_l", i + 2).alias("c")))
    rows = lines.select("doc_id", F.inline(triple))
    told = r"[(\[]?([0-9]{1,3})[)\].]?\s*정답\s*[:：]\s*(.+?)\s*$"
    bare = r"^([0-9]{1,3})[.)]$"
    explained = rows.filter(F.col("a").rlike(told)).select(
        "doc_id", F.col("i").alias("line"), F.lit("explained").alias("form"), F.regexp_extract("a", told, 1).cast("int").alias("number"),
        F.lit(None).cast("string").alias("prompt"), trimmed(F.regexp_extract("a", told, 2)).alias("answer"),
    )
    full = F.col("a").rlike(bare) & (F.col("b") != "") & (F.col("c") != "") & ~F.col("c").rlike(bare)
    parallel = rows.filter(F.coalesce(full, F.lit(False))).select(
        "doc_id", F.col("i").alias("line"), F.lit("parallel").alias("form"), F.regexp_extract("a", bare, 1).cast("int").alias("number"),
        F.col("b").alias("prompt"), F.col("c").alias("answer"),
    )
    return explained.unionByName(parallel)


def exam_key_pairing(exams: DataFrame, keys: DataFrame) -> DataFrame:
    """Exam files with the key file of the same level and chapter; the first key by name counts."""
    pdf = lambda df: df.filter(F.lower("file").endswith(".pdf"))
    numbered = pdf(keys).withColumn("chapter", FF.chapter_number(F.col("file"))).filter("chapter is not null")
    first = numbered.groupBy("level", "chapter").agg(F.min("file").alias("key_file"))
    chapters = pdf(exams).withColumn("chapter", F.coalesce(FF.chapter_number(F.col("file")), F.lit(0)))
    return chapters.join(first, ["level", "chapter"], "left")


def extraction_audit(units: DataFrame) -> DataFrame:
    """Better of two extraction counts per unit with its bucket and minutes. ``units``: (level, chapter, file, n_hidden, n_diff)."""
    hidden = F.col("n_hidden") >= F.col("n_diff")
    n = F.greatest("n_hidden", "n_diff")
    graded = lambda a, b, c, d: F.when(n >= 25, a).when(n >= 10, b).when(n >= 1, c).otherwise(d)
    method = F.when(n < 1, "—").when(hidden, "숨은정답").otherwise("정답지차분")
    return units.withColumns({
        "n": n, "method": method, "bucket": graded("완전자동", "대부분자동", "일부만", "수동"), "minutes": graded(2, 5, 12, 20)
    })


def extraction_rollup(audit: DataFrame) -> DataFrame:
    """Per level and in total: units per bucket, answers and minutes."""
    b = F.col("bucket")
    return audit.rollup("level").agg(
        F.count("*").alias("units"),
        F.count_if(b == "완전자동").alias("full"), F.count_if(b == "대부분자동").alias("mostly"),
        F.count_if(b == "일부만").alias("partly"), F.count_if(b == "수동").alias("manual"),
        F.sum("n").alias("answers"), F.sum("minutes").alias("minutes"),
    )
