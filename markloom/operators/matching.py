"""Which answer key belongs to a sheet: equal title, similar title, shared prompts.

Similarity candidates come from prefix filtering: with a floor on the score, two token sets must
share one of the rarest tokens of the set, so only rare tokens are joined and frequent ones are
never paired with each other. Every pair at or above the floor is found; the floors lie one
decision margin below the thresholds, so no decision can depend on a pair below them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions import titles as T
from markloom.functions.money import round2
from markloom.functions.text import norm
from markloom.operators import sequences as S
from markloom.session import shuffled, written

TITLE_FLOOR = K.TITLE_MIN - K.TITLE_MARGIN
PROMPT_FLOOR = K.PROMPT_MIN - K.PROMPT_MARGIN


def exact_title_match(sheets: DataFrame, keys: DataFrame) -> DataFrame:
    """(sheet_id, slug, key_title) where the normalised titles are equal; the slug match comes first."""
    normed = keys.withColumn("_norm", norm(F.col("title")))
    texts = normed.select(
        "slug", F.col("title").alias("key_title"), F.explode(F.array_distinct(F.array("slug", "_norm"))).alias("_text")
    )
    pick = F.min_by(F.struct("slug", "key_title"), F.struct(F.col("slug") != F.col("_text"), F.col("slug"))).alias("_k")
    by_text = texts.filter("_text <> ''").groupBy("_text").agg(pick)
    titled = sheets.select("sheet_id", norm(F.col("title")).alias("_text")).filter("_text <> ''")
    return titled.join(by_text, "_text").select("sheet_id", "_k.slug", "_k.key_title")


def _shape(df: DataFrame, ident: str, text: str) -> DataFrame:
    return (
        df.withColumn("_pairs", T.letter_pairs(F.col(text)))
        .withColumn("_nums", T.title_numbers(F.col(text)))
        .withColumn("_sig", F.array_join(F.sort_array("_nums").cast("array<string>"), ","))
        .select(*dict.fromkeys([ident, text]), "_pairs", "_nums", "_sig")
    )


def _letter_floor(numbers: Column, floor: float) -> Column:
    """Least Dice that can still reach the floor when the two number sets differ.

    m numbers overlap a different set by at most m/(m+1); without numbers the score is the Dice itself.
    """
    m = F.size(numbers)
    best = m.cast("double") / (m + 1)
    return F.when(m == 0, F.lit(floor)).otherwise(F.least(F.lit(floor), (floor - K.NUMBER_WEIGHT * best) / K.LETTER_WEIGHT))


def _rare_tokens(df: DataFrame, ident: str, freq: DataFrame, floor: float) -> DataFrame:
    """(ident, token): the rarest tokens of each title, enough of them that no qualifying partner is missed."""
    tokens = df.select(ident, F.explode("_pairs").alias("token")).join(freq, "token")
    ranked = tokens.groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("_sorted"))
    d = _letter_floor(F.col("_nums"), floor)
    n = F.size("_sorted")
    need = F.greatest(F.ceil(n * d / (2 - d) - F.lit(1e-9)), F.lit(1))
    keep = df.select(ident, "_nums").join(ranked, ident).withColumn("_keep", (n - need + 1).cast("int"))
    return keep.select(ident, F.explode(F.slice("_sorted", F.lit(1), F.col("_keep"))).alias("_t")).select(ident, "_t.token")


def title_similarity_join(sheets: DataFrame, keys: DataFrame, floor: float = TITLE_FLOOR) -> DataFrame:
    """(title, slug, score) for every distinct normalised sheet title and key scoring at least ``floor``.

    Works on distinct titles, so a class of thousands with one exam costs one row. A title is one
    short string, so its token list is bounded by its own length.
    """
    titles = sheets.select("title").distinct().select(norm(F.col("title")).alias("_a")).filter("_a <> ''").distinct()
    named = keys.dropDuplicates(["slug"]).select("slug", norm(F.col("title")).alias("_b")).filter("_b <> ''")
    left, right = written(_shape(titles, "_a", "_a"), "sheet-titles"), written(_shape(named, "slug", "_b"), "key-titles")
    all_tokens = left.select(F.explode("_pairs").alias("token")).unionAll(right.select(F.explode("_pairs").alias("token")))
    freq = all_tokens.groupBy("token").agg(F.count("*").alias("freq"))
    by_token = _rare_tokens(left, "_a", freq, floor).join(_rare_tokens(right, "slug", freq, floor), "token").select("_a", "slug")
    same_numbers = left.filter("_sig <> ''").select("_a", "_sig").join(right.select("slug", "_sig"), "_sig").select("_a", "slug")
    candidates = by_token.unionAll(same_numbers).distinct()
    a = left.select("_a", F.col("_pairs").alias("_pa"), F.col("_nums").alias("_na"))
    b = right.select("slug", "_b", F.col("_pairs").alias("_pb"), F.col("_nums").alias("_nb"))
    pairs = candidates.join(a, "_a").join(b, "slug")
    shared = F.size(F.array_intersect("_na", "_nb"))
    score = T.blend(F.col("_a") == F.col("_b"), T.dice(F.col("_pa"), F.col("_pb")), shared, F.size("_na"), F.size("_nb"))
    return pairs.select(F.col("_a").alias("title"), "slug", score.alias("score")).filter(F.col("score") >= floor)


def _prompt_sets(items: DataFrame, ident: str) -> DataFrame:
    """Distinct filled prompts per owner."""
    return written(items.select(ident, norm(F.col("prompt")).alias("prompt")).filter("prompt <> ''").distinct(), "prompt-sets")


def _sums(*columns: str) -> list[Column]:
    """Number and two independent 64-bit hashes of a group's rows, summed by halves; they combine map-side in any order."""
    out = [F.count("*").alias("_n")]
    for k, h in enumerate((F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns))):
        out += [F.sum(h.bitwiseAND(0xFFFFFFFF)).alias(f"_l{k}"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"_u{k}")]
    return out


_SAME = ["_n", "_l0", "_u0", "_l1", "_u1"]


def _members(sets: DataFrame, ident: str, value: str, rep: str) -> DataFrame:
    """(ident, rep, size): ``rep`` is the same for owners of equal sets, which are told apart by their sums.

    Rows that come more than once count as often, so ``sets`` may also be lists: then ``size`` is their length.
    """
    marked = written(sets.groupBy(ident).agg(*_sums(value)), "set-sums")
    return written(marked.join(marked.groupBy(*_SAME).agg(F.min(ident).alias(rep)), _SAME).select(ident, rep, F.col("_n").alias("size")), "members")


def _rare_prompts(sets: DataFrame, ident: str, floor: float) -> DataFrame:
    """Rarest prompts of each set: one of them must be shared by any partner that covers ``floor`` of the set."""
    mixed = sets.withColumn("_h", F.xxhash64("prompt"))
    bucket = F.struct("freq", F.shiftright("_h", 54))
    ranked = S.position(mixed, [ident], ["freq", "_h", "prompt"], bucket, "_pos")
    keep = F.col("size") - F.ceil(F.col("size") * F.lit(floor) - F.lit(1e-9)) + 1
    return ranked.filter(F.col("_pos") < keep).select(ident, "prompt", F.col("size"))


def prompt_lists(sheet_items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sheet_id, list) and (list, prompt): sheets with one list of prompts (a class that sat one exam) are one from the start.

    Their prompts are summed up where they lie, and only one sheet's leave their tasks.
    """
    twins = _members(sheet_items, "sheet_id", "prompt", "twin")
    first = twins.filter("sheet_id = twin").select("sheet_id")
    # not normalised yet: otherwise Spark normalises the prompts of all sheets before it drops those of the twins
    own = sheet_items.select("sheet_id", "prompt").join(first, "sheet_id", "left_semi")
    return twins.select("sheet_id", F.col("twin").alias("list")), own.withColumnRenamed("sheet_id", "list")


def prompt_overlap_join(
    sheet_items: DataFrame, key_items: DataFrame, floor: float = PROMPT_FLOOR, common: int = 64, lists: DataFrame | None = None
) -> DataFrame:
    """(sheet_id, slug, hits, ratio) where shared distinct prompts cover at least ``floor`` of the smaller set.

    ``lists``: (sheet_id, list), where it is known beforehand which sheets have one list of prompts; ``sheet_items`` is
    then (list, prompt), so no list is spelled out for each of its sheets.  Otherwise it is (sheet_id, prompt).
    """
    if lists is None:
        lists, sheet_items = prompt_lists(sheet_items)
    found = list_overlap_join(sheet_items, key_items, floor, common)
    return shuffled(lists.select("sheet_id", "list")).join(found, "list").select("sheet_id", "slug", "hits", "ratio")


def list_overlap_join(list_items: DataFrame, key_items: DataFrame, floor: float = PROMPT_FLOOR, common: int = 64) -> DataFrame:
    """(list, slug, hits, ratio) where shared distinct prompts cover at least ``floor`` of the smaller set.

    Lists of one set are compared once.  Prompts that stand in the
    same keys are one token class: a list has a class with the number of its prompts in it, and the keys of a
    class are joined once, however many prompts it has.  Classes of at most ``common`` keys are joined and
    their weights added, which grows linearly with the lists.  More frequent prompts are only looked up for
    pairs that can still reach the floor; sets made mostly of such prompts get their candidates from their
    rarest prompts instead.  Every qualifying pair is found whatever ``common`` is.
    """
    own = written(list_items.select("list", "prompt").distinct(), "own-prompts")
    list_sets, key_sets = _prompt_sets(own, "list"), _prompt_sets(key_items, "slug")
    members, owners = _members(list_sets, "list", "prompt", "rep"), key_sets.groupBy("slug").agg(F.count("*").alias("size"))
    heads = members.filter("list = rep").select("list", "size")
    classes = _members(key_sets, "prompt", "slug", "class").select("prompt", "class", F.col("size").alias("freq"))
    # prompts of no key cannot be shared, but they count in the set's size
    a = written(list_sets.join(heads, "list").join(classes, "prompt"), "list-prompts")
    b = written(key_sets.join(owners, "slug").join(classes, "prompt"), "key-prompts")
    hot = F.col("freq") > common
    pair = ["list", "slug"]

    def sizes(df: DataFrame, ident: str, side: str) -> DataFrame:
        return df.groupBy(ident).agg(F.first("size").alias(f"size_{side}"), F.count_if(hot).alias(f"hot_{side}"))

    size_a, size_b = sizes(a, "list", "a"), sizes(b, "slug", "b")
    held = a.filter(~hot).groupBy("list", "class").agg(F.count("*").alias("weight"))
    posted = b.filter(~hot & (F.col("prompt") == F.col("class"))).select("class", "slug")
    direct = held.join(posted, "class").groupBy(*pair).agg(F.sum("weight").alias("rare"))

    mostly = F.count_if(hot) >= F.first("size") * F.lit(floor)
    hot_a = a.groupBy("list").agg(mostly.alias("_m")).filter("_m").select("list")
    hot_b = b.groupBy("slug").agg(mostly.alias("_m")).filter("_m").select("slug")
    first_a = _rare_prompts(a.join(hot_a, "list", "left_semi"), "list", floor)
    first_b = _rare_prompts(b.join(hot_b, "slug", "left_semi"), "slug", floor)
    from_a = first_a.join(b.select("slug", "prompt", F.col("size").alias("_s")), "prompt").filter("size <= _s").select(*pair)
    from_b = first_b.join(a.select("list", "prompt", F.col("size").alias("_s")), "prompt").filter("size < _s").select(*pair)
    loose = from_a.unionAll(from_b).distinct().withColumn("rare", F.lit(0).cast("bigint"))
    found = direct.unionAll(loose).groupBy(*pair).agg(F.max("rare").alias("rare"))
    sized = found.join(size_a, "list").join(size_b, "slug")
    smaller = F.least("size_a", "size_b")
    reach = F.col("rare") + F.least("hot_a", "hot_b")
    open_pairs = written(sized.filter(reach >= smaller * F.lit(floor) - F.lit(1e-9)), "open-pairs")
    needs = (F.col("hot_a") > 0) & (F.col("hot_b") > 0)
    held = a.filter(hot).groupBy("list", "class").agg(F.count("*").alias("weight"))
    posted = b.filter(hot & (F.col("prompt") == F.col("class"))).select("class", "slug")
    extra = open_pairs.filter(needs).select(*pair).join(held, "list").join(posted, ["slug", "class"]).groupBy(*pair).agg(F.sum("weight").alias("more"))
    hits = F.col("rare") + F.coalesce("more", F.lit(0))
    done = open_pairs.join(extra, pair, "left").withColumn("hits", hits).withColumn("ratio", hits.cast("double") / smaller)
    kept = done.filter(F.col("ratio") >= floor).select(F.col("list").alias("rep"), "slug", "hits", "ratio")
    return members.select("list", "rep").join(kept, "rep").select("list", "slug", "hits", "ratio")


def top2_margin(scored: DataFrame, keys: list[str], score: str, ident: str = "slug") -> DataFrame:
    """Best candidate per key, the score of the runner-up (NULL when alone) and the gap."""
    top = S.first_rows(scored, keys, [F.col(score).desc(), F.col(ident)], 2, rank="_k")
    best = F.max(F.when(F.col("_k") == 1, F.struct(score, ident, *[c for c in scored.columns if c not in (*keys, score, ident)])))
    folded = top.groupBy(*keys).agg(best.alias("_best"), F.max(F.when(F.col("_k") == 2, F.col(score))).alias("runner_up"))
    extra = [F.col(f"_best.{c}").alias(c) for c in scored.columns if c not in keys]
    return folded.select(*keys, *extra, "runner_up").withColumn("margin", F.col(score) - F.col("runner_up"))


def ambiguous_top3(title_scores: DataFrame, keys: DataFrame) -> DataFrame:
    """Up to three keys per title that reach the title threshold, best first."""
    near = title_scores.filter(F.col("score") >= K.TITLE_MIN)
    top = S.first_rows(near, ["title"], [F.col("score").desc(), F.col("slug")], 3, rank="place")
    named = top.join(keys.select("slug", F.col("title").alias("key_title")), "slug")
    return named.select("title", "place", "slug", "key_title", round2(F.col("score")).alias("score"))


def match_answer_key(
    sheets: DataFrame, sheet_items: DataFrame, keys: DataFrame, key_items: DataFrame, lists: DataFrame | None = None
) -> DataFrame:
    """One row per sheet: slug, how, score, rival_score, why and the candidates that were too close to call.

    An equal title wins outright. Otherwise shared prompts beat a similar title, and when the two
    point to different keys nothing is chosen. ``rival_score`` is NULL when no other key comes
    within reach of the threshold.  ``lists`` and ``sheet_items`` are as in ``prompt_overlap_join``; the best key by
    prompts is chosen once a list.
    """
    exact = exact_title_match(sheets, keys)
    others = sheets.join(shuffled(exact.select("sheet_id")), "sheet_id", "left_anti")
    rest = written(others.select("sheet_id", norm(F.col("title")).alias("_title")), "other-sheets")
    named = keys.select("slug", F.col("title").alias("key_title"))

    titles = written(title_similarity_join(rest.select(F.col("_title").alias("title")), keys), "title-scores")
    best_title = top2_margin(titles, ["title"], "score").filter(
        (F.col("score") >= K.TITLE_MIN) & (F.col("runner_up").isNull() | (F.col("margin") >= K.TITLE_MARGIN))
    )
    t = best_title.join(named, "slug").select(
        F.col("title").alias("_title"), F.struct("slug", "key_title", "score", "runner_up").alias("t")
    )
    near = ambiguous_top3(titles, keys).groupBy("title").agg(
        F.sort_array(F.collect_list(F.struct("place", F.col("key_title").alias("title"), "score"))).alias("near")
    ).withColumnRenamed("title", "_title")

    if lists is None:
        lists, sheet_items = prompt_lists(sheet_items.join(rest.select("sheet_id"), "sheet_id", "left_semi"))
    best_prompt = top2_margin(list_overlap_join(sheet_items, key_items), ["list"], "ratio").filter(
        (F.col("ratio") >= K.PROMPT_MIN)
        & (F.col("hits") >= K.PROMPT_MIN_COUNT)
        & (F.col("runner_up").isNull() | (F.col("margin") >= K.PROMPT_MARGIN))
    )
    p = best_prompt.join(named, "slug").select(
        "list", F.struct("slug", "key_title", F.col("ratio").alias("score"), "runner_up", "hits").alias("p")
    )
    listed = rest.join(shuffled(lists.select("sheet_id", "list")), "sheet_id", "left")
    both = listed.join(t, "_title", "left").join(near, "_title", "left").join(p, "list", "left")
    conflict = F.col("t").isNotNull() & F.col("p").isNotNull() & (F.col("t.slug") != F.col("p.slug"))
    kind = (
        F.when(F.coalesce(conflict, F.lit(False)), F.lit(None).cast("string"))
        .when(F.col("p").isNotNull(), F.lit(K.HOW_PROMPTS))
        .when(F.col("t").isNotNull(), F.lit(K.HOW_NEAR))
    )
    decided = both.withColumn("how", kind)
    is_p, is_t = F.col("how") == K.HOW_PROMPTS, F.col("how") == K.HOW_NEAR

    def pick(field: str) -> Column:
        return F.when(is_p, F.col(f"p.{field}")).when(is_t, F.col(f"t.{field}"))

    percent = F.floor(F.col("t.score") * 100 + 0.5).cast("string")
    why = F.when(
        is_p, F.concat(F.lit("제목은 못 맞췄지만 제시어 "), F.col("p.hits").cast("string"), F.lit("개가 「"), F.col("p.key_title"), F.lit("」과 같습니다."))
    ).when(is_t, F.concat(F.lit("제목이 「"), F.col("t.key_title"), F.lit("」과 비슷합니다 ("), percent, F.lit("%).")))
    entry = lambda s: F.struct(s["key_title"].alias("title"), round2(s["score"]).alias("score"))
    empty = F.array().cast("array<struct<title:string,score:double>>")
    listed = F.transform("near", lambda x: F.struct(x["title"].alias("title"), x["score"].alias("score")))
    rivals = (
        F.when(F.coalesce(conflict, F.lit(False)), F.array(entry(F.col("t")), entry(F.col("p"))))
        .when(F.col("how").isNull(), F.coalesce(listed, empty))
        .otherwise(empty)
    )
    found = decided.select(
        "sheet_id", pick("slug").alias("slug"), "how", round2(pick("score")).alias("score"),
        round2(pick("runner_up")).alias("rival_score"), why.alias("why"), rivals.alias("ambiguous"),
    )
    equal = exact.select(
        "sheet_id", "slug", F.lit(K.HOW_TITLE).alias("how"), F.lit(1.0).alias("score"), F.lit(0.0).alias("rival_score"),
        F.concat(F.lit("제목이 「"), "key_title", F.lit("」과 같습니다.")).alias("why"), empty.alias("ambiguous"),
    )
    return equal.unionByName(found)
