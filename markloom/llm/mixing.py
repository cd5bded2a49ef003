"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources weigh 5, 2, 1, repeating in the order of their names, and share the total size; a target
stops at ``most`` times its source's size and the excess is shared again by weight.  Documents are cut into
blocks of at most ``block_words`` words.  Every source's blocks have a random order (by hash).  Reading
that order again and again up to the target gives the exact number of blocks, the source's quota.  A binary
tree over the output shards splits the quotas: a node deals its quotas to its halves by multivariate
hypergeometric draws, so each shard gets what a shuffle of the whole mix would give it.  Shards take
successive, disjoint stretches of the permuted blocks and shuffle them locally.

All draws follow from the seed and what a row holds: hashes of all its columns and its number among equal
rows, which are interchangeable.  Neither splits of a read, nor partitions, nor a rewritten table change them.

The tree is made of sums per source only (sources times shards rows), grown LEVELS levels a round on the
executors.  A source that holds much of the table is ordered in hash buckets, never in one task.

Defined cases: a null text has size 0 and is not taken; null is a source of its own, last in order; a source
of size 0 has target 0; repeated rows are separate documents; an empty table gives no rows; other columns
are ignored by the query (but for their part in the seed of a row's draws) and kept by ``drawn``; columns
of maps take no part in a row's draws.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm.common import SPACE, body, free_name, numbered, ranked, written

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
BLOCK_WORDS, SHARD_BLOCKS = 64, 4096
#: Levels of the tree in one round; bits of a draw that choose its bucket.
LEVELS, BUCKET_BITS = 4, 12
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.regexp_count(body(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` from one row per source; sorting and running sums of that table.

    With sources in order of capacity per weight, those whose capacity stays below the level that fills
    the total are capped and the others share the rest by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weigh = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weigh).withColumn("cap", MOST * F.col("source_size"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = weighed.withColumn("_level", level).withColumn("_open", F.col("cap") > F.col("weight") * F.col("_level") * (1 + 1e-12))
    first_open = F.min(F.when(F.col("_open"), F.struct(F.col("cap") / F.col("weight"), F.col("_level").alias("level")))).over(whole)
    return ranked.withColumn("_shared", first_open["level"]).select(
        "source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("_shared")), F.col("cap")).cast("double").alias("target")
    )


def codes(docs: DataFrame, seed: int) -> list[Column]:
    """Two hashes of all that a row holds."""
    held = [F.col(f"`{f.name}`") for f in sorted(docs.schema.fields, key=lambda f: f.name) if "map<" not in f.dataType.simpleString()]
    return [F.xxhash64(F.lit(seed), *held).alias("code_a"), F.xxhash64(F.lit(~seed), *held).alias("code_b")]


def blocks_of(rows: DataFrame, block_words: int, seed: int = 10) -> DataFrame:
    """``(row, source, block, words, draw, more)``: documents of ``size`` words cut into blocks, with draws of
    each block from the codes of its row and its number among equal rows."""
    n = F.ceil(F.col("size") / block_words)
    told = ranked(rows.filter("size > 0"), ["code_a", "code_b"], ["row"], "nth")
    cut = told.select("row", "source", "size", "code_a", "code_b", "nth", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
    draws = [F.xxhash64(F.lit(x), "code_a", "code_b", "nth", "block").alias(name) for x, name in ((seed, "draw"), (~seed, "more"))]
    return cut.select("row", "source", "block", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words).alias("words"), *draws)


def permuted(blocks: DataFrame) -> DataFrame:
    """Blocks with their place in their source's random order: blocks (``rank``) and words (``before``) ahead.

    The order is that of the draws as unsigned numbers; their first bits are the bucket.
    """
    dealt = blocks.withColumn("_bucket", F.shiftrightunsigned("draw", 64 - BUCKET_BITS))
    sums = dealt.groupBy("source", "_bucket").agg(F.count("*").alias("_n"), F.sum("words").alias("_words"))
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select(
        F.col("source").alias("_source"), F.col("_bucket").alias("_in"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n"), F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_words")
    )
    inside = Window.partitionBy("source", "_bucket").orderBy("draw", "more")
    own = dealt.withColumn("_at", F.row_number().over(inside) - 1).withColumn("_sum", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    both = own.join(firsts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_in")))
    return both.select(*blocks.columns, (F.col("_n") + F.col("_at")).alias("rank"), (F.col("_words") + F.col("_sum") - F.col("words")).alias("before"))


def repeated(blocks: DataFrame, goals: DataFrame) -> DataFrame:
    """Add ``times``: how often the random order, read again and again, passes the block before the target.

    A block counts when its middle lies before the target, so a source misses its target by half a block.
    """
    goal = goals.select(F.col("source").alias("_source"), "source_size", "source_blocks", "target")
    joined = blocks.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ahead = F.col("target") - F.col("before") - F.col("words") / 2
    times = F.greatest(F.lit(0), F.ceil(ahead / F.col("source_size"))).cast("int")
    return joined.withColumn("times", times).drop("source_size", "target", "before")


def _split(seed: int):
    def halves(number: int, node: pd.DataFrame, levels: int) -> list[pd.DataFrame]:
        """Quotas of a node's halves, down some levels; the left one gets its share of all blocks, drawn
        without return."""
        shards, quota = int(node["shards"].iloc[0]), node["quota"].to_numpy(np.int64)
        if shards == 1 or not levels:
            return [node]
        left, total = shards // 2, int(quota.sum())
        draws, rng = np.zeros(len(quota), np.int64), np.random.default_rng([seed, number])
        need, rest = total * left // shards, total
        for i, n in enumerate(quota.tolist()):
            rest -= n
            draws[i] = hypergeometric(rng, n, rest, need)
            need -= int(draws[i])
        one = node.assign(node=2 * number, shards=left, quota=draws)
        two = node.assign(node=2 * number + 1, shards=shards - left, quota=quota - draws, shard=node["shard"] + left, first=node["first"] + draws)
        return [*halves(2 * number, one, levels - 1), *halves(2 * number + 1, two, levels - 1)]

    def run(key: tuple, node: pd.DataFrame) -> pd.DataFrame:
        order = node["source"].map(lambda s: (s is None, (s or "").encode()))
        return pd.concat(halves(int(key[0]), node.loc[order.sort_values().index], LEVELS))

    return run


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int, limit: int = 10**9) -> int:
    """How many of ``drawn`` balls are good.  Numpy draws below its limit; above, every ball gets a number in
    [0, 1) and the smallest are drawn: binomials say how many balls of each kind are below a half, and the
    draw goes on in the half that holds the last ball drawn, until that is small.  This is exact."""
    taken = 0
    while good and drawn and good + bad >= limit:
        low, low_bad = int(rng.binomial(good, 0.5)), int(rng.binomial(bad, 0.5))
        if low + low_bad >= drawn:
            good, bad = low, low_bad
        else:
            taken, good, bad, drawn = taken + low, good - low, bad - low_bad, drawn - low - low_bad
    return taken + (int(rng.hypergeometric(good, bad, drawn)) if good and drawn else 0)


def splitting_tree(quotas: DataFrame, seed: int, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """``(source, shard, first, quota)``: the stretch of its permuted blocks that every source gives a shard.

    ``quotas`` has one row per source.  The number of shards follows the total; the tree has its binary
    logarithm of levels.
    """
    total = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_blocks))
    level = quotas.select("source", F.lit(1).cast("long").alias("node"), F.lit(shards).cast("long").alias("shards"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("first"), F.col("quota").cast("long").alias("quota"))
    split = _split(seed)
    for _ in range(0, (shards - 1).bit_length(), LEVELS):
        inner = level.filter("shards > 1").groupBy("node").applyInPandas(split, level.schema)
        level = written(level.filter("shards = 1").union(inner), "tree")
    return level.filter("quota > 0").select("source", "shard", "first", "quota")


def chosen(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with sizes, source targets, and blocks with ``rank`` and ``times``; all as tables."""
    return _chosen(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text", *codes(docs, seed)), block_words, seed)


def _chosen(docs: DataFrame, block_words: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``chosen`` of rows that have their number and codes, which are read once."""
    rows = written(docs.select("row", "doc_id", "source", n_words().alias("size"), "code_a", "code_b"), "sizes")
    n_blocks = F.sum(F.ceil(F.col("size") / block_words)).alias("source_blocks")
    sums = written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), n_blocks), "sources")
    same = F.col("source").eqNullSafe(F.col("_source"))
    goals = written(targets(sums).join(sums.select(F.col("source").alias("_source"), "source_blocks"), same).drop("_source"), "targets")
    blocks = repeated(permuted(blocks_of(rows, block_words, seed)), goals)
    return rows, goals, written(blocks.filter("times > 0"), "blocks")


def shard_draws(blocks: DataFrame, seed: int = 10, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """``(row, source, block, words, epoch, shard, place)``: every draw of a block, its shard and its place
    in the shard's local shuffle.

    Draws of a source are numbered epoch by epoch in its permuted order (all epochs but the last take all of
    its blocks); the tree says which stretch of numbers is whose.  Blocks find their stretch through their
    coarse number, so a source of many shards is joined on more than its name.
    """
    width = max(1, shard_blocks // 64)
    quotas = written(blocks.groupBy("source").agg(F.sum("times").alias("quota")), "quotas")
    epochs = F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch")
    draws = blocks.select("row", "source", "block", "words", "draw", "more", "rank", "source_blocks", epochs)
    numbered = draws.withColumn("number", F.col("epoch") * F.col("source_blocks") + F.col("rank"))
    tree = splitting_tree(quotas, seed, shard_blocks)
    spans = tree.select(
        F.col("source").alias("_source"), "shard", F.col("first").alias("_first"), F.col("quota").alias("_quota"),
        F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("quota") - 1) / width))).alias("_coarse"),
    )
    found = numbered.withColumn("_c", F.floor(F.col("number") / width)).join(spans, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_c") == F.col("_coarse")))
    inside = (F.col("number") >= F.col("_first")) & (F.col("number") < F.col("_first") + F.col("_quota"))
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "draw", "more", "epoch"), "draw", "more", "epoch")
    return found.filter(inside).select("row", "source", "block", "words", "epoch", "shard", (F.row_number().over(local) - 1).alias("place"))


def mix_digest(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 10, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """``doc_id, size, source_size, target, taken, first_shard`` of every document; ``first_shard`` is the
    smallest output shard that got some of its blocks, null if none did."""
    rows, goals, blocks = chosen(docs, block_words, seed)
    drawn = shard_draws(blocks, seed, shard_blocks)
    taken = drawn.groupBy("row").agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"))
    goal = goals.select(F.col("source").alias("_source"), "source_size", "target")
    return rows.join(goal, F.col("source").eqNullSafe(F.col("_source"))).join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard"
    )


def drawn(docs: DataFrame, block_words: int, seed: int = 10, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mix as rows of the input's columns: one per document, epoch and shard, with the text of the blocks
    drawn there, white space kept.  Other columns repeat.  Rows come shard by shard, in the order of each
    shard's local shuffle; a shard is never parted."""
    row, held, shard, place = (free_name(docs, x) for x in ("row", "blocks", "shard", "place"))
    keyed = numbered(docs, row)
    _, _, blocks = _chosen(keyed.select(F.col(row).alias("row"), "doc_id", "source", "text", *codes(docs, seed)), block_words, seed)
    parts = shard_draws(blocks, seed, shard_blocks).groupBy("row", "epoch", "shard").agg(F.sort_array(F.collect_list("block")).alias("blocks"), F.min("place").alias("place"))
    parts = parts.select(F.col("row").alias(row), F.col("blocks").alias(held), F.col("shard").alias(shard), F.col("place").alias(place))
    one_block = rf"(?:{SPACE.rstrip('+')}*+{WORD}+){{1,{block_words}}}+(?:{SPACE}$)?"
    cut = F.regexp_extract_all(F.col("text"), F.lit(one_block), F.lit(0))
    whole = F.size(held) == F.ceil(n_words() / block_words)
    text = F.when(whole, F.col("text")).otherwise(F.array_join(F.transform(held, lambda b: F.element_at(cut, (b + 1).cast("int"))), ""))
    mixed = keyed.join(parts, row).withColumn("text", text)
    return mixed.repartition(shard).sortWithinPartitions(shard, place).select(*docs.columns)
