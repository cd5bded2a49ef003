"""Near duplicates: multi-index Hamming join of MinHash signatures, confirmed on full shingle sets.

A signature holds LANES = 100 16-bit MinHash values in CHUNKS = 20 chunks of five.  Documents get a key for
every chunk and left-out lane (100 keys of four lanes), so two signatures meet in some bucket whenever one
chunk has at most one differing lane.  By pigeonhole that is certain up to FAR = 39 lanes, and pairs that meet
are compared in full up to there.  Lanes of a pair with a Jaccard similarity of 0.8 differ with probability
0.2, so it lies beyond with a probability of about 3e-6.

Buckets are never expanded into pairs.  Work goes in rounds: each open bucket names a document as hub, every
document is compared with the hub it meets most often, and what links is one class from then on; a bucket
whose documents are of one class is closed.  When a round closes less than a fifth of what was open, the rest is
compared: small buckets by pairs, large ones in tiles of about TILE documents of one large class, or of small
classes that have the largest class they meet in common; each pair of tiles that meet once, however many
buckets they meet in.  Signatures come before texts, and each
comparison hands on a spanning set of links.  A family of copies, however large, spreads over its tiles.
Documents with equal sets are one document from the start.

Defined cases: null texts and texts without words have no set and link to nothing; one word is a set of
one; repeated rows link to each other; ``component_id`` is the smallest non-null id of the component; rows
of a component without any id have none; an empty table gives no rows; other columns are ignored.
Texts are read again for comparison, by numbers that do not depend on how a read is split.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm.common import body, components, free_name, numbered, written
from markloom.llm.words import joined, mix, released, text_column, word_hashes

LANES, CHUNKS, FAR = 100, 20, 39
WIDTH, LONGS = LANES // CHUNKS, LANES // 4
TILE, PART, SMALL = 512, 128, 16
_RANDOM = np.random.default_rng(80)
_TIMES = _RANDOM.integers(1, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(1, 1 << 63, LANES, dtype=np.uint64)
ROW = "row long, doc_id long, n_shingles long, code_a long, code_b long, sig array<long>"


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles; fewer words make one shingle."""
    for words in word_hashes(texts, lower=True):
        shingles = joined(words, min(k, len(words))) if len(words) else words
        shingles = np.sort(shingles)
        yield shingles[np.append(True, shingles[1:] != shingles[:-1])] if len(shingles) > 1 else shingles


def signature(items: np.ndarray) -> np.ndarray:
    """The 16-bit lanes of a set of hashes."""
    least = np.full(LANES, ~np.uint64(0))
    for at in range(0, len(items), 2048):
        np.minimum(least, (items[at : at + 2048, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def _longs(rows: list[np.ndarray], width: int) -> pa.Array:
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(flat))


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, codes, lanes = [], [], []
            for items in shingle_sets(text_column(batch), k):
                sizes.append(len(items))
                codes.append((mix(items).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(items + np.uint64(len(items))), initial=np.uint64(0))))
                lanes.append(signature(items))
            code = np.array(codes, np.uint64).reshape(-1, 2).view(np.int64)
            cols = [batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(code[:, 0]), pa.array(code[:, 1]), _longs(lanes, LONGS)]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_shingles", "code_a", "code_b", "sig"])

    return run


def _lanes(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).view(np.uint16).reshape(-1, LANES)


def _bucket_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lanes = _lanes(batch.column("sig")).astype(np.uint64)
        keys = np.empty((len(lanes), LANES), np.uint64)
        for chunk in range(CHUNKS):
            own = lanes[:, chunk * WIDTH : (chunk + 1) * WIDTH]
            for out in range(WIDTH):
                key = np.full(len(lanes), chunk * WIDTH + out, np.uint64)
                packed = np.zeros(len(lanes), np.uint64)
                for lane in range(WIDTH):
                    if lane != out:
                        packed = (packed << np.uint64(16)) | own[:, lane]
                keys[:, chunk * WIDTH + out] = mix(packed + mix(key + np.uint64(1)))
        yield pa.RecordBatch.from_arrays([batch.column("row"), _longs(list(keys), LANES)], ["row", "keys"])


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key of a stream that is sorted by key."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if kept and any(kept[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(kept)
            kept = []
        values = np.stack([batch.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if a:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(a, b - a))
    if kept:
        yield pa.Table.from_batches(kept)


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    flat = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["a", "b"])


def _texts(group: pa.Table) -> pa.Array:
    return group.column("text").cast(pa.large_string()).combine_chunks()


def _against_hub(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["hub", "part"]):
            rows, hub = group.column("row").to_pylist(), group.column("hub")[0].as_py()
            sets = shingle_sets(_texts(group), k)
            first = next(sets)
            assert rows[0] == hub
            yield _links([(hub, row) for row, items in zip(rows[1:], sets, strict=True) if _alike(first, items, percent)])

    return run


def _near(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a pair of tiles whose signatures and sizes allow a link."""
    one, two = group.column("one").to_numpy(), group.column("two").to_numpy()
    tile, lanes = group.column("tile").to_numpy(), _lanes(group.column("sig").combine_chunks())
    size, hung = group.column("n_shingles").to_numpy(), group.column("hung").to_numpy()
    left = np.flatnonzero(tile == one)
    right = left if one[0] == two[0] else np.flatnonzero(tile == two)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in left:
        others = right[right > i] if right is left else right
        others = others[(hung[others] < 0) | (hung[others] != hung[i])]
        others = others[100 * np.minimum(size[others], size[i]) >= 80 * np.maximum(size[others], size[i])]
        if len(others):
            others = others[(lanes[others] != lanes[i]).sum(axis=1) <= FAR]
            found.append((np.full(len(others), i), others))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each pair of tiles that may link to another one there."""
    for group in _groups(batches, ["one", "two"]):
        a, b = _near(group)
        if len(a):
            yield from group.take(pa.array(np.unique(np.concatenate((a, b))))).combine_chunks().to_batches()


def _within_tiles(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["one", "two"]):
            rows, hung = group.column("row").to_pylist(), group.column("hung").to_pylist()
            sets = list(shingle_sets(_texts(group), k))
            first: dict[int, int] = {}
            root = [i if h < 0 else first.setdefault(h, i) for i, h in enumerate(hung)]

            def top(i: int, root: list[int] = root) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            found = []
            for i, j in zip(*(x.tolist() for x in _near(group)), strict=True):
                x, y = top(i), top(j)
                if x != y and _alike(sets[i], sets[j], percent):
                    root[max(x, y)] = min(x, y)
                    found.append((rows[i], rows[j]))
            yield _links(found)

    return run


def lanes_apart(one: str, two: str) -> Column:
    """Differing 16-bit lanes of two packed signatures."""

    def differing(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        for shift in (8, 4, 2, 1):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift))
        return F.bit_count(bits.bitwiseAND(F.lit(0x0001000100010001)))

    return F.aggregate(F.zip_with(one, two, differing), F.lit(0), lambda s, n: s + n)


def _sorted(rows: DataFrame, keys: list[str], *more: Column | str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *more)


def _may_link(pairs: DataFrame, signs: DataFrame, one: str, two: str, percent: int) -> DataFrame:
    """The pairs whose sizes and signatures allow a link, with both sides' columns of ``signs``."""
    for side in (one, two):
        pairs = pairs.join(signs.select(*[F.col(c).alias(side if c == "row" else f"{c}_{side}") for c in signs.columns]), side)
    sizes = [F.col(f"n_shingles_{side}") for side in (one, two)]
    return pairs.filter((100 * F.least(*sizes) >= percent * F.greatest(*sizes)) & (lanes_apart(f"sig_{one}", f"sig_{two}") <= FAR))


def _hub_links(met: DataFrame, unique: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links of every row with the hub of another class that it meets most often."""
    often = met.filter("label <> hub_label").groupBy("row", "hub").agg(F.count("*").alias("n"))
    picked = often.groupBy("row").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub"))
    family = written(_may_link(picked, unique, "row", "hub", percent).select("row", "hub"), "family")
    parts = family.groupBy("hub").agg(F.ceil(F.count("*") / PART).alias("parts"))
    spread = family.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("row"), "parts")).select("row", "hub", "part")
    heads = spread.select("hub", "part").distinct().select(F.col("hub").alias("row"), "hub", "part")
    ends = spread.union(heads).join(texts.hint("merge"), "row")
    return written(_sorted(ends, ["hub", "part"], F.col("row") != F.col("hub"), "row").mapInArrow(released(_against_hub(k, percent)), "a long, b long"), "hung")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the classes that ``links`` join have become one."""
    for side in ("a", "b"):
        links = links.join(labels.select(F.col("row").alias(side), F.col("label").alias(f"_{side}")), side)
    joined = components(links.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
    return written(labels.join(joined.withColumnRenamed("id", "label"), "label", "left").select("row", F.coalesce("component", "label").alias("label")), "labels")


def _tile_pairs(many: DataFrame, tiles: DataFrame) -> DataFrame:
    """``(one, two)``: tiles that meet in a bucket, once; buckets with the same tiles are joined once.  ``whole``
    is the class of a tile that has one."""
    here = many.select("key", "row").join(tiles, "row").groupBy("key", "tile").agg(F.min("whole").alias("whole"), (F.count("*") > 1).alias("several"))
    here = written(here, "here")
    hashes = [F.bit_xor(F.xxhash64(F.lit(x), "tile", "several")).alias(f"h{x}") for x in (1, 2)]
    sets = here.groupBy("key").agg(F.count("*").alias("n"), *hashes).groupBy("n", "h1", "h2").agg(F.min("key").alias("key"))
    here = here.join(sets.select("key"), "key", "left_semi")
    other = here.select("key", F.col("tile").alias("two"), F.col("whole").alias("whole_two"))
    apart = (F.col("tile") < F.col("two")) & ((F.col("whole") < 0) | (F.col("whole") != F.col("whole_two")))
    within = (F.col("tile") == F.col("two")) & (F.col("whole") < 0) & F.col("several")
    return here.join(other, "key").filter(apart | within).select(F.col("tile").alias("one"), "two").distinct()


def near_links(docs: DataFrame, signed: DataFrame, k: int, percent: int) -> DataFrame:
    """``(a, b)`` from ``docs`` (``row, text``): links among the first rows of equal sets that connect all that similarity connects."""
    firsts = signed.filter("n_shingles > 0").groupBy("n_shingles", "code_a", "code_b").agg(F.min("row").alias("row")).select("row")
    unique = written(signed.select("row", "n_shingles", "sig").join(firsts, "row"), "unique")
    texts = docs.select("row", "text")
    keyed = unique.select("row", "sig").mapInArrow(released(_bucket_keys), "row long, keys array<long>").select("row", F.explode("keys").alias("key"))
    over = Window.partitionBy("key")
    met = keyed.select("key", "row", F.min("row").over(over).alias("hub"), F.count("*").over(over).alias("n")).filter("n > 1")
    met = written(met.select("key", "row", F.col("row").alias("label"), "hub", F.col("hub").alias("hub_label"), "n"), "met")
    labels = met.select("row", "label").distinct()
    found, before = unique.select(F.col("row").alias("a"), F.col("row").alias("b")).filter("false"), None
    for turn in itertools.count(1):
        now = met.count()
        if not now or (before and 5 * now > 4 * before):
            break
        links = _hub_links(met, unique, texts, k, percent)
        found, labels, before = found.union(links), _relabelled(labels, links), now
        told = met.select("key", "row").join(labels, "row")
        head = F.min_by(F.struct("row", "label"), F.xxhash64(F.lit(turn), "row")).alias("head")
        heads = told.groupBy("key").agg(head, F.count("*").alias("n"), (F.min("label") < F.max("label")).alias("open")).filter("open")
        met = written(told.join(heads, "key").select("key", "row", "label", F.col("head.row").alias("hub"), F.col("head.label").alias("hub_label"), "n"), "met")

    classes = labels.groupBy("label").agg(F.count("*").alias("size"))
    told = met.join(classes, "label")
    mains = told.groupBy("key").agg(F.max(F.struct("size", "label")).alias("main"))
    family = told.join(mains, "key").groupBy("row", "label", "size").agg(F.max("main")["label"].alias("main"))
    pure = (F.col("size") >= TILE).alias("pure")
    placed = written(family.select("row", pure, F.when(pure, F.col("label")).otherwise(F.col("main")).alias("hub"), F.when(F.col("size") > 1, F.col("label")).otherwise(F.lit(-1)).alias("hung")), "placed")
    signs = unique.join(placed.select("row", "hung"), "row").select("row", "hung", "n_shingles", "sig")

    few = met.filter(F.col("n") <= SMALL).select("key", "row", "label")
    other = few.select("key", F.col("row").alias("two"), F.col("label").alias("label_two"))
    single = few.join(other, "key").filter((F.col("row") < F.col("two")) & (F.col("label") != F.col("label_two"))).select(F.col("row").alias("one"), "two").distinct()
    single = _may_link(single, signs, "one", "two", percent)
    ends_of = F.inline(F.array(*[F.struct(F.col(side).alias("tile"), F.col(side).alias("row"), *[F.col(f"{c}_{side}").alias(c) for c in signs.columns[1:]]) for side in ("one", "two")]))
    some_single = single.select("one", "two", ends_of)

    many = met.filter(F.col("n") > SMALL)
    members = many.select("row").distinct().join(placed, "row")
    counts = members.groupBy("hub", "pure").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    tile = F.xxhash64("hub", "pure", F.pmod(F.xxhash64("row"), "parts")).alias("tile")
    tiles = written(members.join(counts, ["hub", "pure"]).select("row", "hung", F.when(F.col("pure"), F.col("hung")).otherwise(F.lit(-1)).alias("whole"), tile), "tiles")
    sides = _tile_pairs(many, tiles).select("one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("tile"))
    work = sides.join(tiles, "tile").join(unique, "row").select("one", "two", "tile", "row", "hung", "n_shingles", "sig")
    some = _sorted(work, ["one", "two"], "row").mapInArrow(released(_candidates), work.schema)
    compared = _sorted(written(some.union(some_single), "candidates").join(texts.hint("merge"), "row"), ["one", "two"], "row")
    return found.union(written(compared.mapInArrow(released(_within_tiles(k, percent)), "a long, b long"), "links"))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``row, doc_id, n_shingles, component_id, first`` of every document.

    Documents link when their sets of ``k``-word shingles share ``percent`` per cent of their union (at
    least 80: the signature is laid out for that).  ``first`` marks the row that stands for its component.
    """
    return _grouped(numbered(docs, "row", "doc_id", "text"), k, percent)


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``near_groups`` of rows that have their number, ``row, doc_id, text``."""
    if percent < 80:
        raise ValueError("signatures are laid out for a similarity of 0.8 or more")
    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    signed = written(docs.mapInArrow(released(_sign(k)), ROW), "signed")
    linked = components(near_links(docs, signed, k, percent))
    rows = signed.select("row", "doc_id", "n_shingles", "code_a", "code_b")
    sets = rows.filter("n_shingles > 0").groupBy("n_shingles", "code_a", "code_b").agg(F.min("row").alias("id"), F.min("doc_id").alias("least"), F.min(F.when(F.col("doc_id").isNull(), F.col("row"))).alias("least_row"))
    named = sets.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    whole = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = named.join(whole, "component").select("n_shingles", "code_a", "code_b", "component", "component_id")
    placed = rows.join(of_set, ["n_shingles", "code_a", "code_b"], "left")
    alone = F.col("n_shingles") == 0
    placed = placed.select(
        "row", "doc_id", "n_shingles", F.when(alone, F.col("row")).otherwise(F.col("component")).alias("component"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), alone.alias("alone"),
    )
    return placed


def first_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of every component, the one with the smallest id; the input's columns."""
    name = free_name(docs, "row")
    docs = numbered(docs, name)
    groups = written(_grouped(docs.select(F.col(name).alias("row"), "doc_id", "text"), k, percent), "groups")
    first = groups.groupBy("component", "alone").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    rows = first.select(F.col("first.row").alias(name))
    return docs.join(rows, name, "left_semi").drop(name)
