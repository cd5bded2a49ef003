"""Token stages, cost breakdown, projection and levers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions.money import edge_factor, krw
from markloom.operators import sequences as S


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(K.MODEL_CATALOG), "model string, provider string, usd_in double, usd_out double, takes_effort boolean"
    )


def call_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """USD per call; cached reads at 10 %, cache writes at 125 %, unknown model NULL.

    The price list has one row per model; Spark broadcasts it when its measured size allows.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = calls.join(prices.select("model", "usd_in", "usd_out"), "model", "left")
    billed = zero("input_tokens") + zero("cache_read") * K.CACHE_READ_RATE + zero("cache_write") * K.CACHE_WRITE_RATE
    usd = (billed * F.col("usd_in") + zero("output_tokens") * F.col("usd_out")) / 1_000_000
    return joined.withColumn("cost_usd", usd).drop("usd_in", "usd_out")


def sheet_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per sheet; NULL when any call's price is unknown."""
    priced = call_cost(calls, prices).groupBy("sheet_id").agg(F.sum("cost_usd").alias("_sum"), F.count_if(F.col("cost_usd").isNull()).alias("_open"))
    return priced.select("sheet_id", F.when(F.col("_open") == 0, F.col("_sum")).alias("cost_usd"))


def staged_calls(calls: DataFrame) -> DataFrame:
    """Add stage: with two or more calls on a sheet the last one judges, all others transcribe."""
    last = calls.groupBy("sheet_id").agg(F.max("pos").alias("_last"), F.count("*").alias("_n"))
    joined = calls.join(last, "sheet_id")
    judge = (F.col("pos") == F.col("_last")) & (F.col("_n") > 1)
    return joined.withColumn("stage", F.when(judge, "judge").otherwise("transcribe")).drop("_last", "_n")


def token_stage_split(calls: DataFrame) -> DataFrame:
    """One row: calls and tokens per stage, sheets and pages.

    The judge call of a sheet is its last one, so per-sheet totals and the last call are enough and
    no join back to the calls is needed.
    """
    tokens_in = F.col("input_tokens") + F.coalesce("cache_read", F.lit(0)) + F.coalesce("cache_write", F.lit(0))
    per_sheet = calls.withColumn("_in", tokens_in).groupBy("sheet_id").agg(
        F.count("*").alias("n"),
        F.sum("_in").alias("t_in"),
        F.sum("output_tokens").alias("t_out"),
        F.max_by(F.struct(F.col("_in").alias("i"), F.col("output_tokens").alias("o")), "pos").alias("last"),
    )
    two = F.col("n") > 1
    j_in, j_out = F.when(two, F.col("last.i")).otherwise(0), F.when(two, F.col("last.o")).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per_sheet.agg(
        total(F.col("n") - two.cast("int")).alias("transcribe_calls"),
        total(F.col("t_in") - j_in).alias("transcribe_in"),
        total(F.col("t_out") - j_out).alias("transcribe_out"),
        F.count_if(two).alias("judge_calls"),
        total(j_in).alias("judge_in"),
        total(j_out).alias("judge_out"),
        F.count("*").alias("sheets"),
        total(F.greatest(F.lit(1), F.col("n") - 1)).alias("pages"),
    )


def image_tokens(split: DataFrame, fixed: float = K.FIXED_INPUT_PER_PAGE) -> DataFrame:
    """Add image_per_page: mean transcription input above the fixed prompt, never negative."""
    mean = F.try_divide(F.col("transcribe_in").cast("double"), F.col("transcribe_calls"))
    return split.withColumn("image_per_page", F.coalesce(F.greatest(F.lit(0.0), mean - fixed), F.lit(0.0)))


def measured(split: DataFrame, n_items: DataFrame) -> DataFrame:
    """One row of pages, items and the three token parts. ``n_items``: one row (items)."""
    s = image_tokens(split)
    image = F.col("image_per_page") * F.col("pages")
    other = F.greatest(F.lit(0.0), F.col("transcribe_in") + F.col("judge_in") - image)
    both = s.withColumn("_one", F.lit(1)).join(n_items.withColumn("_one", F.lit(1)), "_one")
    return both.select(
        "sheets", "pages", "items", image.alias("image_tokens"), other.alias("other_tokens"),
        (F.col("transcribe_out") + F.col("judge_out")).cast("double").alias("output_tokens"),
    )


def _usd(image: Column, other: Column, output: Column, price: tuple[float, float]) -> tuple[Column, Column, Column]:
    pin, pout = price
    return image * pin / 1e6, other * pin / 1e6, output * pout / 1e6


def cost_breakdown(m: DataFrame, price: tuple[float, float] = K.REPORT_PRICE) -> DataFrame:
    """Rows (part, tokens, usd, share) for image, other input and output."""
    cols = [F.col(c) for c in ("image_tokens", "other_tokens", "output_tokens")]
    usd = _usd(*cols, price)
    total = usd[0] + usd[1] + usd[2]
    share = lambda u: F.coalesce(F.try_divide(u, total), F.lit(0.0))
    names = ("image", "other_input", "output")
    rows = [F.struct(F.lit(n).alias("part"), t.alias("tokens"), u.alias("usd"), share(u).alias("share")) for n, t, u in zip(names, cols, usd)]
    return m.select(F.inline(F.array(*rows)))


def scale_to(m: DataFrame, pages: float) -> DataFrame:
    """Measured tokens scaled to a number of pages; nothing measured gives zeros."""
    k = F.coalesce(F.when(F.col("pages") > 0, F.lit(float(pages)) / F.col("pages")), F.lit(0.0))
    scaled = [(F.col(c) * k).alias(c) for c in ("items", "image_tokens", "other_tokens", "output_tokens")]
    return m.select("sheets", F.when(F.col("pages") > 0, F.lit(float(pages))).otherwise(0.0).alias("pages"), *scaled)


def cost_projection(m: DataFrame, pages: float = K.PLANNED_PAGES, price: tuple[float, float] = K.REPORT_PRICE) -> DataFrame:
    return cost_breakdown(scale_to(m, pages), price)


def cost_levers(m: DataFrame, pages: float = K.PLANNED_PAGES, price: tuple[float, float] = K.REPORT_PRICE) -> DataFrame:
    """Monthly saving of each lever, with won and share of the planned total."""
    s = scale_to(m, pages)
    image, other, output = _usd(*[F.col(c) for c in ("image_tokens", "other_tokens", "output_tokens")], price)
    total = image + other + output
    stored = F.lit(float(K.EDGES[0]))
    levers = [(f"edge_{K.EDGES[0]}_{to}", image * (1 - edge_factor(stored, F.lit(float(to))))) for to in (1800, 1288)]
    levers.append(("compact_output", total * K.MEASURED_OUTPUT_SAVING))
    rows = [
        F.struct(F.lit(n).alias("lever"), u.alias("usd"), krw(u).alias("krw"), F.coalesce(F.try_divide(u, total), F.lit(0.0)).alias("share"))
        for n, u in levers
    ]
    return s.select(F.inline(F.array(*rows)))


def cost_unit_rates(m: DataFrame, spent: DataFrame) -> DataFrame:
    """Items per page, cost per sheet, output tokens per item, small-sample flag. ``spent``: one row (cost_usd)."""
    both = m.withColumn("_one", F.lit(1)).join(spent.withColumn("_one", F.lit(1)), "_one")
    d = lambda c: F.col(c).cast("double")
    return both.select(
        "sheets", "pages", "items",
        F.coalesce(F.try_divide(d("items"), d("pages")), F.lit(0.0)).alias("items_per_page"),
        F.try_divide(d("cost_usd"), d("sheets")).alias("cost_per_sheet"),
        F.when(F.col("pages") > 0, F.floor(d("output_tokens") / F.greatest(F.lit(1), F.col("items")) + 0.5)).otherwise(0).alias("output_per_item"),
        (F.col("sheets") < K.SMALL_SAMPLE_SHEETS).alias("small_sample"),
    )


def image_size_stats(photos: DataFrame) -> DataFrame:
    """Upper median of the longer edge and mean image tokens (pixels / 750).

    The upper median is read off a histogram of edge lengths, whose size is bounded by the distinct
    pixel lengths, not by the number of photos.
    """
    w, h = F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))
    sized = photos.select(F.greatest(w, h).cast("bigint").alias("edge"), (w.cast("bigint") * h).alias("px"))
    histogram = sized.filter("edge > 0").groupBy("edge").agg(F.count("*").alias("n"))
    up_to = Window.orderBy("edge").rowsBetween(Window.unboundedPreceding, 0)
    ranked = histogram.withColumn("cum", F.sum("n").over(up_to)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    median = ranked.agg(F.min(F.when(F.col("cum") > F.floor(F.col("total") / 2), F.col("edge"))).alias("median_edge"))
    tokens = sized.filter("px > 0").agg((F.avg("px") / K.PIXELS_PER_TOKEN).alias("mean_image_tokens"))
    return median.withColumn("_one", F.lit(1)).join(tokens.withColumn("_one", F.lit(1)), "_one").drop("_one")


def median_latency(calls: DataFrame) -> DataFrame:
    """Median of the positive per-sheet times in seconds, NULL when nothing was measured.

    Exact: the two middle values are read off a running count over the histogram of milliseconds,
    which is cut into ranges so that no single task holds it all.
    """
    per_sheet = calls.groupBy("sheet_id").agg(F.sum("latency_ms").alias("ms")).filter("ms > 0")
    histogram = per_sheet.groupBy("ms").agg(F.count("*").alias("n")).withColumn("_k", F.lit(1))
    total = histogram.groupBy("_k").agg(F.sum("n").alias("total"))  # one row
    counted = S.running_sum(histogram, ["_k"], ["ms"], F.floor(F.col("ms") / 4096), F.col("n"), "cum")
    ranked = counted.join(F.broadcast(total), "_k")

    def holds(rank: Column) -> Column:
        return (F.col("cum") > rank) & (F.col("cum") - F.col("n") <= rank)

    middle = ranked.filter(holds(F.floor((F.col("total") - 1) / 2)) | holds(F.floor(F.col("total") / 2)))
    return middle.agg(((F.min("ms") + F.max("ms")) / 2 / 1000).alias("seconds"))


def queue_wait(sheets: DataFrame, seconds: DataFrame, lanes: int, keys: list[str] | None = None) -> DataFrame:
    """ceil((queued + running) / lanes) times the seconds per sheet. ``seconds``: one row (seconds)."""
    from markloom.functions.money import describe_wait

    waiting = sheets.groupBy(*(keys or [])).agg(F.count_if(F.col("status").isin("queued", "running")).alias("waiting"))
    both = waiting.withColumn("_one", F.lit(1)).join(seconds.withColumn("_one", F.lit(1)), "_one").drop("_one")
    wait = F.when(F.col("waiting") <= 0, F.lit(0.0)).otherwise(F.ceil(F.col("waiting") / max(1, lanes)) * F.col("seconds"))
    return both.withColumn("wait_seconds", wait).withColumn("wait_text", describe_wait(F.col("wait_seconds")))
