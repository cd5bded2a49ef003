"""Exam references: one expected answer per exam instead of one per student."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions import verdicts as V
from markloom.functions.text import filled, norm, text_or_empty, told, trimmed
from markloom.operators import sequences as S


def latest_by_no(results: DataFrame, values: list[str], order: str = "pos", keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """One result per number: the last duplicate counts."""
    packed = F.max_by(F.struct(*values), order).alias("_r")
    return results.groupBy(*keys, "no").agg(packed).select(*keys, "no", *[F.col(f"_r.{v}").alias(v) for v in values])


def items_from_transcript(transcript: DataFrame, results: DataFrame) -> DataFrame:
    """Transcript items with the judgement on the same number; no judgement leaves correct NULL."""
    judged = latest_by_no(results, ["correct", "expected", "note"]).withColumn("_hit", F.lit(True))
    joined = transcript.join(judged, ["sheet_id", "no"], "left")
    return joined.select(
        *transcript.columns, "correct", text_or_empty(F.col("expected")).alias("expected"), text_or_empty(F.col("note")).alias("note")
    )


def apply_reference(items: DataFrame, ref: DataFrame) -> DataFrame:
    """Settle what needs no model: illegible, blank, or equal to the reference answer.

    ``ref``: (sheet_id, no, prompt, expected, pos). Adds expected, action ('pre' or 'todo'), correct, note.
    An answer that differs from the reference is never marked wrong here.
    """
    known = latest_by_no(ref.select("sheet_id", "no", "pos", F.col("prompt").alias("ref_prompt"), F.col("expected").alias("ref_expected")),
                         ["ref_prompt", "ref_expected"])
    base = items.drop("expected", "correct", "note")
    joined = base.join(known, ["sheet_id", "no"], "left")
    prompt, ref_prompt = text_or_empty(F.col("prompt")), text_or_empty(F.col("ref_prompt"))
    expected = text_or_empty(F.col("ref_expected"))
    same_prompt = (ref_prompt == "") | (prompt == "") | (norm(ref_prompt) == norm(prompt))
    equal = same_prompt & (expected != "") & (norm(F.col("written")) == norm(expected))
    legible, blank = F.coalesce(F.col("legible"), F.lit(False)), F.coalesce(F.col("blank"), F.lit(False))

    def chain(illegible: Column, empty: Column, match: Column) -> Column:
        return F.when(~legible, illegible).when(blank, empty).when(equal, match)

    return joined.select(
        *base.columns,
        expected.alias("expected"),
        F.coalesce(chain(F.lit("pre"), F.lit("pre"), F.lit("pre")), F.lit("todo")).alias("action"),
        chain(F.lit(False), F.lit(False), F.lit(True)).alias("correct"),
        chain(F.lit(K.NOTE_ILLEGIBLE), F.lit(K.NOTE_BLANK), F.lit("")).alias("note"),
    )


def ref_fingerprint(items: DataFrame, sheets: DataFrame) -> DataFrame:
    """(sheet_id, fingerprint): normalised title and all numbers in order; none without title or items."""
    titled = sheets.select("sheet_id", norm(F.col("title")).alias("_title")).filter("_title <> ''")
    parts = S.fold_text(items, ["sheet_id"], trimmed(F.col("no")), ["seq"], "_text", sep=",", hot=True)
    listed = parts.groupBy("sheet_id").agg(F.sort_array(F.collect_list(F.struct("part", "_text"))).alias("_parts"))
    numbers = F.array_join(F.transform("_parts", lambda p: p["_text"]), ",")
    return titled.join(listed, "sheet_id").select("sheet_id", F.concat_ws("|", "_title", numbers).alias("fingerprint"))


def build_reference(items: DataFrame, results: DataFrame, sheets: DataFrame, warnings: DataFrame) -> DataFrame:
    """Items of sheets clean enough to serve as reference.

    Needs a title, nothing missing, no drift or incomplete warning, nothing unjudged, and a prompt
    and an expected answer on every item. ``sheets``: (sheet_id, title, printed_total).
    """
    judged = latest_by_no(results, ["correct", "expected", "note"])
    rows = items.drop("correct", "expected", "note").join(judged, ["sheet_id", "no"], "left")
    whole = filled(F.col("expected")).isNotNull() & filled(F.col("prompt")).isNotNull()
    complete = rows.groupBy("sheet_id").agg(F.bool_and(whole).alias("_whole"), F.count("*").alias("_n"))
    unjudged = results.filter(V.is_unjudged(F.col("note"))).select("sheet_id").distinct()
    barred = warnings.filter(F.col("level").isin("drift", "incomplete")).select("sheet_id").distinct()
    clean = (
        complete.filter("_whole")
        .join(sheets.select("sheet_id", "title", "printed_total"), "sheet_id")
        .filter(V.missing_count(F.col("printed_total"), F.col("_n")) == 0)
        .join(unjudged, "sheet_id", "left_anti")
        .join(barred, "sheet_id", "left_anti")
    )
    marked = ref_fingerprint(items, clean).join(clean.select("sheet_id", "title"), "sheet_id")
    return rows.join(marked, "sheet_id").select("sheet_id", "fingerprint", "title", "seq", "no", "prompt", "direction", "expected")


def key_as_reference(key_items: DataFrame) -> DataFrame:
    """A registered key in the shape of a reference, prompts blanked."""
    return key_items.select(
        F.concat(F.lit("key:"), "slug").alias("fingerprint"), "title", "no", F.lit("").alias("prompt"), F.lit("ko2en").alias("direction"), "expected"
    )


def resolve_reference(sheets: DataFrame, key_matches: DataFrame, fingerprints: DataFrame, refs: DataFrame, use_refs: bool = True) -> DataFrame:
    """Registered key first, else the stored reference with the sheet's fingerprint (when enabled)."""
    keyed = key_matches.select("sheet_id", F.concat(F.lit("key:"), "slug").alias("_key"))
    base = sheets.select("sheet_id").join(keyed, "sheet_id", "left")
    if not use_refs:
        return base.select("sheet_id", F.col("_key").alias("ref_id"), F.when(F.col("_key").isNotNull(), "key").alias("origin"))
    stored = refs.select("fingerprint").distinct().withColumn("_stored", F.col("fingerprint"))
    hit = fingerprints.join(stored, "fingerprint").select("sheet_id", "_stored")
    both = base.join(hit, "sheet_id", "left")
    origin = F.when(F.col("_key").isNotNull(), "key").when(F.col("_stored").isNotNull(), "reference")
    return both.select("sheet_id", F.coalesce("_key", "_stored").alias("ref_id"), origin.alias("origin"))


def unjudged_warning(results: DataFrame, order: str = "seq") -> DataFrame:
    """(sheet_id, part, level, text) naming the items nobody could judge."""
    flagged = results.filter(V.is_unjudged(F.col("note")))
    counts = flagged.groupBy("sheet_id").agg(F.count("*").alias("_n"))
    listed = S.fold_text(flagged, ["sheet_id"], F.col("no"), [order], "_nos", hot=True).join(counts, "sheet_id")
    text = told(K.WARN_UNJUDGED, F.col("_n"), F.col("_nos"))
    return listed.select("sheet_id", "part", F.lit("incomplete").alias("level"), text.alias("text"))


def key_match_notes(matches: DataFrame) -> DataFrame:
    """Info rows for keys found by anything but an equal title, and for sheets with rivals."""
    near = F.col("slug").isNotNull() & (F.col("how") != K.HOW_TITLE)
    near_text = told(K.KEY_NEAR, F.col("how"), text_or_empty(F.col("why")))
    rivals = F.col("slug").isNull() & (F.coalesce(F.size("ambiguous"), F.lit(0)) > 0)
    names = F.array_join(F.transform("ambiguous", lambda a: F.concat(F.lit("「"), a["title"], F.lit("」"))), ", ")
    text = F.when(F.col("slug").isNotNull(), near_text).otherwise(told(K.KEY_RIVALS, names))
    return matches.filter(near | rivals).select("sheet_id", F.lit("info").alias("level"), text.alias("text"))


def key_slug(title: Column) -> Column:
    return F.nullif(norm(title), F.lit(""))
