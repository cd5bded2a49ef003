"""File name rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions.text import composed, trimmed


def is_answer_key(name: Column) -> Column:
    n = composed(name)
    denied = reduce(lambda a, b: a | b, [F.contains(n, F.lit(d)) for d in K.KEY_DENY])
    return F.contains(n, F.lit(K.KEY_TOKEN)) & ~denied


def title_from_name(name: Column) -> Column:
    """Extension, key token, trailing teacher initial and separators removed."""
    ws = K.WHITESPACE
    n = F.regexp_replace(composed(name), r"(?i)\.[a-z0-9]+$", "")
    n = F.replace(n, F.lit(K.KEY_TOKEN), F.lit(" "))
    n = F.regexp_replace(n, f"[^{ws}]*T[{ws}]*$", "")
    n = F.regexp_replace(n, "[_,]+", " ")
    return trimmed(F.regexp_replace(n, f"[{ws}]+", " "))


def is_retest_file(name: Column, mime: Column) -> Column:
    extension = "|".join(("pdf", *K.DOCUMENT_EXTENSIONS))
    wanted = mime.isin(K.PDF_MIME, *K.DOCUMENT_MIMES) | name.rlike(rf"(?i)\.({extension})$")
    return F.coalesce(wanted, F.lit(False)) & ~name.rlike(f"오답[{K.WHITESPACE}]*노트")


def is_readable(name: Column, mime: Column) -> Column:
    return (mime == K.PDF_MIME) | name.rlike(r"(?i)\.pdf$")


def chapter_number(name: Column) -> Column:
    digits = F.regexp_extract(name, r"[Cc]h\s*\.?\s*_?\s*([0-9]{1,2})", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def chapter_code(level: Column, chapter: Column) -> Column:
    short = F.replace(F.replace(level, F.lit(" "), F.lit("")), F.lit("Level"), F.lit("L"))
    return F.format_string("BJ-%s-CH%02d", short, chapter)


def chapter_title(name: Column) -> Column:
    title = F.regexp_extract(name, r"[Cc]h\s*\.?\s*_?\s*[0-9]{1,2}\.?\s*(.*?)(?:\s*시험지)?\.pdf$", 1)
    return F.regexp_replace(F.trim(title), r"^[. ]+|[. ]+$", "")
