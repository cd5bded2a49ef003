"""Text normalisation and the per-item text checks."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from markloom import constants as K

_WS = K.WHITESPACE
# ASCII and precomposed Hangul are unchanged by compatibility composition.
_STABLE = r"^[\x00-\x7F가-힣]*$"
# printed ASCII with single spaces inside: only its letters' case can change
_CLEAN = r"^\z|^[!-~]++(?: [!-~]++)*+\z"
_PY_WS = re.sub(r"\\u([0-9A-F]{4})", lambda m: chr(int(m.group(1), 16)), _WS)
_PY_EDGES = re.compile(f"^[{_PY_WS}]+|[{_PY_WS}]+$")
_PY_RUNS = re.compile(f"[{_PY_WS}\u200b]+")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trimmed(c: Column) -> Column:
    """Strip every Unicode space (the SQL trim only strips U+0020)."""
    return F.regexp_replace(text_or_empty(c), f"^[{_WS}]+|[{_WS}]+$", "")


def filled(c: Column) -> Column:
    """Trimmed text, or NULL when nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it."""
    return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@pandas_udf(StringType())
def norm_nfkc(s: pd.Series) -> pd.Series:
    def one(v: str) -> str:
        flat = _PY_EDGES.sub("", unicodedata.normalize("NFKC", v)).lower()
        return _PY_RUNS.sub(" ", flat)

    return s if s.isna().all() else s.map(one, na_action="ignore")


def composed(c: Column) -> Column:
    """NFKC; rows that cannot change reach the UDF as NULL only."""
    s = text_or_empty(c)
    stable = s.rlike(_STABLE)
    return F.when(stable, s).otherwise(nfkc(F.when(~stable, s)))


def is_stable(c: Column) -> Column:
    """Text that compatibility composition leaves as it is, or none."""
    return text_or_empty(c).rlike(_STABLE)


def norm_stable(c: Column) -> Column:
    """``norm`` of stable text, without Python."""
    s = text_or_empty(c)
    plain = F.regexp_replace(F.lower(trimmed(s)), f"[{_WS}]+", " ")
    return F.when(s.rlike(_CLEAN), F.lower(s)).otherwise(plain)


def norm(c: Column) -> Column:
    """NFKC, trim, lower case, runs of spaces to one space. Spelling is never touched."""
    s = text_or_empty(c)
    stable = s.rlike(_STABLE)
    plain = F.regexp_replace(F.lower(trimmed(s)), f"[{_WS}]+", " ")
    return F.when(s.rlike(_CLEAN), F.lower(s)).when(stable, plain).otherwise(norm_nfkc(F.when(~stable, s)))


def has_hangul(c: Column) -> Column:
    return c.rlike("[가-힣]")


def num_key(no: Column) -> Column:
    """Leading digits of a printed item number; numbers without digits sort last."""
    digits = F.regexp_extract(text_or_empty(no), f"^[{_WS}]*([0-9]+)", 1)
    value = F.nullif(digits, F.lit("")).try_cast("bigint")
    return F.least(F.coalesce(value, F.lit(K.NO_NUMBER)), F.lit(K.NO_NUMBER))


def word_count(c: Column) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(rf"[^{_WS}\p{{L}}\p{{N}}']*+[\p{{L}}\p{{N}}'][^{_WS}]*+")).cast("bigint")


def too_short(written: Column, expected: Column) -> Column:
    """A sentence was asked for and clearly fewer words were written."""
    want = word_count(expected)
    return (want >= K.SENTENCE_WORDS) & (word_count(written) < want * F.lit(K.SHORT_RATIO))


def prefix_mismatch(prefix: Column, written: Column) -> Column:
    p, w = F.lower(trimmed(prefix)), F.lower(trimmed(written))
    return (p != "") & (w != "") & ~F.startswith(w, p)


def language_mismatch(direction: Column, written: Column) -> Column:
    """'한글' for Hangul under ko2en, '영문' for plain ASCII under en2ko, else NULL."""
    w = trimmed(written)
    hangul = has_hangul(w)
    long_enough = F.length(w) >= 2
    return (
        F.when(long_enough & (direction == "ko2en") & hangul, F.lit("한글"))
        .when(long_enough & (direction == "en2ko") & ~hangul & w.rlike(r"^[\x00-\x7F]*$"), F.lit("영문"))
    )


def chars(c: Column) -> Column:
    """Array of code points."""
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


def code_point_label(ch: Column) -> Column:
    """U+XXXX with at least four digits."""
    digits = F.regexp_replace(F.hex(F.encode(ch, "UTF-32")), "^0{0,4}", "")
    return F.concat(F.lit("U+"), digits)


def mark_hidden(c: Column) -> Column:
    """Show zero-width and control characters as ⟨U+XXXX⟩."""
    hidden = f"[{K.HIDDEN_CHARS}]"
    shown = F.transform(
        chars(c),
        lambda ch: F.when(ch.rlike(hidden), F.concat(F.lit("⟨"), code_point_label(ch), F.lit("⟩"))).otherwise(ch),
    )
    return F.when(c.rlike(hidden), F.array_join(shown, "")).otherwise(c)


def odd_chars(c: Column) -> Column:
    """Distinct unexpected characters in first-seen order, NULL when there are none."""
    visible = F.regexp_replace(text_or_empty(c), f"[{K.HIDDEN_CHARS}]", "")
    odd = F.array_distinct(chars(F.regexp_replace(visible, f"[{K.EXPECTED_CHARS}]", "")))
    listed = F.transform(odd, lambda ch: F.concat_ws(" ", ch, code_point_label(ch)))
    return F.when(F.size(odd) > 0, F.array_join(listed, ", "))


def is_noise(c: Column) -> Column:
    """Nothing but punctuation."""
    return c.rlike(f"^[{K.NOISE_CHARS}]+$") | (F.length(F.trim(c)) < 1)


def has_text_layer(c: Column) -> Column:
    return F.length(F.regexp_replace(text_or_empty(c), f"[{_WS}]+", "")) >= K.TEXT_LAYER_CHARS


def is_mojibake(c: Column) -> Column:
    """The first 600 non-space characters are mostly not letters or digits."""
    sample = F.substring(F.regexp_replace(text_or_empty(c), r"(?U)\s+", ""), 1, 600)
    readable = F.length(F.regexp_replace(sample, r"[^\p{L}\p{N}]", ""))
    return (F.length(sample) >= 40) & (readable < F.length(sample) * F.lit(0.45))


def told(sentence: str, *values: Column) -> Column:
    """A fixed sentence with values in its places; a NULL value makes it NULL."""
    first, *rest = sentence.split("{}")
    parts = [F.lit(first)]
    for value, piece in zip(values, rest, strict=True):
        parts += [value.cast("string"), F.lit(piece)]
    return F.concat(*parts)
