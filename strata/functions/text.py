"""Column functions for the text and code columns (no UDFs)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

TEXT_COLS = ("text_obj", "text_mthd", "text_deal")
CODE_COLS = ("digit_1", "digit_2", "digit_3")

# Fixed values that must equal the reference's cleaning rule: keep Hangul
# syllables (가-힣), compatibility jamo (ㄱ-ㅎ, ㅏ-ㅣ), ASCII letters and digits,
# and every character Python's str ``\s`` matches; drop everything else.
# Java's ``\s`` is ASCII-only, so the whitespace set is spelled out.
CLEAN_PATTERN = (
    "[^가-힣ㄱ-ㅎㅏ-ㅣa-zA-Z0-9"
    "\\t\\n\\x0B\\f\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
)

# The same set, told in the order that is cheap: ASCII by one bit set (characters listed one by one share
# it in Java), the ranges for other characters only. The plain form tries range after range on every character.
_DROPPED = "".join(f"\\x{i:02x}" for i in range(128) if not (chr(i).isalnum() or chr(i).isspace()))
FAST_PATTERN = f"[{_DROPPED}[\\x80-\\x{{10FFFF}}&&{CLEAN_PATTERN}]]"

# Token separators used by the vocabulary and the encoder.
TOKEN_SPLIT = "[ \\t\\n\\r\\f]+"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: str | Column) -> Column:
    """B2: drop every character outside the kept set."""
    return F.regexp_replace(col_of(c), FAST_PATTERN, "")


def pad_code(c: str | Column, digits: int) -> Column:
    """Zero-pad to ``digits``; longer values pass unchanged; NULL counts as ''."""
    s = F.coalesce(col_of(c).cast("string"), F.lit(""))
    return F.when(F.length(s) < digits, F.lpad(s, digits, "0")).otherwise(s)


def class_code(d1: str | Column = "digit_1", d2: str | Column = "digit_2",
               d3: str | Column = "digit_3") -> Column:
    """Large + 2-digit medium + 3-digit small code."""
    return F.concat(F.coalesce(col_of(d1).cast("string"), F.lit("")), pad_code(d2, 2), pad_code(d3, 3))


def join_texts(cols: Iterable[str] = TEXT_COLS) -> Column:
    """One space between texts, empties kept; callers fill NULLs first."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols])


def any_non_empty(cols: Iterable[str] = TEXT_COLS) -> Column:
    """B8 condition: at least one text is non-empty."""
    conds = [F.coalesce(F.length(F.col(c)), F.lit(0)) > 0 for c in cols]
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def fill_text(df: DataFrame, cols: Iterable[str] = TEXT_COLS) -> DataFrame:
    """B1: NULL text -> ''. Code columns keep their types."""
    return df.fillna("", subset=list(cols))


def apply_text_fn(df: DataFrame, fn: Callable[[Column], Column],
                  cols: Iterable[str] = TEXT_COLS) -> DataFrame:
    """Apply a user column function (built-in expression or pandas_udf) to each text."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def clean_columns(df: DataFrame, cols: Iterable[str] = TEXT_COLS) -> DataFrame:
    return apply_text_fn(df, clean_text, cols)


def non_empty(df: DataFrame, cols: Iterable[str] = TEXT_COLS) -> DataFrame:
    return df.filter(any_non_empty(cols))


def concat_text(df: DataFrame, out: str = "text", cols: Iterable[str] = TEXT_COLS) -> DataFrame:
    return df.withColumn(out, join_texts(cols))
