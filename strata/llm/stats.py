"""Counts over one text, from which the quality rules and the classifier build their vectors."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strata.llm.common import give_back

# ASCII white space, the symbols counted, and the classes of ASCII characters.
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
MARKS = b"!\"'()+,-./:;=?@[\\]^_`{}~"
WINDOW = 5

FIELDS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
          "n_upper", "n_digits", "n_marks", "n_distinct_words")
TYPE = StructType([StructField(f, LongType()) for f in FIELDS])


def _count(b: bytes, chars: bytes) -> int:
    return len(b) - len(b.translate(None, chars))


def repeat_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words inside k-word windows that occur twice or more in the text, the first included."""
    if len(words) <= k:
        return 0
    # Numbers instead of words: a window of a long text then hashes k small integers.
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    windows = list(zip(*(ids[i:] for i in range(k))))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + k - max(i, upto)
            upto = i + k
    return covered


def counts(text: str | None) -> tuple[int, ...]:
    """The FIELDS of a text; a null counts as empty.

    Words are runs of anything but ASCII white space; word_chars are their code points.
    A line with a word that equals an earlier line is a duplicate line.
    """
    if not text:
        return (0,) * len(FIELDS)
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    return (len(words), len(text) - _count(b, SPACE), _count(b, SYMBOLS), len(lines), len(lines) - len(set(lines)),
            repeat_words(words), _count(b, UPPER), _count(b, DIGITS), _count(b, MARKS), len(set(words)))


@F.arrow_udf(TYPE)
def text_counts(texts: pa.Array) -> pa.Array:
    rows = [counts(t.as_py()) for t in texts]
    give_back()
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else
                                      [pa.array([], pa.int64()) for _ in FIELDS], names=list(FIELDS))


def with_counts(df, text_col: str = "text", into: str = "_stats"):
    """df with one struct column of the counts; Python sees only the text, other columns stay in the JVM."""
    return df.withColumn(into, text_counts(F.col(text_col).cast("string")))


def share(part: Column, whole: Column, prior: float) -> Column:
    """part / whole, drawn to 0 for short texts."""
    return part / (whole + F.lit(float(prior)))
