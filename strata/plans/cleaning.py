"""The cleaning job end to end: read, fill, clean, correct and write the text columns.

Corrections come from the job's own words (rare words one letter from a much more frequent
one) unless a table is given. Both outputs hold the same rows: ``<out>.txt`` with the
input's separator and ``<out>.csv`` with commas, in the asked encoding or, when a value cannot be
written in it, both in UTF-8.

A scratch table goes as soon as the next one is written, so that both outputs and the table they are written
from are the most that is on disk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.functions.text import TEXT_COLS, clean_columns, fill_text
from strata.operators.correction import correct_columns
from strata.operators.spelling import correction_candidates, word_counts
from strata.session import drop_table, free_shuffles, stored
from strata.sources.delimited import CP949, UTF8, read_delimited, write_delimited

#: Texts in scratch tables: half as large as by the session's default.
CODEC = "zstd"


def _corrected(rows: DataFrame, corrections: DataFrame | None, cols: tuple[str, ...], id_col: str, limits: dict[str, int],
               after: Callable[[], None] = lambda: None) -> tuple[DataFrame, list[str]]:
    """The corrected rows and the scratch tables they read; ``after`` is called when ``rows`` are read no more."""
    path, cleaned = stored(clean_columns(fill_text(rows, cols), cols), "cleaned", codec=CODEC)
    after()
    used = [path]
    if corrections is None:
        path, words = stored(word_counts(cleaned, cols), "words", codec=CODEC)
        used.append(path)
        corrections = correction_candidates(words, **limits).select("wrong", "right")
    return correct_columns(cleaned, corrections, cols, id_col, clean=False), used


def clean_and_correct(rows: DataFrame, corrections: DataFrame | None = None, cols: tuple[str, ...] = TEXT_COLS, id_col: str = "id", **limits: int) -> DataFrame:
    """Fill, clean and correct the text columns; ``limits`` are those of ``correction_candidates``."""
    return _corrected(rows, corrections, cols, id_col, limits)[0]


def clean_files(spark: SparkSession, data_path: str, out_path: str, sep: str = "|", encoding: str = CP949, corrections: DataFrame | None = None,
                multi_line: bool = False, read_as: str | None = None, scratch: bool = False, **limits: int) -> tuple[str, str]:
    """Read ``data_path`` (in ``read_as``, or as ``read_delimited`` finds), clean and correct it, write
    both outputs in ``encoding`` or the fallback; returns the charsets used. With ``scratch`` nothing else
    needs ``data_path``: it is deleted once its rows are stored."""
    rows = read_delimited(spark, data_path, sep=sep, encoding=read_as, multi_line=multi_line)
    done, used = _corrected(rows, corrections, TEXT_COLS, "id", limits, (lambda: drop_table(spark, data_path)) if scratch else lambda: None)
    # Read by both writers and their encoding checks.
    path, done = stored(done, "corrected", codec=CODEC)
    for p in used:
        drop_table(spark, p)
    del rows
    free_shuffles(spark)
    charsets = (write_delimited(done, f"{out_path}.txt", sep=sep, encoding=encoding, fallback=UTF8, stored=True),
                write_delimited(done, f"{out_path}.csv", sep=",", encoding=encoding, fallback=UTF8, stored=True))
    drop_table(spark, path)
    return charsets
