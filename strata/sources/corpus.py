"""Derived inputs: the labelled ``corpus`` and the ``logits`` table.

``corpus`` has the reference's input shape (id, three code levels, three short
texts) and is derived from ``documents``; ``logits`` gives one score vector per
row of ``embeddings``, from a fixed head over all its dimensions. Both are plain projections, so they stay inside the scan
stage and inherit its pruning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strata.functions.text import TEXT_COLS
from strata.operators.scoring import linear_scores

# Fixed values of the fixture: language -> top-level code.
LANG_CODES = {"de": "A", "en": "B", "es": "C", "fr": "D"}
OTHER_CODE = "Z"


def _lines(n: int = 3) -> Column:
    """Lines 1 .. n-1 and the rest of the document as the n-th part: the split
    stops after n-1 cuts, so a document is scanned once and no text is dropped."""
    return F.split(F.col("text"), "\n", n)


def _line(parts: Column, i: int) -> Column:
    """Part i (1-based); '' past the last part, NULL for a NULL text."""
    return F.when(parts.isNotNull(), F.coalesce(F.get(parts, i - 1), F.lit("")))


def corpus(documents: DataFrame, nulls: bool = False) -> DataFrame:
    """documents -> (id, digit_1, digit_2, digit_3, text_obj, text_mthd, text_deal).

    text_obj = line 1, text_mthd = line 2, text_deal = the rest of the document
    (lines 3..end), so the three texts together are the whole document.
    With ``nulls=True`` blank texts become NULL instead of ''.
    """
    lang = F.col("lang")
    code = F.lit(OTHER_CODE)
    for k in sorted(LANG_CODES, reverse=True):
        code = F.when(lang == k, LANG_CODES[k]).otherwise(code)
    parts = F.col("_lines")
    texts = []
    for i, name in enumerate(TEXT_COLS, start=1):
        t = F.nullif(_line(parts, i), F.lit("")) if nulls else F.coalesce(_line(parts, i), F.lit(""))
        texts.append(t.alias(name))
    return documents.withColumn("_lines", _lines(len(TEXT_COLS))).select(
        F.col("doc_id").alias("id"),
        code.alias("digit_1"),
        F.floor(F.col("n_chars") / 10000).cast("int").alias("digit_2"),
        F.floor(F.col("n_chars") / 1000).cast("int").alias("digit_3"),
        *texts,
    )


def head(member: int = 0, num_classes: int = 10, dims: int = 64) -> list[list[float]]:
    """Fixed linear heads over all dimensions: w[c][d] = (((7 + 2m) c + (3 + m) d) mod 11 - 5) / 10."""
    return [[(((7 + 2 * member) * c + (3 + member) * d) % 11 - 5) / 10.0 for d in range(dims)] for c in range(num_classes)]


def logits(embeddings: DataFrame, member: int = 0, num_classes: int = 10, scale: float = 10.0,
           id_col: str = "vec_id") -> DataFrame:
    """embeddings -> (id, label, z ARRAY<DOUBLE>): z = scale * head(member) x, over the whole vector."""
    w = [[scale * v for v in row] for row in head(member, num_classes)]
    return embeddings.select(F.col(id_col).alias("id"), F.col("label").cast("int").alias("label"),
                             linear_scores("embedding", w).alias("z"))
