"""Token corrections from a (wrong, right) table.

Texts are split on single spaces (so spacing survives). A table whose words fit a broadcast goes to the
texts, which are rewritten where they are: nothing is shuffled. For a larger one each row's distinct tokens meet the
table; what is found, a short list of pairs for each row that has any, goes back to its row, whose text is
rewritten in one pass. Rows without a correction pass untouched, and no token occurrence is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strata.functions.text import clean_text
from strata.llm.common import give_back
from strata.operators.dims import MAX_BROADCAST_BYTES, Dim, checked

#: Bytes of text that are split at a time (or one text).
SPLIT_BYTES = 4 << 20


@F.arrow_udf(StringType())
def _rewrite(texts: pa.Array, fixes: pa.Array) -> pa.Array:
    out = []
    for text, pairs in zip(texts.to_pylist(), fixes.to_pylist()):
        if text and pairs:
            right = {p["wrong"]: p["right"] for p in pairs}
            text = " ".join([right.get(t, t) for t in text.split(" ")])
        out.append(text)
    return pa.array(out, pa.string())


def _runs(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in runs of SPLIT_BYTES at most, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SPLIT_BYTES, "right")))
        yield texts.slice(a, b - a)
        a = b


def replaced(texts: pa.Array, wrong: pa.Array, right: pa.Array) -> pa.Array:
    """``texts`` with each token that is ``wrong[i]`` as ``right[i]``; empty ones and nulls as they are."""
    out = []
    for run in _runs(texts):
        lists = pc.split_pattern(run, " ")
        tokens = lists.flatten()
        at = pc.fill_null(pc.index_in(tokens, wrong), -1).to_numpy(zero_copy_only=False)
        tokens = pa.concat_arrays([right, tokens]).take(pa.array(np.where(at < 0, len(right) + np.arange(len(at)), at)))
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        joined = pc.binary_join(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), tokens), " ")
        some = pc.fill_null(pc.greater(pc.binary_length(run), 0), False).to_numpy(zero_copy_only=False)
        place = np.arange(len(run))
        out.append(pa.concat_arrays([joined, run]).take(pa.array(np.where(some, place, len(run) + place))))
    return pa.concat_arrays(out) if out else texts


def _by_broadcast(df: DataFrame, fixes: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    table = fixes.select("wrong", "right").toArrow()
    shared = df.sparkSession.sparkContext.broadcast([table[c].cast(pa.string()).combine_chunks() for c in ("wrong", "right")])

    @F.arrow_udf(StructType([StructField(c, StringType()) for c in cols]))
    def fixed(*texts: pa.Array) -> pa.Array:
        done = pa.StructArray.from_arrays([replaced(t.cast(pa.string()), *shared.value) for t in texts], names=list(cols))
        give_back()
        return done

    return df.withColumn("_fixed", fixed(*[F.col(c) for c in cols])).withColumns({c: F.col("_fixed")[c] for c in cols}).drop("_fixed")


def _word_bytes(fixes: Dim) -> int:
    return fixes.df.agg(F.sum(F.octet_length("wrong") + F.octet_length("right") + 8)).first()[0] or 0


def correct_columns(df: DataFrame, corrections: DataFrame, cols: tuple[str, ...], id_col: str = "id", clean: bool = True) -> DataFrame:
    """Clean (optional) then correct the text columns ``cols``; an empty or NULL text is returned as is.

    Rows of ``corrections`` with a NULL are ignored; of several corrections of a token the least
    counts. Rows with one id and different texts, and repeated rows, keep their own texts.
    """
    if clean:
        df = df.withColumns({c: clean_text(c) for c in cols})
    fixes = checked(corrections.filter("wrong is not null and right is not null").groupBy("wrong").agg(F.min("right").alias("right"))
                    .filter("wrong <> right"))
    if _word_bytes(fixes) <= MAX_BROADCAST_BYTES:
        done = _by_broadcast(df, fixes.df, cols)
        fixes.df.unpersist()
        return done
    # A row's key: its id and a digest of its texts, since ids may repeat.
    texts = F.concat_ws("\x00", *[F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-")) for c in cols])
    df = df.withColumn("_key", F.struct(F.col(id_col).alias("id"), F.md5(texts.cast("binary")).alias("text")))
    # Repeated rows have one key; their tokens are looked up together.
    each = F.flatten(F.array(*[F.split(F.coalesce(F.col(c), F.lit("")), " ") for c in cols]))
    found = (df.select("_key", F.explode(F.array_distinct(each)).alias("wrong")).join(fixes.side(), "wrong")
             .groupBy("_key").agg(F.collect_set(F.struct("wrong", "right")).alias("_fixes")))
    joined = df.join(found, "_key", "left")
    return joined.withColumns({c: F.when(F.col("_fixes").isNull(), F.col(c)).otherwise(_rewrite(F.col(c), F.col("_fixes"))) for c in cols}).drop("_key", "_fixes")


def correct_tokens(df: DataFrame, corrections: DataFrame, text_col: str = "text", id_col: str = "id",
                   out: str | None = None, clean: bool = True) -> DataFrame:
    """``correct_columns`` for one text column, into ``out`` (the column itself by default)."""
    out = out or text_col
    return correct_columns(df.withColumn(out, F.col(text_col)), corrections, (out,), id_col, clean)
