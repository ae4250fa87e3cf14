"""A1, splittable: delimited files whose quoted cells hold line ends, read by many tasks a file.

Files are read as raw lines in Spark's own splits. Whether a line begins a record depends on
the quotes before it in its file: each split counts its lines under both assumptions (it begins
inside quotes, or not), the parities of a file's splits (a row each) are added up in order, and then
every line knows its record. Lines that are whole records stay where they are; only the
lines of records that span several are brought together. The charset is decided file by file.

Quotes inside a quoted cell are doubled, as written by ``write_delimited``; a single quote inside an unquoted
cell would open a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from strata.functions.text import TEXT_COLS
from strata.operators.dims import checked
from strata.session import persist_table
from strata.sources.delimited import CORPUS_SCHEMA, CP949, DIALECT, charset, legacy_charsets

_LINES = "file string, start long, line long, odd int, before int, begun0 long, begun1 long, other int, raw binary"


def _korean(raw: bytes) -> bool:
    if raw.isascii():
        return True
    try:
        raw.decode("cp949")
    except UnicodeDecodeError:
        return False
    return True


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per line of a split: its number, quote parity, parity before it, the records begun up to it when the
    split begins outside (begun0) or inside (begun1) quotes, and whether it cannot be Korean (other)."""
    place, line, parity, begun = None, 0, 0, [0, 0]
    for b in batches:
        files, starts, raw = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
        out = np.empty((len(files), 6), np.int64)
        for k, (f, s, r) in enumerate(zip(files, starts, raw)):
            if (f, s) != place:
                place, line, parity, begun = (f, s), 0, 0, [0, 0]
            cell = r.as_py()
            odd = cell.count(b'"') & 1
            begun[parity] += 1  # outside quotes under one of the two assumptions
            out[k] = line, odd, parity, begun[0], begun[1], not _korean(cell)
            line, parity = line + 1, parity ^ odd
        cols = [pa.array(out[:, i], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, raw], names=[c.split()[0] for c in _LINES.split(", ")])


def _decoded(raw: str, korean: str) -> F.Column:
    return F.when(F.col(korean), F.decode(F.col(raw), CP949)).otherwise(F.make_valid_utf8(F.col(raw).cast("string")))


def read_records(spark: SparkSession, path: str | list[str], sep: str = "|", encoding: str | None = None, schema: T.StructType = CORPUS_SCHEMA,
                 header: bool = True, fill_text: bool = True, mode: str = "PERMISSIVE", bad_col: str | None = None) -> DataFrame:
    """The rows of delimited files, as ``read_delimited(multi_line=True)`` gives them, in splits.

    ``encoding``: MS949 or UTF-8; with None each file is MS949 unless a line of it is not. With ``header``
    the first record of each file is dropped. A record without a closing quote ends with its file.
    """
    legacy_charsets(spark)
    text = spark.read.option("lineSep", "\n").text(path)
    named = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("raw"))
    lines = persist_table(named.mapInArrow(_count, _LINES), "lines")
    korean = F.lit(charset(encoding) == CP949) if encoding else F.max("other") == 0
    files = lines.groupBy("file").agg(F.max("other").alias("_"), korean.alias("korean")).drop("_")
    # A split's parity is that of its quotes; its records depend on how it begins.
    splits = lines.groupBy("file", "start").agg((F.sum("odd") % 2).alias("parity"), F.max("begun0").alias("n0"), F.max("begun1").alias("n1"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    entered = splits.withColumn("inside", (F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2).cast("int"))
    begun = F.when(F.col("inside") == 0, F.col("n0")).otherwise(F.col("n1"))
    places = checked(entered.withColumn("first", F.coalesce(F.sum(begun).over(before), F.lit(0))).join(files, "file").select("file", "start", "inside", "first", "korean"))
    placed = lines.join(places.side(), ["file", "start"]).withColumn("record", F.col("first") + F.when(F.col("inside") == 0, F.col("begun0")).otherwise(F.col("begun1")))
    whole = (F.col("inside") == F.col("before")) & (F.col("odd") == 0)
    single = placed.filter(whole).select("file", "record", _decoded("raw", "korean").alias("body"))
    parts = placed.filter(~whole).select("file", "record", "start", "line", _decoded("raw", "korean").alias("body"))
    several = parts.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "line", "body"))), lambda x: x["body"]), "\n").alias("body"))
    records = single.unionByName(several)
    if header:
        records = records.filter(F.col("record") > 1)
    if bad_col:
        schema = T.StructType([*schema.fields, T.StructField(bad_col, T.StringType())])
    options = {**DIALECT, "sep": sep, "mode": mode, **({"columnNameOfCorruptRecord": bad_col} if bad_col else {})}
    body = F.regexp_replace("body", "\r$", "")
    # An empty line between records is no row.
    rows = records.filter(F.length(body) > 0).select(F.from_csv(body, schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")
    return rows.fillna("", subset=[c for c in TEXT_COLS if c in rows.columns]) if fill_text else rows
