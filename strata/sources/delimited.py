"""Delimited text in legacy Korean encodings, and small JSON tables.

Java decoders never raise on bad bytes (they yield U+FFFD) and Java encoders
silently write '?' for characters a charset lacks, so "try cp949, else utf-8"
is done by detection. Python's cp949 is Java's ``MS949``; Java's ``cp949`` and
``EUC-KR`` are other tables and lose syllables such as 똠.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from strata.functions.text import TEXT_COLS
from strata.session import drop_table, scratch_path

CP949 = "MS949"
UTF8 = "UTF-8"
REPLACEMENT = "�"

CORPUS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("digit_1", T.StringType()),
    T.StructField("digit_2", T.IntegerType()),
    T.StructField("digit_3", T.IntegerType()),
    T.StructField("text_obj", T.StringType()),
    T.StructField("text_mthd", T.StringType()),
    T.StructField("text_deal", T.StringType()),
])


# Names that mean the Korean code page; Java's own ``cp949`` and ``EUC-KR``
# tables lose syllables such as 똠, so all of them are read and written as MS949.
KOREAN_ALIASES = {"cp949", "ms949", "euc-kr", "euckr", "uhc", "ks_c_5601-1987"}


def charset(name: str) -> str:
    return CP949 if name.lower() in KOREAN_ALIASES else name


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _any(conds):
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def legacy_charsets(spark: SparkSession) -> None:
    """MS949 is only reachable with the legacy charset switch (a runtime SQL conf)."""
    if spark.conf.get("spark.sql.legacy.javaCharsets", "false").lower() != "true":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


#: Quotes inside a quoted cell are doubled, in files read and written.
DIALECT = {"quote": '"', "escape": '"'}


def _reader(spark: SparkSession, schema, sep: str, encoding: str, header: bool, multi_line: bool, mode: str = "PERMISSIVE"):
    legacy_charsets(spark)
    r = (spark.read.options(**DIALECT).option("sep", sep).option("header", header).option("encoding", encoding)
         .option("multiLine", multi_line).option("mode", mode))
    return r.schema(schema) if schema is not None else r.option("inferSchema", False)


def read_delimited(spark: SparkSession, path: str, sep: str = "|", encoding: str | None = None,
                   schema: T.StructType | None = CORPUS_SCHEMA, header: bool = True,
                   fallback: str = UTF8, fill_text: bool = True, multi_line: bool = False,
                   mode: str = "PERMISSIVE", bad_col: str | None = None) -> DataFrame:
    """A1. With ``encoding=None``: MS949 unless decoding it produces U+FFFD
    anywhere, header and numbers included, then ``fallback``; the probe stops at the first bad row.

    ``multi_line`` reads cells with line ends; a file is then one task, so it is only done on request.
    A cell that does not fit the schema is NULL; with ``bad_col`` that column holds the whole
    line of such a row (NULL for good rows), and mode 'FAILFAST' raises instead.
    """
    if encoding is None:
        probe = _reader(spark, None, sep, CP949, False, multi_line).csv(path)
        bad = _any([F.coalesce(F.instr(F.col(c), REPLACEMENT) > 0, F.lit(False)) for c in _strings(probe)])
        encoding = CP949 if probe.filter(bad).isEmpty() else fallback
    if bad_col and schema is not None:
        schema = T.StructType([*schema.fields, T.StructField(bad_col, T.StringType())])
    reader = _reader(spark, schema, sep, charset(encoding), header, multi_line, mode)
    df = (reader.option("columnNameOfCorruptRecord", bad_col) if bad_col else reader).csv(path)
    if fill_text:
        df = df.fillna("", subset=[c for c in TEXT_COLS if c in df.columns])
    return df


@contextmanager
def _conf(spark: SparkSession, key: str, value: str):
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def encodable(df: DataFrame, charset: str) -> bool:
    """True if every string value survives ``charset`` (checked on the executors)."""
    cols = _strings(df)
    if not cols:
        return True
    spark = df.sparkSession
    with _conf(spark, "spark.sql.legacy.codingErrorAction", "true"):
        lost = _any([F.coalesce(F.decode(F.encode(F.col(c), charset), charset) != F.col(c), F.lit(False)) for c in cols])
        return df.filter(lost).isEmpty()


def write_delimited(df: DataFrame, path: str, sep: str = "|", encoding: str = CP949,
                    fallback: str = UTF8, header: bool = True, mode: str = "overwrite", stored: bool = False) -> str:
    """A2: write ``sep``-separated text; if a value cannot be written in
    ``encoding``, write the whole table in ``fallback``. Returns the charset used.

    The rows are read twice, by the check and by the writer. Unless they are ``stored`` (``df`` only reads
    a table) they are computed once, into a scratch table; where the fallback is the encoding itself,
    there is nothing to check."""
    spark = df.sparkSession
    legacy_charsets(spark)
    encoding = charset(encoding)
    kept = None
    if encoding == fallback:
        chosen = encoding
    else:
        if not stored:
            kept = scratch_path(spark, "to-write")
            df.write.option("compression", "zstd").parquet(kept)
            df = spark.read.schema(df.schema).parquet(kept)
        chosen = encoding if encodable(df, encoding) else fallback
    (df.write.mode(mode).options(**DIALECT).option("sep", sep).option("header", header).option("encoding", chosen)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
    if kept:
        drop_table(spark, kept)
    return chosen


def write_table_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A3: persist a small table (e.g. the label map) as JSON lines."""
    df.write.mode(mode).json(path)


def write_indented_json(df: DataFrame, path: str, key: str, mode: str = "overwrite") -> None:
    """A8 (as the reference writes it): one indented JSON document per value of ``key``, in a folder
    of its own; ``key`` must be unique."""
    body = F.to_json(F.struct(*[c for c in df.columns if c != key]), {"pretty": "true"})
    df.select(key, body.alias("value")).write.mode(mode).partitionBy(key).text(path)


def read_table_json(spark: SparkSession, path: str | list[str], schema=None, multi_line: bool = False,
                    with_source: bool = False, encoding: str | None = None) -> DataFrame:
    """Read JSON tables (one or many paths); optionally tag each row with its file.
    ``multi_line`` reads one document per file, indented or not, a byte order mark included."""
    r = spark.read.option("multiLine", multi_line)
    if encoding is not None:
        legacy_charsets(spark)
        r = r.option("encoding", charset(encoding))
    if schema is not None:
        r = r.schema(schema)
    df = r.json(path)
    if with_source:
        df = df.withColumn("source_file", F.input_file_name())
    return df
