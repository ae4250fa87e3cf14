from pyspark.sql import functions as F

from strata.functions import text as T


def test_clean_keeps_hangul_letters_digits_and_python_whitespace(spark):
    rows = [("똠방각하! ㄱㅏ abc-123",), ("a　b c\x1cd\x0be",), ("café ✓ #tag",), ("",)]
    df = spark.createDataFrame(rows, "t string").select(T.clean_text("t").alias("c"))
    assert [r.c for r in df.collect()] == ["똠방각하 ㄱㅏ abc123", "a　b c\x1cd\x0be", "caf  tag", ""]


def test_pad_code_keeps_longer_values_and_pads_null(spark):
    df = spark.createDataFrame([(5,), (1234,), (None,), (12,)], "d int")
    got = [r[0] for r in df.select(T.pad_code("d", 3)).collect()]
    assert got == ["005", "1234", "000", "012"]


def test_concat_keeps_empty_texts(spark):
    df = spark.createDataFrame([("a", None, "b")], "text_obj string, text_mthd string, text_deal string")
    assert T.concat_text(T.fill_text(df)).first().text == "a  b"


def test_non_empty_drops_all_empty_rows(spark):
    df = spark.createDataFrame([("", "", ""), ("", None, "x"), (None, None, None)],
                               "text_obj string, text_mthd string, text_deal string")
    assert T.non_empty(df).count() == 1


def test_class_code(spark):
    df = spark.createDataFrame([("C", 1, 23), ("A", 10, 1234)], "digit_1 string, digit_2 int, digit_3 int")
    assert [r[0] for r in df.select(T.class_code()).collect()] == ["C01023", "A101234"]


def test_clean_hook_accepts_pandas_udf(spark):
    import pandas as pd

    @F.pandas_udf("string")
    def shout(s: pd.Series) -> pd.Series:
        return s.str.upper()

    df = spark.createDataFrame([("ab", "c", "")], "text_obj string, text_mthd string, text_deal string")
    out = T.apply_text_fn(df, shout).first()
    assert (out.text_obj, out.text_mthd, out.text_deal) == ("AB", "C", "")


def test_cleaning_keeps_the_same_characters_whichever_way_the_set_is_told(spark):
    # Every code point; the ASCII ones are told apart without trying the ranges.
    text = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    df = spark.createDataFrame([(text[i:i + 4096],) for i in range(0, len(text), 4096)] + [(None,)], "text string")
    assert df.filter(~F.regexp_replace("text", T.CLEAN_PATTERN, "").eqNullSafe(T.clean_text("text"))).count() == 0
    assert T.FAST_PATTERN.startswith("[\\x00") and "a-z" not in T.FAST_PATTERN.split("&&")[0]
