import tempfile

from strata.sources import delimited as DL

ROWS = [(1, "A", 1, 11, "똠방각하", " 앞 공백", ""), (2, "B", None, 3, None, "x|y", '"q"')]
SCHEMA = "id long, digit_1 string, digit_2 int, digit_3 int, text_obj string, text_mthd string, text_deal string"


def _fresh():
    return tempfile.mkdtemp(prefix="strata-test-") + "/t"


def test_ms949_round_trip_keeps_rare_syllables(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = _fresh()
    assert DL.write_delimited(df, path) == "MS949"
    back = DL.read_delimited(spark, path).orderBy("id").collect()
    assert back[0].text_obj == "똠방각하" and back[0].text_mthd == " 앞 공백"
    assert back[1].text_obj == "" and back[1].text_mthd == "x|y" and back[1].text_deal == '"q"'


def test_unencodable_text_falls_back_to_utf8(spark):
    df = spark.createDataFrame([(1, "A", 1, 1, "café ✓", "", "")], SCHEMA)
    path = _fresh()
    assert DL.write_delimited(df, path) == "UTF-8"
    assert DL.read_delimited(spark, path).first().text_obj == "café ✓"


def test_utf8_file_is_detected(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = _fresh()
    DL.write_delimited(df, path, encoding="UTF-8")
    assert DL.read_delimited(spark, path).orderBy("id").first().text_obj == "똠방각하"


def test_korean_charset_aliases_map_to_ms949(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = _fresh()
    assert DL.write_delimited(df, path, encoding="euc-kr") == "MS949"
    assert DL.read_delimited(spark, path, encoding="cp949").orderBy("id").first().text_obj == "똠방각하"


def test_reads_what_pandas_writes_and_the_other_way(spark, tmp_path):
    import pandas as pd
    rows = [(1, "A", 1, 11, 'a "b" c', "x|y", "plain"), (2, "B", 2, 3, "", '"', "back\\slash"), (3, "C", 4, 5, "two\nlines", "", 'end"')]
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    (tmp_path / "in").mkdir()
    frame.to_csv(tmp_path / "in" / "part.csv", sep="|", index=False, encoding="cp949")
    back = DL.read_delimited(spark, str(tmp_path / "in"), multi_line=True).orderBy("id").collect()
    assert [tuple(r) for r in back] == rows
    path = str(tmp_path / "out")
    DL.write_delimited(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, encoding="UTF-8")
    files = sorted((tmp_path / "out").glob("part-*"))
    again = pd.concat([pd.read_csv(f, sep="|", keep_default_na=False) for f in files]).sort_values("id")
    assert [tuple(r) for r in again.itertuples(index=False)] == rows


def test_bad_cells_are_kept_with_their_line_or_raise(spark, tmp_path):
    import pytest
    (tmp_path / "a.csv").write_text("id|digit_1|digit_2|digit_3|text_obj|text_mthd|text_deal\n1|A|bad|3|x|y|z\n2|A|2|3|x|y|z\n")
    df = DL.read_delimited(spark, str(tmp_path / "a.csv"), bad_col="_line")
    assert [(r.id, r.digit_2, r._line) for r in df.orderBy("id").collect()] == [(1, None, "1|A|bad|3|x|y|z"), (2, 2, None)]
    with pytest.raises(Exception):
        DL.read_delimited(spark, str(tmp_path / "a.csv"), mode="FAILFAST").collect()


def test_charset_probe_reads_header_and_numbers_too(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id|digit_1|digit_2|digit_3|text_obj|text_mthd|é✓\n1|A|1|3|x|y|z\n".encode())
    assert DL.read_delimited(spark, str(tmp_path / "a.csv"), schema=None, fill_text=False).columns[-1] == "é✓"


def test_indented_json_with_a_byte_order_mark_and_in_korean(spark, tmp_path):
    import json
    for k, enc in enumerate(("utf-8-sig", "cp949")):
        folder = tmp_path / f"run_id={k}"
        folder.mkdir()
        (folder / "c.json").write_bytes(json.dumps({"loss": "가나 CE", "epochs": k}, indent=2, ensure_ascii=False).encode(enc))
    got = DL.read_table_json(spark, str(tmp_path / "run_id=0"), schema="loss string, epochs long", multi_line=True).collect()
    assert [(r.loss, r.epochs) for r in got] == [("가나 CE", 0)]
    got = DL.read_table_json(spark, str(tmp_path / "run_id=1"), schema="loss string, epochs long", multi_line=True, encoding="cp949").collect()
    assert [(r.loss, r.epochs) for r in got] == [("가나 CE", 1)]


def test_rows_are_computed_once_for_the_check_and_the_write(spark):
    from pyspark.sql import functions as F
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(v):
        seen.add(1)
        return v
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("text_obj", counted.asNondeterministic()("text_obj"))
    path = _fresh()
    assert DL.write_delimited(df, path) == "MS949"
    assert seen.value == len(ROWS)  # the check's pass was a second one
    assert DL.read_delimited(spark, path).count() == len(ROWS)


def test_a_table_of_one_row_group_is_spread_over_the_cores(spark):
    from pyspark.sql import functions as F
    from strata.session import spread
    path = _fresh()
    spark.range(0, 400_000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 512).alias("v")).write.parquet(path)
    with DL._conf(spark, "spark.sql.files.openCostInBytes", "1"), DL._conf(spark, "spark.sql.files.maxPartitionBytes", "1000000"):
        df = spark.read.parquet(path)
        cores = spark.sparkContext.defaultParallelism
        assert df.rdd.getNumPartitions() >= cores  # by its splits it seems spread
        got = spread(df)
        assert got.groupBy(F.spark_partition_id()).count().count() >= cores and got.distinct().count() == 400_000
