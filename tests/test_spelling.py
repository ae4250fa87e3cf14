"""Correction candidates against all-pairs edit distance, Hangul spelling, and the cleaning job."""

import unicodedata

from pyspark.sql import functions as F

from strata.operators import spelling as SP
from strata.plans import cleaning as CL
from strata.plans.catalog import doc_texts, table
from strata.functions.text import clean_text

SF001 = "/root/testdata/sf0.001"


def test_letters_are_the_canonical_decomposition(spark):
    words = ["가힣뷁한글", "똠방각하", "abc", "", "한a글1", "𝔘x"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.s for r in df.select("word", SP.letters("word").alias("s")).collect()}
    assert got == {w: unicodedata.normalize("NFD", w) for w in words}


def test_near_pairs_equal_all_pairs_at_distance_one(spark, duck):
    counts = SP.word_counts(doc_texts(spark, SF001).select(clean_text("text").alias("text"))).filter("length(word) <= 7 and n >= 2")
    rows = [tuple(r) for r in counts.collect()]
    df = spark.createDataFrame(rows, "word string, n long")
    got = sorted((r.word, r.other) for r in SP.near_pairs(df, df).collect())
    duck.execute("create or replace temp table w as select unnest($1) as word", [[w for w, _ in rows]])
    want = sorted(duck.execute("select a.word, b.word from w a join w b on abs(length(a.word) - length(b.word)) <= 1 and levenshtein(a.word, b.word) = 1").fetchall())
    # DuckDB counts bytes' edits; words of ASCII letters only are compared.
    plain = lambda ps: [(a, b) for a, b in ps if a.isascii() and b.isascii()]
    assert len(got) == len(set(got)) and plain(got) == plain(want) and len(plain(got)) > 100


def test_hangul_words_meet_by_jamo_and_ranks_go_by_count(spark):
    counts = [("한국어", 90), ("한국이", 2), ("항국어", 3), ("한굿어", 1), ("학교", 50), ("같은말", 30), ("갈은말", 3), ("abcd", 50), ("abce", 50), ("abcf", 5), ("abc", 4), ("aabcd", 1)]
    df = spark.createDataFrame(counts, "word string, n long")
    got = {r.wrong: (r.right, r.wrong_n, r.right_n, r.candidates) for r in SP.correction_candidates(df).collect()}
    assert got == {"한국이": ("한국어", 2, 90, 1), "항국어": ("한국어", 3, 90, 1), "한굿어": ("한국어", 1, 90, 1), "갈은말": ("같은말", 3, 30, 1),
                   "abcf": ("abcd", 5, 50, 2), "aabcd": ("abcd", 1, 50, 1)}


def test_no_key_of_the_index_is_hot(spark):
    counts = SP.word_counts(table(spark, SF001, "documents"))
    index = SP.delete_index(counts.select("word", "n", SP.letters("word").alias("spelling")), False)
    sizes = index.groupBy("key", "how").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 64 and sizes[0] < 0.01 * sizes[1]


def test_the_job_writes_both_outputs_and_falls_back_for_letters_that_the_charset_lacks(spark, tmp_path):
    text = ["common word", "똠방각하 common"] * 30 + ["commom word", "", None]
    rows = [(i, "A", 1, 2, t, "common", None) for i, t in enumerate(text)]
    schema = "id long, digit_1 string, digit_2 int, digit_3 int, text_obj string, text_mthd string, text_deal string"
    for extra, charset in ((None, "MS949"), ("Ѐ", "UTF-8")):
        path, out = str(tmp_path / f"in{charset}"), str(tmp_path / f"out{charset}")
        data = spark.createDataFrame(rows, schema)
        if extra:  # a large code that the Korean code page lacks; codes are not cleaned
            data = data.withColumn("digit_1", F.lit(extra))
        CL.write_delimited(data, path)
        assert CL.clean_files(spark, path, out) == (charset, charset)
        for end, sep in (("txt", "|"), ("csv", ",")):
            got = {r.id: (r.text_obj, r.text_mthd, r.text_deal) for r in CL.read_delimited(spark, f"{out}.{end}", sep=sep, encoding=charset).collect()}
            assert got[60] == ("common word", "common", "") and got[1] == ("똠방각하 common", "common", "") and got[61] == got[62] == ("", "common", "")
            assert len(got) == len(rows)


def test_the_filter_holds_every_key_and_few_others(spark, monkeypatch):
    from strata.operators import membership as MB
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    others = spark.range(10**6, 10**6 + 20_000).select(F.xxhash64("id").alias("h"))
    monkeypatch.setattr(MB, "SLICE", 1 << 12)  # many slices
    holds = MB.member_filter(keys, 5000)
    assert keys.filter(holds(F.col("h"))).count() == 5000
    assert others.filter(holds(F.col("h"))).count() < 2000
    monkeypatch.setattr(MB, "MAX_BITS", 1 << 12)  # too few bits for the keys: all of them still pass
    assert keys.filter(MB.member_filter(keys, 5000)(F.col("h"))).count() == 5000
    assert others.filter(MB.member_filter(keys.limit(0), 0)(F.col("h"))).count() == 0


def test_words_without_a_neighbour_stay_out_of_the_join(spark, monkeypatch):
    words = [(f"frequent{i:03d}", 100) for i in range(20)] + [("frequent0x1", 2)] + [(f"{i:06d}lonely{i * 7919 % 10**6:06d}", 1) for i in range(3000)]
    df = spark.createDataFrame(words, "word string, n long")
    seen, build = [], SP.member_filter
    monkeypatch.setattr(SP, "member_filter", lambda hashes, rows: seen.append(build(hashes, rows)) or seen[-1])
    got = {r.wrong: r.right for r in SP.correction_candidates(df).collect()}
    assert got == {"frequent0x1": "frequent001"} and len(seen) == 1
    index = SP.delete_index(df.select("word", "n", SP.letters("word").alias("spelling")), False)
    assert index.filter(seen[0](F.xxhash64("key", "how"))).count() < 0.1 * index.count()


def test_the_job_leaves_its_outputs_only(spark, tmp_path, monkeypatch):
    import os
    from strata import session
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: str(tmp_path / "scratch"))
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, digit_1 string, digit_2 int, digit_3 int, text_obj string, text_mthd string, text_deal string"
    CL.write_delimited(spark.createDataFrame([(1, "A", 1, 2, "one", None, "two")], schema), path)
    CL.clean_files(spark, path, out)
    assert os.path.isdir(path) and os.listdir(tmp_path / "scratch") == []
    CL.clean_files(spark, path, out, scratch=True)
    assert not os.path.exists(path) and os.listdir(tmp_path / "scratch") == []
    assert [tuple(r) for r in CL.read_delimited(spark, f"{out}.txt").collect()] == [(1, "A", 1, 2, "one", "", "two")]
