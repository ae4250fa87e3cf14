"""Token corrections: one path, whatever the size of the table."""

from strata.operators.correction import correct_tokens


def _fixed(spark, rows, pairs):
    df = spark.createDataFrame(rows, "id long, text string")
    fixes = spark.createDataFrame(pairs, "wrong string, right string")
    return sorted((r.id, r.text) for r in correct_tokens(df, fixes, clean=False).collect() if r.text is not None)


def test_nulls_ties_and_repeated_ids(spark):
    rows = [(1, "a b  a"), (1, "z b"), (2, ""), (3, "a b  a"), (3, "a b  a"), (4, None)]
    pairs = [("a", "y"), ("a", "x"), (None, "q"), ("b", None)]
    assert _fixed(spark, rows, pairs) == [(1, "x b  x"), (1, "z b"), (2, ""), (3, "x b  x"), (3, "x b  x")]
    assert _fixed(spark, rows, []) == sorted((i, t) for i, t in rows if t is not None)


def test_many_pairs(spark):
    pairs = [(f"w{i}", f"r{i}") for i in range(20_000)]
    rows = [(i, " ".join(f"w{(i * 31 + j) % 25_000}" for j in range(40))) for i in range(50)]
    want = [(i, " ".join(t.replace("w", "r") if int(t[1:]) < 20_000 else t for t in s.split(" "))) for i, s in rows]
    assert _fixed(spark, rows, pairs) == want


def test_texts_are_corrected_where_they_are_or_by_a_join_with_the_same_rows(spark, monkeypatch):
    from strata.operators import correction as CR
    rows = [(1, "a  b a "), (1, "z b"), (None, "a"), (2, ""), (3, " "), (4, None), (3, " "), (5, "가 A a\nb")]
    pairs = [("a", "b"), ("b", "a"), ("", "_"), ("가", "가나")]
    df = spark.createDataFrame(rows, "id long, text string")
    fixes = spark.createDataFrame(pairs, "wrong string, right string")
    near = correct_tokens(df, fixes, clean=False)
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()  # no text is moved
    monkeypatch.setattr(CR, "MAX_BROADCAST_BYTES", 0)
    far = correct_tokens(df, fixes, clean=False)
    key = lambda r: (str(r.id), str(r.text))
    want = [(1, "b _ a b _"), (1, "z a"), (2, ""), (3, "_ _"), (3, "_ _"), (4, None), (5, "가나 A a\nb"), (None, "b")]
    assert [tuple(r) for r in sorted(near.collect(), key=key)] == [tuple(r) for r in sorted(far.collect(), key=key)] == want


def test_long_columns_are_split_in_bounded_runs(monkeypatch):
    import pyarrow as pa
    from strata.operators import correction as CR
    texts = [None, "", "a", "a  b", None, "c" * 50 + " a", " "] * 3
    want = [t and " ".join({"a": "가"}.get(w, w) for w in t.split(" ")) for t in texts]
    for size in (1, 7, 10**6):
        monkeypatch.setattr(CR, "SPLIT_BYTES", size)
        column = pa.array(["x", *texts]).slice(1)
        assert all(len(r) == 1 or sum(len(t or "") for t in r.to_pylist()) <= size for r in CR._runs(column))
        assert CR.replaced(column, pa.array(["a"]), pa.array(["가"])).to_pylist() == want
