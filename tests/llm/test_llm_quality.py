"""Quality rules and classifier: exact counts, robust estimates, held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from fixtures_llm import SF, documents, empty, odd, odd_rows
from pyspark.sql import functions as F

from strata.llm import classifier, quality_rules as qr
from strata.llm.queries import QUERIES

SPACES = " \t\n\x0b\x0c\r"


def brute(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, straight from the definitions."""
    text = text or ""
    words, cur = [], ""
    for ch in text:
        if ch in SPACES:
            words, cur = (words + [cur] if cur else words), ""
        else:
            cur += ch
    words += [cur] if cur else []
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(ch not in SPACES for ch in line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(wins)
    hit = set()
    for i, w in enumerate(wins):
        if n[w] > 1:
            hit |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text), dup, len(hit)


def test_base_columns_equal_the_definitions(spark):
    got = {r.doc_id: r for r in QUERIES["op1_mcd_rules"](spark, SF).collect()}
    assert len(got) == len(documents())
    for i, t in documents():
        r, w = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == w
        assert r.base_failed == (w[0] < 10 or 100 * w[4] > 20 * w[0])
        assert not (r.base_failed and r.kept)


def test_rules_reject_junk_and_keep_clean(spark):
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    got = {r.doc_id: r for r in QUERIES["op1_mcd_rules"](spark, SF).collect()}
    good = [got[x["doc_id"]].kept for x in labels if x["quality"] == 1 and not got[x["doc_id"]].base_failed]
    bad = [got[x["doc_id"]].kept for x in labels if x["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.5


def test_outliers_are_most_of_the_bad_that_the_base_limits_leave(spark):
    labels = {x["doc_id"]: x["quality"] for x in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    left = [r for r in QUERIES["op1_mcd_rules"](spark, SF).collect() if r.doc_id in labels and not r.base_failed]
    kept = {y: [r.kept for r in left if labels[r.doc_id] == y] for y in (0, 1)}
    assert len(kept[0]) >= 20 and np.mean(kept[0]) <= 0.1 and np.mean(kept[1]) >= 0.99


def test_estimate_is_near_a_brute_force_one(spark):
    """One group, a quarter of it far away: centre and scale as from the best of many random starts."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.4, (600, qr.P)) + 1
    x[:150] = rng.normal(0, 0.1, (150, qr.P)) + 6
    df = spark.createDataFrame([("en", "s", *map(float, v)) for v in x], ["lang", "source"] + [f"x{i}" for i in range(qr.P)])
    m = {(r.lang, r.source): r for r in qr.fit(df, "t").collect()}[("en", "s")]
    h, best = int(np.ceil(600 * qr.SUPPORT)), None
    for s in range(50):
        pick = rng.choice(600, qr.P + 1, replace=False)
        for _ in range(20):
            c = np.cov(x[pick].T, bias=True) + np.diag(np.square(qr.FLOORS))
            d = np.einsum("ij,jk,ik->i", x - x[pick].mean(0), np.linalg.inv(c), x - x[pick].mean(0))
            pick = np.argsort(d, kind="stable")[:h]
        det = np.linalg.slogdet(np.cov(x[pick].T, bias=True) + np.diag(np.square(qr.FLOORS)))[1]
        if best is None or det < best[0]:
            best = (det, x[pick].mean(0))
    assert np.allclose([m[f"m{i}"] for i in range(qr.P)], best[1], atol=0.08)
    assert m.n == 600


def test_rules_odd_rows_and_empty_table(spark):
    rows = qr.quality_rules(odd(spark)).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars) for r in rows) == sorted((r[0] or -1, *brute(r[1])[:2]) for r in odd_rows())
    assert qr.quality_rules(empty(spark)).count() == 0
    kept = qr.keep_good(odd(spark))
    assert kept.columns == odd(spark).columns
    assert {r.doc_id for r in kept.collect()} <= {r[0] for r in odd_rows()}


def test_chi_square_quantiles():
    # Tabulated quantiles with 6 degrees of freedom.
    assert abs(qr.chi_square(0.5, 6) - 5.348) < 0.02 and abs(qr.chi_square(0.975, 6) - 14.449) < 0.05


def test_classifier_on_rows_held_out(spark):
    labels = {x["doc_id"]: x["quality"] for x in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    rows = QUERIES["op6_fourier_ridge"](spark, SF).collect()
    assert len(rows) == len(documents())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.95


def test_classifier_never_sees_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in classifier.quality_scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in classifier.quality_scores(docs, flipped).collect()}
    assert all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_classifier_odd_rows_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classifier.quality_scores(odd(spark), none).collect()} == {0.5}
    some = spark.createDataFrame([(3, 1), (3, 1), (6, 0), (None, 1), (7, None), (8, 1), (11, 0)], "doc_id long, quality int")
    rows = classifier.quality_scores(odd(spark), some).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert classifier.quality_scores(empty(spark), some).count() == 0


def test_pooled_means_are_monotone_and_least_squares():
    rng = np.random.default_rng(1)
    w, t = rng.integers(1, 9, 60).astype(float), None
    t = w * np.clip(np.linspace(0, 1, 60) + rng.normal(0, 0.3, 60), 0, 1)
    v = classifier.pool_adjacent(w, t)
    assert (np.diff(v) >= -1e-12).all() and abs((v * w).sum() - t.sum()) < 1e-9
