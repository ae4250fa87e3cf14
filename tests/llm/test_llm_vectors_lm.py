"""Vector near-duplicates against brute force; language-model scores against a plain model."""

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from fixtures_llm import SF, documents, empty, odd, odd_rows
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from strata.llm import flat_graph as fg, xent
from strata.llm.queries import QUERIES


def brute(rows, threshold=0.95):
    """vec_id -> (n_links, component, kept) for distinct ids with valid vectors, by all pairs."""
    ids = [i for i, _ in rows]
    u = np.array([v for _, v in rows], dtype=np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= threshold
    np.fill_diagonal(link, False)
    comp = {}
    for i in np.argsort(ids):
        if i in comp:
            continue
        comp[i], todo = ids[i], [i]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]):
                if j not in comp:
                    comp[j] = ids[i]
                    todo.append(j)
    return {ids[i]: (int(link[i].sum()), comp[i], comp[i] == ids[i]) for i in range(len(ids))}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_vector_query_equals_brute_force(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    assert result(QUERIES["op2_flat_graph"](spark, SF)) == brute(list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist())))


def clustered(seed, n=1500, dim=24):
    """Dense groups, groups near the threshold, exact and scaled copies, chains and lone vectors."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dim) for _ in range(n)]
    for size, noise in ((300, 0.02), (120, 0.06), (60, 0.045), (2, 0.03), (2, 0.05), (3, 0.06)):
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        out += [c + rng.normal(scale=noise, size=dim) for _ in range(size)]
    out += [out[5], out[5] * 3.0, out[7]]
    x, y = rng.normal(size=(2, dim))
    out += [x * math.cos(0.25 * i) + y * math.sin(0.25 * i) for i in range(8)]
    order = rng.permutation(len(out))
    return [(int(i) * 3, out[j].astype(np.float32).tolist()) for i, j in enumerate(order)]


def test_vectors_dense_chained_and_copied(spark):
    rows = clustered(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got, want = result(fg.near_vectors(df, shard=200)), brute(rows)
    links = sum(w[0] for w in want.values())
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.99 * links
    assert np.mean([got[i] == want[i] for i in want]) >= 0.99


def test_groups_are_bounded_beside_a_hot_ball(spark, monkeypatch):
    """Hot ball with satellites 0.2 to 0.3 away: no group holds more than some pieces, and nothing is lost."""
    rng = np.random.default_rng(4)
    hot = rng.normal(size=24)
    hot /= np.linalg.norm(hot)
    side = [np.linalg.qr(np.stack([hot, rng.normal(size=24)]).T)[0].T[1] for _ in range(40)]
    vectors = [hot + rng.normal(scale=0.012, size=24) for _ in range(900)] + [hot * math.cos(a) + s * math.sin(a) for s, a in zip(side, rng.uniform(0.2, 0.36, 40))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    most, apply = spark.sparkContext.accumulator(0), PandasCogroupedOps.applyInArrow

    def watched(self, fn, schema):
        def run(left, right):
            if max(left.num_rows, right.num_rows) > 100:
                most.add(1)
            return fn(left, right)

        return apply(self, run, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", watched)
    assert result(fg.near_vectors(df, piece=50)) == brute(list(enumerate(vectors)))
    assert most.value == 0


def test_wide_shards_are_split(spark):
    rows = [(i, fg._units(v[None])[0].tobytes(), 0.0, 0, 0) for i, v in enumerate(np.random.default_rng(6).normal(size=(2000, 8)))]
    dealt = spark.createDataFrame(rows, "vertex long, c binary, r double, turn int, shard int")
    parts = fg._split(dealt, 8, 400).groupBy("shard", "sub").count().collect()
    assert sum(p["count"] for p in parts) == 2000 * fg.SPLIT_OVERLAP and max(p["count"] for p in parts) <= 600
    assert fg._split(dealt, 8, 2000).groupBy("sub").count().collect() == [(0, 2000)]
    small = clustered(7, n=600)
    df = spark.createDataFrame(small, "vec_id long, embedding array<float>")
    got, want = result(fg.near_vectors(df, shard=400, wide=300)), brute(small)
    assert set(got) == set(want) and np.mean([got[i] == want[i] for i in want]) >= 0.99


def test_lost_links_beside_a_hot_group_are_noticed(spark, monkeypatch):
    """A third of the vectors in one ball: its certain links must not hide that the search finds nothing."""
    rng = np.random.default_rng(3)
    hot, arcs = rng.normal(size=24), [np.linalg.qr(rng.normal(size=(24, 2)))[0].T for _ in range(200)]
    vectors = [hot + rng.normal(scale=0.002, size=24) for _ in range(300)] + [x * math.cos(0.28 * i) + y * math.sin(0.28 * i) for x, y in arcs for i in range(3)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    assert sum(w[0] for w in brute(list(enumerate(vectors))).values()) > 300 * 299
    monkeypatch.setattr(fg, "_search", lambda vertices, *a: vertices.select(F.col("vertex").alias("a"), F.col("vertex").alias("b")).limit(0))
    with pytest.raises(RuntimeError, match="links beyond its ball"):
        fg.near_vectors(df)


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 0.0]), (8, []), (9, [1.0, 0.0, 0.0]),
            (10, [1.0, 0.0]), (10, [1.0, 0.0]), (None, [1.0, 0.0]), (11, [0.0, -1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, n_links string, component_id int")
    got = fg.near_vectors(df).collect()
    assert len(got) == 12
    want = {i: (0, i, True) for i in range(1, 12)} | {1: (2, 1, True), 2: (2, 1, False), 10: (2, 1, False), None: (0, None, True)}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want
    assert fg.near_vectors(df.limit(0)).count() == 0
    assert fg.near_vectors(df.filter("vec_id = 3")).collect()[0].n_links == 0


def test_graph_search_alone_finds_the_range():
    """Recall of the search from the medoid only, without the query's own vertex."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 32))
    x = fg._units(np.repeat(base, 20, axis=0) + rng.normal(scale=0.08, size=(800, 32)))
    graph = fg.build_graph(x)
    assert max(map(len, graph)) <= 2 * fg.DEGREE
    medoid, reach, hit, all_ = int(np.argmax(x @ x.sum(axis=0))), math.acos(0.95), 0, 0
    for i in range(0, 800, 20):
        want = set(np.flatnonzero(x @ x[i] >= 0.95))
        hit += len(want & set(fg.range_search(x, graph, [medoid], x[i], reach, beam=48)))
        all_ += len(want)
    assert hit >= 0.9 * all_


def plain_model(texts, vocabulary, kept):
    """(log p of a token given its context) by dictionaries."""
    uni, pair, ctx, total = Counter(), Counter(), Counter(), 0
    for t in texts:
        prev = "<s>"
        for w in (w if w in vocabulary else None for w in xent.words(t)):
            uni[w] += 1
            pair[prev, w] += 1
            ctx[prev] += 1
            total += 1
            prev = w
    v = len(vocabulary)
    single = lambda w: (uni[w] + xent.ADD) / (total + xent.ADD * (v + 1))
    direct = lambda p, w: max(pair[p, w] - xent.DISCOUNT, 0) / max(ctx[p], 1) if (p, w) in kept else 0.0
    left = lambda p: max(1 - sum(direct(q, w) for q, w in kept if q == p), 1e-12)
    cache = {}

    def logp(p, w):
        if p not in cache:
            cache[p] = left(p)
        return math.log(direct(p, w) + cache[p] * single(w))

    return logp, {p: sum(math.exp(logp(p, w)) for w in [*vocabulary, None]) for p in list(ctx)[:20]}


def test_scores_equal_a_plain_model(spark):
    docs = spark.createDataFrame(documents()[:150] + [(r[0] + 5000, r[1]) for r in odd_rows() if r[0] is not None and r[0] != 3], "doc_id long, text string")
    good = docs.filter("doc_id % 3 = 0").select("doc_id")
    share, pair_share = 3e-4, 1e-3
    got = {r.doc_id: r for r in xent.cross_entropy_difference(docs, good, word_share=share, bigram_share=pair_share).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    tgt, back = [t for i, t in texts.items() if i % 3 == 0], list(texts.values())

    def common(counts, least):
        totals = [sum(c.values()) for c in counts]
        return {k for c, n in zip(counts, totals) for k, m in c.items() if m >= max(least * n, 1)}

    vocabulary = common([Counter(w for t in x for w in xent.words(t)) for x in (tgt, back)], share)
    pairs = []
    for x in (tgt, back):
        c = Counter()
        for t in x:
            w = [w if w in vocabulary else None for w in xent.words(t)]
            c.update(zip(["<s>", *w], w))
        pairs.append(c)
    kept = common(pairs, pair_share)
    (lt, st), (lb, sb) = plain_model(tgt, vocabulary, kept), plain_model(back, vocabulary, kept)
    assert all(abs(s - 1) < 1e-9 for s in [*st.values(), *sb.values()])
    assert set(got) == set(texts)
    for i, t in texts.items():
        w = [w if w in vocabulary else None for w in xent.words(t)]
        a = -sum(lt(p, x) for p, x in zip(["<s>", *w], w))
        b = -sum(lb(p, x) for p, x in zip(["<s>", *w], w))
        assert got[i].n_tokens == len(w) and math.isclose(got[i].target_loss, a, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(got[i].background_loss, b, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(got[i].score, (a - b) / max(len(w), 1), rel_tol=1e-6, abs_tol=1e-9)


def test_score_query_covers_all_documents_and_prefers_the_target(spark):
    got = {r.doc_id: r for r in QUERIES["op3_cross_entropy"](spark, SF).collect()}
    assert {i: len(xent.words(t)) for i, t in documents()} == {i: r.n_tokens for i, r in got.items()}
    labels = {x["doc_id"]: x["quality"] for x in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    mean = lambda q: np.mean([got[i].score for i, y in labels.items() if y == q and got[i].n_tokens])
    assert mean(1) < mean(0)


def test_scores_odd_rows_and_empty_targets(spark):
    none = spark.createDataFrame([], "doc_id long")
    rows = xent.cross_entropy_difference(odd(spark), none).collect()
    assert len(rows) == len(odd_rows()) and all(math.isfinite(r.score) for r in rows)
    assert all(r.score == 0 for r in rows if r.n_tokens == 0)
    assert xent.cross_entropy_difference(empty(spark), none).count() == 0
    assert xent.cross_entropy_difference(odd(spark), odd(spark).select(F.col("doc_id"))).count() == len(odd_rows())


def test_default_model_holds_every_word_and_bigram(spark):
    """A pair far below any share of the tokens has its own loss, from the broadcast head or from the join."""
    common = [(i, "a b " * 100_000) for i in range(3)]
    docs = spark.createDataFrame([*common, (3, "rare pair"), (4, "rare pair"), (5, "pair rare"), (None, "rare a")], "doc_id long, text string")
    good = docs.filter("doc_id in (0, 3)").select("doc_id")
    texts = [r.text for r in docs.collect()]
    tgt = [texts[0], texts[3]]
    vocabulary = {w for t in texts for w in xent.words(t)}
    kept = {p for t in texts for p in zip(["<s>", *xent.words(t)], xent.words(t))}
    models = [plain_model(x, vocabulary, kept)[0] for x in (tgt, texts)]
    loss = lambda logp, w: -sum(n * logp(*p) for p, n in Counter(zip(["<s>", *w], w)).items())
    want = sorted((len(w), *(loss(m, w) for m in models)) for w in map(xent.words, texts))
    for head in (xent.HEAD, 2):
        got = sorted((r.n_tokens, r.target_loss, r.background_loss) for r in xent.cross_entropy_difference(docs, good, head=head).collect())
        assert np.allclose(got, want, rtol=1e-9)


def test_scores_are_the_same_from_many_blocks_buckets_and_parts_of_contexts(spark, monkeypatch):
    monkeypatch.setattr(xent, "BLOCK", 300)
    monkeypatch.setattr(xent, "PER_BUCKET", 200)
    monkeypatch.setattr(xent, "PER_WORDS", 500)
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"the w{k}" if k % 3 else f"w{k}" for k in rng.zipf(1.3, 40) % 200)) for i in range(120)] + [(200, None), (201, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id")
    texts = dict(docs)
    good = [i for i in texts if i % 2]
    got = {r.doc_id: r for r in xent.cross_entropy_difference(df, spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()}
    vocabulary = {w for t in texts.values() for w in xent.words(t)}
    kept = {p for t in texts.values() for p in zip(["<s>", *xent.words(t)], xent.words(t))}
    models = [plain_model(x, vocabulary, kept)[0] for x in ([texts[i] for i in good], list(texts.values()))]
    assert set(got) == set(texts)
    for i, t in texts.items():
        w = xent.words(t)
        want = [-sum(logp(*p) for p in zip(["<s>", *w], w)) for logp in models]
        assert got[i].n_tokens == len(w) and np.allclose([got[i].target_loss, got[i].background_loss], want, rtol=1e-9)


def test_the_model_of_a_corpus_is_written_in_less_than_its_texts(spark, tmp_path):
    """Packed rows of blocks and buckets, not a copy of the texts and a row per bigram."""
    from strata.session import checkpoint_dir

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    xent.cross_entropy_difference(docs, docs.filter("doc_id % 2 = 0").select("doc_id"), name=tmp_path.name).count()
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    written = sum(f.stat().st_size for d in folder.glob(f"strata-{tmp_path.name}-*") for f in d.rglob("*.parquet"))
    assert 0 < written < sum(len((t or "").encode()) for _, t in documents())
