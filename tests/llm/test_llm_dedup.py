"""Near-duplicates, repeated strings, components: against brute force over whole tables."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from fixtures_llm import SF, documents, empty, odd, odd_rows, sentence

from strata.llm import column_dedup as cd, superminhash as sm
from strata.llm.components import components
from strata.llm.queries import QUERIES
from strata.llm.shingles import shingle_set


def brute_near(rows, k=4, percent=80):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ")
        w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        sets[i] = set() if not w else {tuple(w)} if len(w) < k else set(zip(*(w[j:] for j in range(k))))
    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        near = {}
        for g in s:
            for j in where[g]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        for j, both in near.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_query_equals_brute_force(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op9_superminhash"](spark, SF).collect()}
    assert got == brute_near(documents())


def test_near_duplicates_chain_group_and_odd_rows(spark):
    """A chain whose ends are not similar, and a group of near copies: one component each."""
    rng = random.Random(2)
    base = [w + str(i) for i, w in enumerate(sentence(rng, 120).split())]
    rows, words = [], list(base)
    for i in range(12):
        rows.append((100 + i, " ".join(words)))
        for j in range(6):
            words[(i * 9 + j) % 120] = f"new{i}x{j}"
    group = [w + "g" for w in base]
    for i in range(60):
        g = list(group)
        g[rng.randrange(120)] = f"edit{i}"
        rows.append((500 + i, " ".join(g)))
    rows += [(r[0], r[1]) for r in odd_rows() if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sm.near_duplicates(df).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == brute_near(rows)
    whole = sm.near_duplicates(odd(spark)).collect()
    assert [(r.component_id, r.kept) for r in whole if r.doc_id is None] == [(None, True)]
    assert sm.near_duplicates(empty(spark)).count() == 0


def test_signature_estimates_similarity_with_less_variance():
    """The share of equal slots is unbiased, and less spread than of independent hashes for small sets."""
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(300):
        x = rng.integers(0, 2**63, 30, dtype=np.uint64)
        a, b = np.sort(x[:24]), np.sort(x[6:])
        s = sm.signatures([a, b], 64)
        errors.append((s[0] == s[1]).mean() - 18 / 30)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.85 * (0.6 * 0.4 / 64)


def test_signature_walk_in_parts_equals_whole(monkeypatch):
    s = [shingle_set(t, 4) for _, t in documents()[:40]]
    a = sm.signatures(s)
    monkeypatch.setattr(sm, "WALK", 97)
    assert (sm.signatures(s) == a).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_forests_paths_and_stars(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(100, 180)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7), (None, 3)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert len(got) == len({r.id for r in got})
    assert {r.id: r.component for r in got} == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, length=100):
    """doc -> (n_bytes, spans, kept bytes), from the definition."""
    first = {}
    raw = {i: (t or "").encode() for i, t in rows if i is not None}
    for i in sorted(raw):
        for p in range(len(raw[i]) - length + 1):
            first.setdefault(hashlib.blake2b(raw[i][p : p + length], digest_size=16).digest(), (i, p))
    out = {}
    for i, x in raw.items():
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if first[hashlib.blake2b(x[p : p + length], digest_size=16).digest()] != (i, p):
                gone[p : p + length] = b"\x01" * length
        spans = np.flatnonzero(np.diff(np.pad(np.frombuffer(bytes(gone), np.uint8), 1).astype(int))).reshape(-1, 2)
        out[i] = (len(x), [tuple(map(int, s)) for s in spans], bytes(b for b, g in zip(x, gone) if not g))
    return out


def test_repeated_bytes_query_equals_brute_force(spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op4_column_suffixes"](spark, SF).collect()}
    want = {i: (n, sum(b - a for a, b in s), len(s), hashlib.sha256(x).hexdigest()) for i, (n, s, x) in brute_repeats(documents()).items()}
    assert got == want


def passages(seed):
    """Texts that share passages at all offsets, with runs, self-overlap and bytes of long characters."""
    rng = random.Random(seed)
    lines = [sentence(rng, n) for n in (12, 16, 18, 20, 25, 40, 90)] + ["z" * 230, "ab" * 120, "äöü𝔘 " * 30]
    rows = [(i, " ".join(rng.choice([rng.choice(lines), sentence(rng, rng.randint(1, 30)), rng.choice(lines)[rng.randint(0, 30) :]]) for _ in range(rng.randint(1, 8))))
            for i in range(150)]
    return rows + [(i, rows[i % 150][1]) for i in range(150, 170)] + [(r[0] + 900, r[1]) for r in odd_rows() if r[0] is not None and r[0] != 3]


@pytest.mark.parametrize("seed,slice_,settle,chunk", [(1, 1 << 20, 1 << 25, 60_000), (2, 300, 4000, 50), (3, 1000, 1, 1)])
def test_repeated_bytes_of_shared_passages(spark, monkeypatch, seed, slice_, settle, chunk):
    rows = passages(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for k, v in (("SLICE", slice_), ("SETTLE", settle), ("CHUNK", chunk)):
        monkeypatch.setattr(cd, k, v)
    got = {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in cd.remove_repeats(df).collect()}
    assert got == brute_repeats(rows)


def test_repeated_bytes_odd_rows_and_stage_columns(spark):
    rows = odd_rows()
    got = cd.remove_repeats(odd(spark)).collect()
    assert len(got) == len(rows)
    want = brute_repeats([(r[0], r[1]) for r in rows])
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, bytes(r.kept)) == (want[r.doc_id][0], want[r.doc_id][2])
        else:
            assert bytes(r.kept).decode() == rows[-1][1]
    stage = cd.without_repeats(odd(spark))
    assert stage.columns == odd(spark).columns and stage.count() == len(rows)
    assert cd.remove_repeats(empty(spark)).count() == 0


def test_columns_against_pairs():
    """The column-wise construction alone, on aligned rows, against all pairs."""
    rng = np.random.default_rng(1)
    cols = rng.integers(1, 3, (60, 30)).astype(np.uint8)
    cols[20:40] = cols[rng.integers(0, 5, 20)]
    cols[25:35, rng.integers(0, 30, 4)] = 9
    first, last = rng.integers(0, 5, 60), rng.integers(5, 19, 60)
    want = np.zeros((60, 19), bool)
    for i, j in combinations(range(60), 2):
        for c in range(max(first[i], first[j]), min(last[i], last[j]) + 1):
            want[j, c] |= bool((cols[i, c : c + 12] == cols[j, c : c + 12]).all())
    assert (cd.repeats(cols, first, last, 12) == want).all()
