"""Spelling variants, Re-Pair files of token ids and the conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from fixtures_llm import SF, documents, empty, odd, odd_rows
from tokenizers import Tokenizer

from strata.llm import burst_trie, repair_ids, spelling_tiles
from strata.llm.queries import QUERIES
from strata.llm.tokens import encode_json
from strata.llm.zip_warc import open_fs

JSON = P.path("byte_bpe_50k.json")

# --- op11 --------------------------------------------------------------------------------------


def plain_words(docs):
    out = Counter()
    for i, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    a, b = sorted((u, v), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def variants(df, **kw):
    rows = spelling_tiles.spelling_variants(df, **kw).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def family_docs(seed=4):
    """Words whose variants chain (each form five times as frequent), with letters beyond ASCII."""
    rng = random.Random(seed)
    docs = []
    for k in range(6):
        word = "".join(rng.choice("abcdeéß÷×") for _ in range(rng.randint(6, 12)))
        n = 3200
        while n >= 5:
            docs.append((10 * k + len(docs) % 7, (word + " ") * n))
            i = rng.randrange(len(word) + 1)
            word = rng.choice([word[:i] + rng.choice("xyzÀ") + word[i:], word[: i - 1] + "q" + word[i:] if i else "q" + word[1:]])
            n //= 5
    return docs


@pytest.mark.parametrize("window,tile", [(3, 2048), (3, 1), (1, 2048), (5, 3), (40, 2048)])
def test_variants_equal_brute_force_for_every_window_and_split(spark, window, tile):
    rng = random.Random(window * 100 + tile)
    docs = family_docs() + [(1000 + i, " ".join("".join(rng.choice("ab") for _ in range(rng.randint(6, 8))) for _ in range(400))) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = plain_variants(plain_words(docs))
    got = variants(df, window=window, tile=tile)
    assert got == want
    assert any(f is not None for f, *_ in want.values()) and any(r not in (f, w) for w, (f, r, *_) in want.items() if f)


def test_variants_of_odd_rows_and_of_no_rows(spark):
    docs = [(r[0], r[1]) for r in odd_rows()]
    assert variants(odd(spark)) == plain_variants(plain_words(docs))
    assert variants(empty(spark)) == {}


def test_variants_of_a_very_long_text(spark):
    docs = [(1, "variant " * 150_000 + "varient " * 9 + "z" * 1_000_000 + " " * 1_000_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert variants(df) == plain_variants(plain_words(docs))


def test_groups_of_one_letter_windows_are_small(spark):
    """Large groups are dealt again where at most the alphabet's letters can meet."""
    words = [("abcdef" + x + y + z, 5) for x in "abcdefgh" for y in "abcdefgh" for z in "abcdefgh"]
    df = spark.createDataFrame(words, "word string, n long")
    sizes = spelling_tiles.groups(df, 3, 50).groupBy(*spelling_tiles.GROUP).count()
    assert max(r["count"] for r in sizes.collect()) <= 50


# --- op12 --------------------------------------------------------------------------------------


def plain_ids(docs):
    tk = Tokenizer.from_file(JSON)
    out, start = [], 0
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[1])


def test_id_files_query_equals_the_library_on_every_document(spark):
    rows = [tuple(r) for r in QUERIES["op12_repair_ids"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(rows, key=key) == plain_ids(documents())


def test_id_files_small_shards_odd_rows_and_no_rows(spark, tmp_path):
    df = odd(spark).repartition(4)
    for file_ids, shard in ((1, 1), (700, 100), (1 << 20, 1 << 18)):
        folder = str(tmp_path / f"f{file_ids}")
        rows = [tuple(r) for r in repair_ids.read_documents(repair_ids.write_ids(df, JSON, folder, file_ids, shard), folder).collect()]
        got, want = sorted(rows, key=key), plain_ids([(r[0], r[1]) for r in odd_rows()])
        assert [r[:1] + r[2:] for r in got] == [r[:1] + r[2:] for r in want]
        assert [r[1] for r in got] == [r[1] for r in want]
    folder = str(tmp_path / "none")
    assert repair_ids.read_documents(repair_ids.write_ids(empty(spark), JSON, folder), folder).count() == 0


def corpus_ids():
    return np.concatenate([np.append(encode_json(JSON, t or ""), 0) for _, t in documents()[:150]]).astype(np.int32)


@pytest.mark.parametrize("name", ["corpus", "run", "empty", "one", "random", "pairs"])
def test_re_pair_round_trip_rules_and_random_access(tmp_path, name):
    rng = np.random.default_rng(1)
    ids = {"corpus": corpus_ids(), "run": np.full(9999, 7, np.int32), "empty": np.empty(0, np.int32), "one": np.array([3], np.int32),
           "random": rng.integers(0, 50257, 20_000).astype(np.int32), "pairs": np.tile(np.array([1, 2, 3, 1, 2], np.int32), 5000)}[name]
    first = int(ids.max(initial=0)) + 1
    seq, rounds = repair_ids.re_pair(ids, first)
    grammar = repair_ids.Grammar(rounds, first)
    assert np.array_equal(grammar.expand(seq), ids)
    if name in ("corpus", "run", "pairs"):
        assert len(seq) < 0.7 * len(ids)
    # Rules use earlier rounds only, and no rule is there twice within a round.
    known = first
    for left, right in rounds:
        assert max(left.max(), right.max()) < known
        assert len(set(zip(left.tolist(), right.tolist()))) == len(left)
        known += len(left)
    path = str(tmp_path / "x.ids")
    n = len(ids)
    with open(path, "wb") as f:
        f.writelines(repair_ids.file_bytes([5], [n], ids, 30_000))
    fs, at = open_fs(path)
    with fs.open_input_file(at) as f:
        file = repair_ids.IdFile(f)
        assert file.doc_ids == [5] and file.lengths.tolist() == [n]
        for _ in range(40):
            i, j = sorted(rng.integers(0, n + 1, 2).tolist())
            assert np.array_equal(file.ids(i, j), ids[i:j])
        assert np.array_equal(file.ids(0, n), ids)


def test_numbers_pack_and_unpack():
    for x in ([], [0], [1, 255, 256], [2**31, 5], [2**62 + 3, 0]):
        assert repair_ids.unpack(repair_ids.pack(np.array(x, np.int64))).tolist() == x


def test_very_long_texts_have_the_library_ids():
    tk = Tokenizer.from_file(JSON)
    for text in (" " * 2_000_000, "a" + " " * 1_200_000 + "b", "x" * 300_000, "\n \t" * 400_000, "<|endoftext|>" + " " * 1_000_001):
        assert encode_json(JSON, text).tolist() == tk.encode(text, add_special_tokens=False).ids


# --- op13 --------------------------------------------------------------------------------------


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, w in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + w[h:]
    members = defaultdict(list)
    for c, w in whole.items():
        for d in range(len(w) + 1):
            members[tuple(w[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    done = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        done[p] = (sum(done[k][0] for k in kids[p]) or 1, saved + sum(done[k][1] for k in kids[p]))
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *done[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONV = "conv_id long, turn long, role string, text string, key string, depth string, path string, n string"


def talk(seed=2, n=160):
    """Hot first turns, copies, nested shared prefixes, turnless rebuilds, odd rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        kind = c % 4
        size = rng.choice([1, 1, 2, 3, 8, 12])
        texts = ["hello"] * min(size, 2) + [rng.choice("ab") for _ in range(size)] if kind < 2 else (["same", "copy", "end"] if kind == 2 else [rng.choice(["x", "y é", ""]) for _ in range(size)])
        rows += [(c, t, rng.choice(["user", "user", "bot"]) if kind == 3 else "user", x, "k", "d", "p", "n") for t, x in enumerate(texts)]
    rows += [(4001, None, None, None, "k", "d", "p", "n"), (4001, 2, "user", None, "k", "d", "p", "n"), (4001, 2, "user", "tie", "k", "d", "p", "n"),
             (None, 1, "user", "nobody", "k", "d", "p", "n"), (-7, 0, "user", "minus", "k", "d", "p", "n"), rows[0],
             (5000, 0, "user", "long " * 300_000, "k", "d", "p", "n")]
    return rows


@pytest.mark.parametrize("limit", [1, 7, 60, 20_000])
def test_trie_equals_brute_force_for_every_container_size(spark, limit):
    rows = talk()
    df = spark.createDataFrame(rows, CONV).repartition(5)
    got = [tuple(r) for r in burst_trie.conversation_trie(df, limit).collect()]
    assert sorted(got, key=str) == plain_trie(rows)


def test_trie_of_a_deep_shared_prefix_and_of_no_rows(spark):
    rows = [(c, t, "user", "s" if t < 60 else f"{c}-{t}", "", "", "", "") for c in range(30) for t in range(64)]
    rows += [(5 * c + 1000, t, "user", "s", "", "", "", "") for c in range(40) for t in range(3 + c % 2)]
    df = spark.createDataFrame(rows, CONV)
    assert sorted((tuple(r) for r in burst_trie.conversation_trie(df, 50).collect()), key=str) == plain_trie(rows)
    assert burst_trie.conversation_trie(spark.createDataFrame([], CONV)).count() == 0


def test_trie_of_one_conversation_and_of_null_ids_only(spark):
    for rows in ([(5, 0, "user", "hi", "", "", "", "")], [(None, 0, "user", "hi", "", "", "", "")]):
        got = burst_trie.conversation_trie(spark.createDataFrame(rows, CONV)).collect()
        assert sorted(map(tuple, got), key=str) == plain_trie(rows)
