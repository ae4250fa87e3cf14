"""Encoding, decoding and packing against the public libraries and exact invariants."""

import hashlib
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from fixtures_llm import SF, documents, empty, odd, odd_rows
from tokenizers import Tokenizer

from strata.llm import packing, word_bpe
from strata.llm.queries import QUERIES
from strata.llm.tokens import from_json, from_ranks, rank_table

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=rank_table(RANKS), special_tokens={})


def test_bpe_query_equals_tiktoken_on_every_document(spark):
    enc = reference()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op10_word_bpe"](spark, SF).collect()}
    want = {}
    for i, t in documents():
        ids = enc.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert got == want


def test_bpe_odd_rows_small_blocks_and_round_trip(spark):
    enc = reference()
    df = odd(spark).repartition(3)
    for block in (1, 500, 1 << 20):
        got = sorted((r.doc_id is None, r.doc_id, list(r.ids), bytes(r.decoded))
                     for r in word_bpe.decode(word_bpe.encode(df, RANKS, block_bytes=block), RANKS).collect())
        want = sorted((r[0] is None, r[0], enc.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in odd_rows())
        assert got == want
    assert word_bpe.encode(empty(spark), RANKS).count() == 0


def test_decoding_holds_the_bytes_of_a_batch_once():
    texts = [(t or "") * 20 for _, t in documents()[:200]]
    enc = reference()
    ids = pa.array([enc.encode_ordinary(t) for t in texts], pa.list_(pa.int32()))
    size = sum(len(t.encode()) for t in texts)
    word_bpe.token_table(RANKS)
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    got = word_bpe.decoded_bytes(ids, RANKS)
    held, _ = tracemalloc.get_traced_memory()
    arrow = pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert [x.as_py() for x in got] == [t.encode() for t in texts] and got.type == pa.binary()
    assert held + arrow < 1.4 * size and arrow < size / 10
    assert len(word_bpe.decoded_bytes(ids.slice(0, 0), RANKS)) == 0


def test_pre_tokens_join_to_the_text_for_ascii_and_other_texts():
    for _, t in documents()[:200]:
        assert "".join(word_bpe.pre_tokens(t, P.PATTERN)) == t
        if t.isascii():
            assert word_bpe.pre_tokens(t, P.PATTERN) == word_bpe.splitter(P.PATTERN).findall(t)


def test_json_encoder_equals_tokenizers_library():
    tk = Tokenizer.from_file(JSON)
    enc = from_json(JSON)
    texts = [t or "" for _, t in documents()] + [r[1] or "" for r in odd_rows()]
    for t, e in zip(texts, tk.encode_batch(texts, add_special_tokens=False)):
        assert enc.encode_to_numpy(t, allowed_special="all").tolist() == e.ids
    assert from_ranks(RANKS).encode_ordinary("it's") == enc.encode_ordinary("it's")


def _check(rows, texts):
    tk = Tokenizer.from_file(JSON)
    ids = {}
    for (i, t), e in zip(texts, tk.encode_batch([t or "" for _, t in texts], add_special_tokens=False)):
        ids.setdefault(i, np.array(e.ids + [0], "<u4"))
    bins = defaultdict(list)
    per = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        per[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= 2048
    for i, x in ids.items():
        starts = {r.piece: (r.start, r.length) for r in per[i]}
        assert [starts[k] for k in sorted(starts)] == packing.cut_points(len(x))
    return len(bins), sum(r.length for r in rows)


def test_packing_query_holds_every_piece_and_wastes_little(spark):
    rows = QUERIES["op5_vector_best_fit"](spark, SF).collect()
    n, tokens = _check(rows, documents())
    assert n <= 1.02 * -(-tokens // 2048) + 1


def test_packing_odd_rows(spark):
    rows = packing.packed_documents(odd(spark), JSON).collect()
    _check(rows, [(r[0], r[1]) for r in odd_rows()])
    assert len(rows) == sum(len(packing.cut_points(len(from_json(JSON).encode_to_numpy(r[1] or "", allowed_special="all")) + 1)) for r in odd_rows())
    assert packing.packed_documents(empty(spark), JSON).count() == 0


def test_every_capacity_binds():
    lengths = np.sort(np.random.default_rng(3).integers(1, 700, 3000))[::-1]
    for rule in ("norm", "dot"):
        bins, _ = packing.pack_group(lengths, 2048, 5, 1_000_000, rule=rule)
        for b in range(bins.max() + 1):
            x = lengths[bins == b]
            assert 0 < len(x) <= 5 and x.sum() <= 2048 and (x.astype(float) ** 2).sum() <= 1_000_000


def test_pieces_carry_their_ids(spark):
    rows = packing.pieces(odd(spark), JSON).collect()
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)


def test_pieces_of_very_long_texts(spark):
    """White space, one letter and a mixture, each longer than the pattern engine takes in one run."""
    texts = [" " * 2_000_000, "x" * 400_000, "ab " + "\n " * 700_000 + "é" * 100_000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in packing.pieces(df, JSON).collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
    tk = Tokenizer.from_file(JSON)
    for i, t in enumerate(texts):
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert sorted(got[i]) == [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n in packing.cut_points(len(ids))]
