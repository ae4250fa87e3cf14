"""Spelling variants: words one edit apart, found by dense prefix-suffix tiles.

Two words are one insertion, deletion or replacement apart exactly when their common prefix and
common suffix together reach the longer word's length m less one. So for a window of w letters
some start a (a multiple of w) has the first a letters and the last m - a - w letters in common:
the change hides in the window. Words are grouped by (m, a, those letters), and each group is
compared densely: rows of padded code points, block against block, prefix and suffix lengths of
all pairs of two blocks at once. A pair counts only at the start that holds the end of its
common prefix, so it is found once and needs no distinct.

Groups of more than ``TILE`` words are dealt again by windows of one letter, where a group's words
differ in that one letter and are therefore at most one more than the alphabet's letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strata.llm.common import id_text, in_parts
from strata.session import persist_table

#: One run in this many (by checksum) loses a letter.
EVERY = 199
#: Words of at least so many letters and occurrences; a form has at least RATIO times the occurrences.
MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: Letters hidden at a time, words of a group compared at a time at most, and side of a block.
WINDOW, TILE, SIDE = 3, 2048, 96
#: Distinct words that a task counts before it hands them on; rows of whole groups compared together.
HELD_WORDS, HELD_ROWS = 300_000, 8192

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lower_ascii(word: str) -> str:
    return word.lower() if word.isascii() else word.translate(_LOWER)


def varied(word: str, prefix: int) -> str:
    """The word, less one letter where its checksum (continued from the document's) says so."""
    h = zlib.crc32(word.encode(), prefix)
    if h % EVERY:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """documents -> (word, n): the distinct runs of letters and how often they occur.

    A null text has none; a null doc_id takes part in no checksum, so its words keep their letters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for b in in_parts(batch):
                for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                    if not (text := t.as_py()):
                        continue
                    prefix = None if i is None else zlib.crc32(f"{i}:".encode())
                    for raw, n in Counter(RUN.findall(text)).items():
                        word = lower_ascii(raw)
                        held[word if prefix is None else varied(word, prefix)] += n
                    if len(held) >= HELD_WORDS:
                        yield flush()
        if held:
            yield flush()

    return id_text(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _edges(start: str, window: int) -> list:
    """The letters of a word on both sides of the window at ``start`` of a word of m letters."""
    rest = f"greatest(m - {start} - {window}, 0)"
    return [F.expr(f"{start} as a"), F.lit(window).alias("w"), F.expr(f"substring(word, 1, {start}) as head"),
            F.expr(f"case when {rest} = 0 then '' else right(word, {rest}) end as tail")]


GROUP = ["m", "a", "w", "head", "tail"]


def groups(words: DataFrame, window: int = WINDOW, tile: int = TILE) -> DataFrame:
    """(word, n) -> a row per word and group it is compared in: m, a, w, head, tail, word, n.

    A word of l letters is in groups as the longer one (m = l) and as the shorter one (m = l + 1).
    """
    roles = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") + 1)))
    wide = roles.withColumn("s", F.explode(F.expr(f"sequence(0, m - 1, {window})"))).select("word", "n", "m", *_edges("s", window))
    sizes = wide.groupBy(*GROUP).agg(F.count("*").alias("members"), F.max(F.length("word")).alias("longest"))
    # Alone in its group, or none of the longer length: nothing to compare.
    live = sizes.filter((F.col("members") > 1) & (F.col("longest") == F.col("m"))).select(*GROUP, "members")
    dealt = wide.join(live, GROUP)
    small = dealt.filter(F.col("members") <= tile).select("word", "n", *GROUP)
    large = (dealt.filter(F.col("members") > tile).select("word", "n", "m", F.explode(F.expr("sequence(a, least(a + w, m) - 1)")).alias("s"))
             .select("word", "n", "m", *_edges("s", 1)))
    return small.unionByName(large)


def _tile_pairs(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the rows one edit apart, rows of one group being adjacent."""
    words = rows["word"].to_pylist()
    size = np.fromiter(map(len, words), np.int32, len(words))
    width = int(size.max()) + 1
    # Letters are below 256: padded rows from the left, and from the right in reverse.
    front = np.zeros((len(words), width), np.uint8)
    back = np.zeros((len(words), width), np.uint8)
    for k, x in enumerate(words):
        raw = np.frombuffer(x.encode("latin-1"), np.uint8)
        front[k, : len(raw)] = raw
        back[k, : len(raw)] = raw[::-1]
    m, a, w = (rows[c].to_numpy() for c in ("m", "a", "w"))
    new = np.zeros(len(words), bool)
    for c in GROUP:
        col = rows[c].combine_chunks()
        new[1:] |= np.asarray(pa.compute.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False), bool)
    group = np.cumsum(new)
    for s in range(0, len(words), SIDE):
        e = min(s + SIDE, len(words))
        for t in range(s, len(words), SIDE):
            if t > s and group[t] > group[e - 1]:
                break
            u = min(t + SIDE, len(words))
            same = group[s:e, None] == group[None, t:u]
            longer = (size[s:e] == m[s:e])[:, None] | (size[t:u] == m[t:u])[None, :]
            same &= longer & (np.arange(s, e)[:, None] < np.arange(t, u)[None, :])
            i, j = np.nonzero(same)
            if 4 * len(i) < same.size:  # few pairs share a group: those only
                p = (front[s + i] != front[t + j]).argmax(1)
                q = (back[s + i] != back[t + j]).argmax(1)
            else:
                p = (front[s:e, None] != front[None, t:u]).argmax(2)[i, j]
                q = (back[s:e, None] != back[None, t:u]).argmax(2)[i, j]
            i, j = i + s, j + t
            hit = (p + q >= m[i] - 1) & (p < a[i] + w[i])
            if hit.any():
                yield i[hit], j[hit]


def near_words(words: DataFrame, window: int = WINDOW, tile: int = TILE) -> DataFrame:
    """(word, n) of distinct words -> (word, other, other_n): both directions of every pair that
    is one inserted, deleted or replaced letter apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
            word, n = t["word"].combine_chunks(), t["n"].combine_chunks()
            for i, j in _tile_pairs(t):
                x, y = np.concatenate([i, j]), np.concatenate([j, i])
                yield pa.RecordBatch.from_arrays([word.take(pa.array(x)), word.take(pa.array(y)), n.take(pa.array(y))], names=["word", "other", "other_n"])

        def whole_groups(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            end = len(t)
            if not last:  # the last group may go on in the next batch
                keys = [t[c].to_numpy(zero_copy_only=False) for c in GROUP]
                while end and all(k[end - 1] == k[-1] for k in keys):
                    end -= 1
            if end:
                yield from compare(t.slice(0, end))
            if end < len(t):
                held.extend(t.slice(end).combine_chunks().to_batches())

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= HELD_ROWS:
                yield from whole_groups(False)
        if held:
            yield from whole_groups(True)

    dealt = groups(words, window, tile).repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(run, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the end of each chain of forms.

    A form occurs RATIO times as often as its word, so a chain has no cycle and at most some 27
    steps below 2^63 occurrences; each round doubles the steps taken.
    """
    step = persist_table(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        nxt = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if step.join(nxt, "root", "left_semi").isEmpty():
            return step
        step = persist_table(step.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "forms")


def spelling_variants(docs: DataFrame, window: int = WINDOW, tile: int = TILE) -> DataFrame:
    """documents (doc_id, text, ...) -> word, form, root, n, n_near, form_n, a row per word of at
    least MIN_LETTERS letters and MIN_COUNT occurrences.

    Repeated rows count as often as they come. No documents or no such word: no rows.
    """
    words = persist_table(count_words(docs).filter((F.length("word") >= MIN_LETTERS) & (F.col("n") >= MIN_COUNT)), "words")
    best = (near_words(words, window, tile).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("w"))).alias("best")))
    named = F.col("best.less") <= -RATIO * F.col("n")
    out = persist_table(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(named, F.col("best.w")).alias("form"), F.when(named, -F.col("best.less")).alias("form_n")), "variants")
    ends = roots(out.filter("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
