"""Small inputs with the odd cases that every training-data operator must take."""

from __future__ import annotations

import random

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, length string, bucket string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows(seed: int = 1) -> list[tuple]:
    """Null text, null id, null lang and source, empty, white space, a repeated row, copies, a near
    copy, a long text, a run of one letter, letters of four bytes; extra columns with clashing names."""
    rng = random.Random(seed)
    long = "\n".join(sentence(rng, 60) for _ in range(120))
    base = sentence(rng, 80)
    near = base.split()
    near[40] = "changed"
    texts = [None, "", " \t\n ", base, base, " ".join(near), long, "x" * 700, "𝔘𝔫𝔦 ßäö " * 40, "one two", "One TWO", "a\x1cb\x85 \xa0c",
             "it's <|endoftext|> we'll  see\n\n  12345 ###", sentence(rng, 30) + "\n" + base + "\n" + sentence(rng, 30)]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", None][i % 2], len(t or ""), "k", "s", "l", "b") for i, t in enumerate(texts)]
    return rows + [rows[3], (None, "text without an id " * 5, "en", "s1", 5, "k", "s", "l", "b")]


def odd(spark, seed: int = 1):
    return spark.createDataFrame(odd_rows(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(sf: str = SF) -> list[tuple[int, str]]:
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
